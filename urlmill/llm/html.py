"""Operator 4: the main text of web pages, by wrapper induction.

Method: the DOM trees of pages of one host are aligned with the host's template by simple tree matching (the maximum number of nodes that two
trees share in order, level by level), one after another; nodes that the template lacks are inserted into it as new slots. A slot remembers how many
distinct pages have it and with which texts. A text that nearly all pages have in one slot is constant and belongs to the template, varying slots are
content - wherever they stand, but for what names itself furniture by tag, role or class (menus, forms, adverts, comments and the like). The
main text is the smallest subtree with child blocks that holds all varying slots; lists of nothing but links outside of main elements are menus. Tags are weights in that: text below <article>/<main> counts
MAIN times, and where that outweighs the varying text elsewhere in the group's pages, a page's outermost such elements are the region.

Scale: pages are dealt by host, hosts of more than PART pages in several parts, and a task takes the pages of a part GROUP to 2 * GROUP at a time, fewer where
they have more than CHARS to 2 * CHARS characters; each such group induces its template from all its pages. So a task holds the trees of 2 * CHARS characters (about 250 MB) or of one longer page: pages of more than
CHARS / SMALL characters, far beyond those of the tables, may be judged by their tags alone. Page counts per host are a map-side sum; the table of hosts with
several parts is broadcast if it has at most FEW rows (a driver-side count) and joined by a shuffle beyond. html moves once in the first case.
Reading a page is linear in its length; equal pages of a group are read once.

Defined cases: null or empty html gives an empty string; repeated pages are extracted alike and count once for the template; a null url is a host of
its own, a null page_id stays null; unclosed and stray tags are repaired as browsers do for blocks, what follows an unclosed tag's last < is no text;
a host with fewer than SMALL distinct pages has no constant slots, and below MIN_PAGES a constant text must be in all of them; very long and very deep
pages are read and aligned whole; other columns are ignored, whatever their names; empty table: empty result.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table

GROUP, PART, FEW = 200, 400, 50_000
#: Characters of html in one group; a tree takes about twelve times its page.
CHARS = 10_000_000
#: The largest product of two sibling lists that is aligned cell by cell, and whose table is held at once; longer ones go by rows and are halved first.
SMALL_TABLE, CELLS = 4_000, 250_000
#: A text of a slot is constant if at least this many distinct pages have the slot, in at least this share of all, all but this share with that text.
MIN_PAGES, MIN_SHARE, MIN_SAME = 8, 0.8, 0.95
#: Groups of fewer distinct pages have no constant slots; below MIN_PAGES all pages must agree.
SMALL = 4
MAIN = 4

# Fixed values of HTML: element classes of the standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: What an opening tag closes besides an open paragraph, and blocks beyond which neither is looked for.
CLOSES = {"li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
BARRIER = BLOCK - {"p", "li", "dt", "dd", "td", "th", "tr"}
HIDDEN = RAW | frozenset("head nav header footer aside form button select option dialog menu object canvas audio video datalist label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: A class or id is furniture if all its parts are of these words, one of the first list.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer header masthead "
    "cookie cookies consent gdpr notice notices comment comments disqus replies respond share sharing social related newsletter subscribe signup login popup modal overlay widget widgets toolbar pagination pager".split()
)
PLAIN = frozenset("site page global main top bottom left right upper lower primary secondary box bar list item items link links area wrapper wrap container inner outer section block slot unit button buttons icons form posts text content".split())
OPEN = re.compile(r"[a-zA-Z][^\s/>]*")
# Quotes count only after an equals sign; one that is never closed is a sign like others. Nothing is read twice.
REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)*+)>")
ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+))?+")
LONG_REFERENCE = re.compile(r"&#(?:0++([0-9]{0,7})(?![0-9])|0*+[0-9]{8,}|[xX]0*+[0-9a-fA-F]{7,});?")
CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}


def decoded(text: str) -> str:
    """The text with character references decoded; numbers beyond all code points are the replacement sign."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = LONG_REFERENCE.sub(lambda m: f"&#{m[1] or 0};" if m[1] is not None else "\ufffd", text)
    return unescape(text)


def furniture(names: str) -> bool:
    """Whether a class or id among names says that the element is no content."""
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=[0-9])", name) if p and not p.isdigit()]
        if any(p in FURNITURE for p in parts) and all(p in FURNITURE or p in PLAIN for p in parts):
            return True
    return False


class Node:
    """tag, children (nodes and strings in order), whether its attributes mark it as no content or as main text, and its own text for alignment."""

    __slots__ = ("tag", "kids", "skip", "main", "text", "slot")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids, self.slot, self.text = tag, [], None, None
        self.skip = self.main = False
        if attrs and not attrs.isspace():
            named = {k.lower(): decoded(v.strip("\"'")) for k, v in ATTR.findall(attrs)}
            role = named.get("role", "").lower()
            self.skip = role in ROLES or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "").lower() or furniture(f"{named.get('class', '')} {named.get('id', '')}")
            self.main = role == "main" or named.get("itemprop") == "articleBody"
        self.skip = self.skip or tag in HIDDEN
        self.main = not self.skip and (self.main or tag in ("article", "main"))


class _Open:
    """The open elements, with the places of each tag, of blocks and of barriers among them."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks, self.barriers = [root], defaultdict(list), [0], [0]

    def push(self, node: Node) -> None:
        place = len(self.nodes)
        self.nodes.append(node)
        self.at[node.tag].append(place)
        if node.tag in BLOCK:
            self.blocks.append(place)
        if node.tag in BARRIER:
            self.barriers.append(place)

    def close(self, place: int) -> None:
        while len(self.nodes) > place:
            self.at[self.nodes.pop().tag].pop()
        for places in (self.blocks, self.barriers):
            while places[-1] >= place:
                places.pop()

    def last(self, *tags: str) -> int:
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)


def parse(html: str) -> Node:
    """The DOM tree of a page, with open paragraphs and list items closed where the standard does."""
    root = Node("html")
    stack, at, end, cdata = _Open(root), 0, len(html), True
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            stack.nodes[-1].kids.append(decoded(html[at:]))
            break
        sign = html[lt + 1 : lt + 2]
        closing = sign == "/"
        name = OPEN.match(html, lt + 1 + closing)
        if not name and not closing and sign not in ("!", "?"):
            # No tag: the sign itself and the text up to the next one.
            after = html.find("<", lt + 1)
            after = end if after < 0 else after
            stack.nodes[-1].kids.append(decoded(html[at:after]))
            at = after
            continue
        if lt > at:
            stack.nodes[-1].kids.append(decoded(html[at:lt]))
        if not name:
            stop, width = -1, 1
            if html.startswith("<!--", lt):
                stop, width = html.find("-->", lt + 2), 3
                if stop < 0:
                    break
            elif cdata and html.startswith("<![CDATA[", lt):
                stop, width = html.find("]]>", lt), 3
                cdata = stop >= 0
            if stop < 0:
                stop, width = html.find(">", lt), 1
            if stop < 0:
                break
            at = stop + width
            continue
        rest = REST.match(html, name.end())
        if not rest:
            break
        tag, attrs, at = name[0].lower(), rest[1], rest.end()
        if closing:
            place = stack.last(tag)
            if place and (tag in BLOCK or stack.blocks[-1] <= place):
                stack.close(place)
            continue
        if tag in ("html", "body"):
            continue
        ends = CLOSES.get(tag, ()) + (("p",) if tag in ENDS_P else ())
        if ends and (place := stack.last(*ends)) > stack.barriers[-1]:
            # A new block ends an open paragraph; a new item ends an open item of the same list.
            stack.close(place)
        node = Node(tag, attrs)
        stack.nodes[-1].kids.append(node)
        if tag in VOID or (tag in ("svg", "math") and attrs.endswith("/")):
            continue
        if tag in RAW:
            close = CLOSING[tag].search(html, at)
            at = close.end() if close else end
            continue
        stack.push(node)
    return root


def blocks(node: Node) -> list[str]:
    """Text of the blocks below node, in page order, without skipped nodes; white space within a block is one space."""
    out, run = [], []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    todo = [iter(node.kids)]
    closes = [True]
    while todo:
        kid = next(todo[-1], None)
        if kid is None:
            todo.pop()
            if closes.pop():
                flush()
        elif isinstance(kid, str):
            run.append(kid)
        elif kid.skip:
            if kid.tag in BLOCK:
                flush()
        elif kid.tag == "br":
            run.append(" ")
        elif kid.tag not in VOID:
            if kid.tag in BLOCK:
                flush()
            todo.append(iter(kid.kids))
            closes.append(kid.tag in BLOCK)
        elif kid.tag == "hr":
            flush()
    flush()
    return out


def frame(node: Node) -> Node:
    """Sets the text of every leaf among block-level nodes, and `slot`: the block-level nodes next below each, whatever inline elements are between."""
    order = [node]
    for x in order:
        x.slot, todo = [], x.kids[::-1]
        while todo:
            k = todo.pop()
            if isinstance(k, Node) and k.tag not in VOID:
                if k.tag in BLOCK:
                    x.slot.append(k)
                else:
                    todo.extend(reversed(k.kids))
        order.extend(x.slot)
        x.text = None if x.slot else " ".join(_inner(x).split())
    return node


def _inner(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            out.append(" ")
            todo.extend(reversed(x.kids))
    return "".join(out)


class Slot:
    """A template node: tag, children, distinct pages that have it, and how many of them have which text; `text` is the most frequent, the latest of equals."""

    __slots__ = ("tag", "kids", "pages", "counts", "text")

    def __init__(self, tag: str):
        self.tag, self.kids, self.pages, self.counts, self.text = tag, [], 0, {}, None

    def see(self, node: Node) -> None:
        self.pages += 1
        if node.text is not None:
            self.counts[node.text] = n = self.counts.get(node.text, 0) + 1
            if self.text is None or n >= self.counts[self.text]:
                self.text = node.text

    def constant(self, text: str | None, pages: int) -> bool:
        if text is None or pages < SMALL:
            return False
        same = self.counts.get(text, 0)
        return same == pages if pages < MIN_PAGES else self.pages >= MIN_SHARE * pages and same >= MIN_SAME * self.pages


def grown(node: Node, pairs: list) -> Slot:
    """A slot like node, with all below it; appends the pairs."""
    top = Slot(node.tag)
    new = [(top, node)]
    for slot, x in new:
        slot.kids = [Slot(k.tag) for k in x.slot]
        new.extend(zip(slot.kids, x.slot))
    pairs.extend(new)
    return top


def match(slot: Slot, node: Node, pairs: list) -> int:
    """Simple tree matching: the size of the largest ordered alignment of the two trees; appends its pairs below the roots.

    A pair of leaves counts twice if the texts agree, so constant leaves find each other among siblings of one tag.
    """
    nested: list = []
    size = _match(slot, node, nested)
    todo = [nested]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo.extend(x)
        else:
            pairs.append(x)
    return size


def _match(slot: Slot, node: Node, pairs: list) -> int:
    """As match; the pairs below a pair are a list of their own within pairs."""
    slots, nodes, head = slot.kids, node.slot, 0
    n, m = len(slots), len(nodes)
    if not n or not m:
        return 1 + (slot.text is not None and slot.text == node.text)
    # No leaf counts more than with its equal, so equal leaves at the ends are pairs of a largest alignment.
    while head < n and head < m and _equal(slots[head], nodes[head]):
        pairs.append((slots[head], nodes[head]))
        head += 1
    total = 2 * head
    while n > head and m > head and _equal(slots[n - 1], nodes[m - 1]):
        n, m = n - 1, m - 1
        pairs.append((slots[n], nodes[m]))
        total += 2
    if n == head or m == head:
        return 1 + total
    slots, nodes, n, m = slots[head:n], nodes[head:m], n - head, m - head
    if n * m > SMALL_TABLE:
        for a, b in long_pairs(slots, nodes):
            pairs.append((a, b))
            total += _match(a, b, pairs)
        return 1 + total
    if n == m == 1:
        if slots[0].tag == nodes[0].tag:
            pairs.append((slots[0], nodes[0]))
            total += _match(slots[0], nodes[0], pairs)
        return 1 + total
    inner, best = {}, [[0] * (m + 1)]
    for i, a in enumerate(slots):
        row, above = [0], best[-1]
        for j, b in enumerate(nodes):
            most = above[j + 1] if above[j + 1] >= row[j] else row[j]
            if a.tag == b.tag:
                if not a.kids or not b.slot:
                    weight = 1 + (a.text is not None and a.text == b.text)
                else:
                    found: list = []
                    weight = _match(a, b, found)
                    inner[i, j] = found
                if above[j] + weight > most:
                    most = above[j] + weight
            row.append(most)
        best.append(row)
    i, j = n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((slots[i], nodes[j]))
            if (i, j) in inner:
                pairs.append(inner[i, j])
    return 1 + total + best[n][m]


def _equal(a: Slot, b: Node) -> bool:
    return a.tag == b.tag and not a.kids and not b.slot and a.text == b.text


class Weights:
    """Rows of the table of match weights of two sibling lists, 0 where tags differ.

    Trees that share no text but the empty one match by shape alone, so each pair of shapes is matched once.
    """

    def __init__(self, slots: list[Slot], nodes: list[Node]):
        self.slots, self.nodes, self.shapes, self.known = slots, nodes, {}, {}
        self.at, self.rows = defaultdict(list), {}
        self.left, right = [self._shape(x) for x in slots], [self._shape(x) for x in nodes]
        self.leaves = [_texts(x) for x in slots], [_texts(x) for x in nodes]
        self.texts = tuple([set(t) - {"", None} for t in side] for side in self.leaves)
        for j, has in enumerate(self.texts[1]):
            for t in has:
                self.at[t].append(j)
        self.kinds, self.right = np.unique(np.array(right), return_inverse=True)
        self.shape_of = {v: k for k, v in self.shapes.items()}

    def _shape(self, x: Slot | Node) -> int:
        """The number of a tree without its texts."""
        kids = x.kids if isinstance(x, Slot) else x.slot
        key = (x.tag, x.text == "", tuple([self._shape(k) for k in kids]))
        return self.shapes.setdefault(key, len(self.shapes))

    def alike(self) -> bool:
        """Whether all pairs weigh the same: one shape, no text in common. Then any ordered alignment of the shorter list is a largest one."""
        return len(self.kinds) == 1 and {*self.left} == {*self.kinds.tolist()} and not set().union(*self.texts[0]) & self.at.keys()

    def _pair(self, i: int, j: int) -> int:
        """The weight of two trees of one tag that share texts: equal for all of their shapes with the same texts in the same places."""
        a, b = self.slots[i], self.nodes[j]
        if not a.kids or not b.slot:
            return 1 + (a.text is not None and a.text == b.text)
        common = self.texts[0][i] & self.texts[1][j]
        key = (self.left[i], int(self.right[j]), *(tuple([t if t in common else None for t in side[x]]) for side, x in zip(self.leaves, (i, j))))
        if key not in self.known:
            self.known[key] = match(a, b, [])
        return self.known[key]

    def _shapes(self, a: int, b: int) -> int:
        (tag, empty, kids), (other, blank, more) = self.shape_of[a], self.shape_of[b]
        if tag != other:
            return 0
        if not kids or not more:
            return 1 + (empty and blank)
        if (a, b) not in self.known:
            kinds, places = np.unique(np.array(more), return_inverse=True)
            rows = {x: np.array([self._shapes(x, y) for y in kinds.tolist()])[places] for x in set(kids)}
            self.known[a, b] = 1 + int(last(map(rows.get, kids), len(more))[-1])
        return self.known[a, b]

    def row(self, i: int, start: int, end: int) -> np.ndarray:
        """Weights of slot i with nodes start to end."""
        a, shape = self.slots[i], self.left[i]
        # What is remembered stays bounded where nearly all shapes differ.
        if len(self.known) > CELLS:
            self.known.clear()
        if shape not in self.rows:
            if len(self.rows) * len(self.kinds) > CELLS:
                self.rows.clear()
            self.rows[shape] = np.array([self._shapes(shape, y) for y in self.kinds.tolist()])
        out = self.rows[shape][self.right[start:end]]
        for j in set().union(*(self.at[t][bisect_left(self.at[t], start) : bisect_left(self.at[t], end)] for t in self.texts[0][i] if t in self.at)):
            if a.tag == self.nodes[j].tag:
                out[j - start] = self._pair(i, j)
        return out


def _texts(top: Slot | Node) -> list[str | None]:
    """The texts of a tree, parents first."""
    out, todo = [], [top]
    while todo:
        x = todo.pop()
        out.append(x.text)
        todo.extend(x.kids if isinstance(x, Slot) else x.slot)
    return out


def last(rows: Iterable[np.ndarray], m: int) -> np.ndarray:
    """The last row of the alignment table."""
    best = np.zeros(m + 1, np.int64)
    for w in rows:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + w))
    return best


def long_pairs(slots: list[Slot], nodes: list[Node]) -> list[tuple[Slot, Node]]:
    """A largest ordered alignment of two long sibling lists, by halving the first (Hirschberg) until a table has at most CELLS cells."""
    weights, out, todo = Weights(slots, nodes), [], [(0, len(slots), 0, len(nodes))]
    if weights.alike():
        return list(zip(slots, nodes))
    while todo:
        i, n, j, m = todo.pop()
        if n - i > 1 and (n - i) * (m - j) > CELLS:
            half = (i + n) // 2
            head = last((weights.row(x, j, m) for x in range(i, half)), m - j)
            tail = last((weights.row(x, j, m)[::-1] for x in range(n - 1, half - 1, -1)), m - j)
            cut = j + int(np.argmax(head + tail[::-1]))
            todo += [(i, half, j, cut), (half, n, cut, m)]
            continue
        best = np.zeros((n - i + 1, m - j + 1), np.int64)
        for x in range(n - i):
            best[x + 1, 1:] = np.maximum.accumulate(np.maximum(best[x, 1:], best[x, :-1] + weights.row(i + x, j, m)))
        x, y = n - i, m - j
        while x and y:
            if best[x, y] == best[x - 1, y]:
                x -= 1
            elif best[x, y] == best[x, y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                out.append((slots[i + x], nodes[j + y]))
    return out


def align(template: Slot, node: Node) -> list[tuple[Slot, Node]]:
    """The pairs of a largest alignment of node with the template, into which what it lacks is inserted as new slots."""
    pairs: list = [(template, node)]
    match(template, node, pairs)
    of = {id(x): slot for slot, x in pairs}
    for slot, x in pairs[:]:
        if x.slot and not all(id(k) in of for k in x.slot):
            merged, at, place = [], 0, {id(s): i for i, s in enumerate(slot.kids)}
            for k in x.slot:
                if id(k) in of:
                    to = place[id(of[id(k)])] + 1
                    merged += slot.kids[at:to]
                    at = to
                else:
                    merged.append(grown(k, pairs))
            slot.kids = merged + slot.kids[at:]
    return pairs


def induce(pages: list[Node]) -> list[list[tuple[Slot, Node]]]:
    """The alignment of each of several framed pages with the template of all of them. Short pages come first, so a long one is aligned once."""
    template, out = Slot("html"), {}
    for i in sorted(range(len(pages)), key=lambda i: len(pages[i].slot)):
        out[i] = align(template, pages[i])
        for slot, node in out[i]:
            slot.see(node)
    return [out[i] for i in range(len(pages))]


class Varying:
    """Where a page has text that is neither constant nor marked as no content."""

    def __init__(self, page: Node, constant: dict[int, Node]):
        self.page, self.constant, self.has, self.weight, self.own = page, constant, set(), {}, {}
        self.mains, todo, plain = [], [page], _plain(page)
        while todo:
            x = todo.pop()
            if x.main:
                if _holds_text(x):
                    self.mains.append(x)
            elif x.tag in ("ul", "ol") and len(x.slot) > 1 and not any(_in_plain(k, plain) for k in x.kids):
                x.skip = True  # a menu: a list of nothing but links
            else:
                todo.extend(k for k in reversed(x.kids) if isinstance(k, Node) and not k.skip)
        for x in [page, *_below(page)][::-1]:
            own = 0 if id(x) in constant else _beside(x)
            self.weight[id(x)] = own + sum(self.weight.get(id(k), 0) for k in x.slot)
            if own:
                self.own[id(x)] = own
            if self.weight[id(x)]:
                self.has.add(id(x))

    def shares(self) -> tuple[int, int]:
        """Characters of varying text in main elements, and elsewhere."""
        main = sum(self.weight.get(id(x), 0) if x.slot is not None else _beside(x) for x in self.mains)
        return main, max(0, self.weight[id(self.page)] - main)

    def region(self) -> Node:
        """The smallest subtree with child blocks that holds all varying text."""
        at = self.page
        while True:
            holds = [k for k in at.slot if id(k) in self.has]
            if len(holds) != 1 or not holds[0].slot or id(at) in self.own:
                return at
            at = holds[0]


def _holds_text(top: Node) -> bool:
    """Whether there is text below a node that is not skipped."""
    todo = [top]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x and not x.isspace():
                return True
        elif not x.skip:
            todo.extend(reversed(x.kids))
    return False


def _beside(node: Node) -> int:
    """Characters of text outside of a node's child slots that is not skipped."""
    out, slots, todo = 0, {id(k) for k in node.slot or ()}, list(node.kids)
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x and not x.isspace():
                out += len(x)
        elif not x.skip and id(x) not in slots:
            todo.extend(x.kids)
    return out


def _below(node: Node) -> Iterator[Node]:
    """Framed nodes below a node and outside of skipped ones, parents first."""
    todo = [k for k in node.slot or () if not k.skip]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(k for k in x.slot if not k.skip)


def _in_plain(x: Node | str, plain: set[int]) -> bool:
    return bool(x) and not x.isspace() if isinstance(x, str) else id(x) in plain


def _plain(top: Node) -> set[int]:
    """The nodes that hold text outside of links and skipped nodes, found from the leaves up in one pass."""
    order, plain = [top], set()
    for x in order:
        order.extend(k for k in x.kids if isinstance(k, Node))
    for x in reversed(order):
        if x.tag != "a" and not x.skip and any(_in_plain(k, plain) for k in x.kids):
            plain.add(id(x))
    return plain


def extract(pages: list[str | None]) -> list[str]:
    """Main texts of pages of one host."""
    trees = {h: frame(parse(h or "")) for h in dict.fromkeys(pages)}
    # Pages with one text count once, and equal trees are read alike.
    keys = {h: tuple(blocks(t)) for h, t in trees.items()}
    distinct = {keys[h]: t for h, t in reversed(trees.items())}
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(10**6)  # trees may be as deep as pages are long
    try:
        pairs = dict(zip(distinct, induce(list(distinct.values()))))
        views, main, rest = {}, 0, 0
        for h, tree in trees.items():
            key = keys[h]
            found = pairs[key] if distinct[key] is tree else _against(pairs[key][0][0], tree)
            constant = {id(node): node for slot, node in found if slot.constant(node.text, len(distinct))}
            views[h] = view = Varying(tree, constant)
            if distinct[key] is tree:
                a, b = view.shares()
                main, rest = main + MAIN * a, rest + b
    finally:
        sys.setrecursionlimit(limit)
    texts = {h: _text(view, main >= rest) for h, view in views.items()}
    return [texts[h] for h in pages]


def _against(template: Slot, node: Node) -> list[tuple[Slot, Node]]:
    pairs: list = [(template, node)]
    match(template, node, pairs)
    return pairs


def _text(view: Varying, by_tags: bool) -> str:
    """The main text of a page."""
    if by_tags and view.mains:
        tops = view.mains
    else:
        tops = [view.region()]
    leaves = [x for top in tops for x in (top, *_below(top)) if x.text]
    inside = [x for x in leaves if id(x) in view.constant]
    # Where most of it is constant, by characters and by places, the pages are versions of one article.
    if inside and (2 * len(inside) <= len(leaves) or 2 * sum(len(x.text) for x in inside) <= sum(len(b) for top in tops for b in blocks(top))):
        for node in inside:
            node.skip = True
    return "\n\n".join(b for top in tops if not top.skip for b in blocks(top))


def group_end(sizes: list[int], group: int, chars: int) -> int:
    """How many of the first pages make a group: `group` of them, or as many as stay within `chars` characters, one at least."""
    total = 0
    for n, size in enumerate(sizes[:group]):
        total += size
        if n and total > chars:
            return n
    return min(group, len(sizes))


def extract_pages(pages: DataFrame, group: int = GROUP, part: int = PART, few: int = FEW, chars: int = CHARS) -> DataFrame:
    """page_id, url, text of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    named = pages.select("page_id", "url", "html", host.alias("host"))
    heavy = named.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")).where("parts > 1")
    heavy = F.broadcast(heavy) if heavy.limit(few + 1).count() <= few else heavy
    dealt = named.join(heavy, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))))
    ready = dealt.select("host", "part", "page_id", "url", "html").repartition(spread(pages), "host", "part").sortWithinPartitions("host", "part", "page_id", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def done(rows: list) -> pa.RecordBatch:
            ids, urls, htmls = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(extract(list(htmls)), pa.string())], names=["page_id", "url", "text"])

        for batch in (whole.slice(a, 20) for whole in batches for a in range(0, whole.num_rows, 20)):
            for host, part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                more = len(row[2] or "")
                if (host, part) != key and held:
                    yield done(held)
                    held, size = [], 0
                # A group and what follows it are held, so that the last one is not a small rest.
                while held and (len(held) >= 2 * group or size + more > 2 * chars):
                    n = group_end([len(r[2] or "") for r in held], group, chars)
                    yield done(held[:n])
                    size -= sum(len(r[2] or "") for r in held[:n])
                    held = held[n:]
                key, size = (host, part), size + more
                held.append(row)
        if held:
            yield done(held)

    return ready.mapInArrow(run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
