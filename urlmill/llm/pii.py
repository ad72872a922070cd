"""Operator 6: personal data, by base rules and a semi-Markov conditional random field.

Method: base rules find spans of each kind on their own, and those stay. A semi-Markov CRF then scores candidate segments of at most LONGEST characters, each by
features of the whole span (group sizes, separators, digit count, checksum, alphabet, the words before it, what follows), and dynamic programming over
segments chooses boundaries and kinds jointly: a text is a sequence of single outside characters and segments, best[j] = max(best[j-1], best[i] +
score(i, j, kind)). Candidates are all spans that some kind could have at all: 9 to 19 digits with signs between, runs of hex digits and colons, names
before a spelled-out at with each possible end of their domain, and words of 16 characters or more that hold digits (the kind "secret", which only the
field knows). Which of them are personal data, with which ends and of which kind, the weights decide: order numbers, dates, checksums and
times are candidates too. The weights are fitted at run time by maximum likelihood (semi-Markov forward-backward) on EXAMPLES sentences that this module
makes up from a fixed seed, so they depend on no corpus and are equal in every run. Segments that touch a base span are no
candidates. MARGIN keeps doubtful segments out.

Scale: one scan, no shuffle; a row needs its own text only. Base rules, candidates and decoding run in time linear in the text (overlaps with base
spans are found by bisection), and beside the text only candidates near triggers are held.

Defined cases: a null or empty text has no spans; a very long text is searched whole; repeated rows and ties are treated alike (of segments with equal scores the one that ends first); spans of different
kinds may overlap in the base, and added ones overlap nothing; a null doc_id stays null; `mask` leaves other columns as they are, whatever their names; empty table: empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed values of the contract.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its first digit only; inside one, no other match could start further left.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

EXAMPLES, ROUNDS, MARGIN, LONGEST = 900, 8, 2.0, 200

Span = tuple[int, int, str]


def _order(span: Span) -> tuple[int, int, int]:
    """By start and then kind, as listed."""
    return span[0], KINDS.index(span[2]) if span[2] in KINDS else len(KINDS), span[1]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by start and then kind."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            last = m.end()
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=_order)


# ---- the semi-Markov CRF

# Every candidate holds one of these.
TRIGGER = re.compile(
    r"[0-9](?:[ ()./-]*+[0-9]){8}|[0-9a-fA-F]:[0-9a-fA-F:]|::|[\[({]\s?(?:at|@)\s?[\])}]|(?<=[\w.%+-]) at (?=[\w-]++ dot )|(?<![A-Za-z0-9_])(?=[A-Za-z_]{0,24}[0-9])[A-Za-z0-9_]{16,}", re.I | re.A
)
NUMBERS = re.compile(r"\(?[0-9][0-9 ()./-]*+")
NUMBER_TOKEN = re.compile(r"[0-9]+|[()./-]| +")
AT = re.compile(r" ?[\[({] ?(?:at|@) ?[\])}] ?| at (?=[\w-]+ dot )", re.I | re.A)
LOCAL_BEFORE = re.compile(r"[\w.%+-]+\Z", re.A)
LABEL = re.compile(r"[\w-]+", re.A)
DOT = re.compile(r" ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot |\.", re.I | re.A)
HEXES = re.compile(r"(?<![\w:.])[0-9a-fA-F:]*:[0-9a-fA-F:]*", re.A)
WORDY = re.compile(r"(?<![\w/+-])(?=[A-Za-z_+/-]{0,24}[0-9])[\w+/-]{16,}=*", re.A)
BEFORE = re.compile(r"[^\W\d_]+")
CUES = {  # words that often stand before a kind
    "phone": "phone tel telephone call fax mobile cell whatsapp telefon handy tél téléphone appelez teléfono llame móvil".split(),
    "card": "card visa mastercard amex credit debit kreditkarte carte tarjeta".split(),
    "ip": "ip host server address from client adresse dirección".split(),
    "email": "mail email contact write kontakt courriel correo".split(),
    "secret": "token key apikey secret password passwd pwd auth bearer credential credentials passwort schlüssel clave".split(),
    "other": "order invoice isbn no number id ref version page pages year date item serial nr numéro número commit sha md5 hash checksum digest uuid revision".split(),
}
CUE = {w: k for k, ws in CUES.items() for w in ws}
NAMES = ("shape", "sizes", "signs", "digits", "groups", "check", "cue", "lead", "next", "first")

Key = tuple
Candidate = tuple[int, int, str, Key]


def _cue(text: str, a: int) -> str:
    """The kind that one of the two words before a place speaks for."""
    words = BEFORE.findall(text, max(0, a - 40), a)[-2:]
    return next((CUE[w.lower()] for w in reversed(words) if w.lower() in CUE), "-")


def _edge(text: str, a: int) -> bool:
    """Whether a segment may start at a place: not within a word or a number."""
    return not a or not (text[a - 1].isalnum() or text[a - 1] in "+.:/@-_")


def _stops(text: str, b: int) -> bool:
    """Whether a segment may end before a place."""
    return b >= len(text) or not (text[b].isalnum() or text[b] in "@_%" or (text[b] in ".:/-," and b + 1 < len(text) and text[b + 1].isalnum()))


def _lead(text: str, a: int) -> str:
    return text[a - 1] if a and text[a - 1] in "\"'=(#$€:" else " "


def _next(text: str, b: int) -> str:
    return text[b] if b < len(text) and text[b] in "\"')%€$" else " "


def _context(text: str, a: int, b: int) -> tuple[str, str, str]:
    return _cue(text, a), _lead(text, a), _next(text, b)


def _numbers(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[Candidate]:
    """Spans of 9 to 19 digits, with signs between, from each start to each end that no place taken lies before."""
    starts = [a for a, _ in taken]
    for run in NUMBERS.finditer(text, start, end):
        if sum(map(run[0].count, "0123456789")) < 9:
            continue
        tokens = [(m.start(), m.end(), m[0]) for m in NUMBER_TOKEN.finditer(text, run.start(), run.end())]
        stops = [t.isdigit() and _stops(text, b) for _, b, t in tokens]
        for i, (a, _, head) in enumerate(tokens):
            if not (head[0].isdigit() or head == "("):
                continue
            plus = a > 0 and text[a - 1] == "+"
            before = a - plus
            if not _edge(text, before):
                continue
            at = bisect_right(starts, before)
            if at and taken[at - 1][1] > before:
                continue
            limit = min(before + LONGEST, starts[at] if at < len(starts) else end)
            digits, sizes, signs, groups, context, first = "", "", "", 0, None, ""
            shape = "(" if head == "(" else "+" if plus else "n"
            for x in range(i, len(tokens)):
                _, b, t = tokens[x]
                if b > limit:
                    break
                if not t[0].isdigit():
                    if t[0] not in signs:
                        signs = "".join(sorted(signs + t[0]))
                    continue
                digits += t
                n = len(digits)
                if n > 19:
                    break
                if groups < 8:
                    sizes += f"{'-' if groups else ''}{n if not groups else len(t)}"
                groups += 1
                if groups == 1:
                    first = "year" if n == 4 and digits[:2] in ("19", "20") else ""
                if n < 9 or not stops[x]:
                    continue
                if context is None:
                    context = _cue(text, before), _lead(text, before)
                    first = first or ("978" if digits[:3] in ("978", "979") else digits[0] if digits[0] in "01" else "2-9")
                key = (shape + signs, sizes, signs, n, min(groups, 6), n >= 12 and luhn(digits), *context, _next(text, b), first)
                if n <= 15:
                    yield before, b, "phone", key
                if n >= 12:
                    yield before, b, "card", key


def _hexes(text: str, start: int, end: int) -> Iterator[Candidate]:
    for m in HEXES.finditer(text, start, end):
        a, b = m.span()
        if text[b - 1] == ":" and text[b - 2 : b] != "::":
            b -= 1
        body = text[a:b]
        colons = body.count(":")
        if 2 <= colons <= 7 and 4 < b - a <= 39 and _stops(text, b):
            groups = body.split(":")
            sizes = {min(len(g), 5) for g in groups if g}
            cue, lead, after = _context(text, a, b)
            yield a, b, "ip", ("::" if "::" in body else ":", f"{min(sizes, default=0)}-{max(sizes, default=0)}", colons, "hex" if re.search("[a-fA-F]", body) else "digits", len(groups), len(groups) == 8 or "::" in body, cue, lead, after, "-")


def _mails(text: str, start: int, end: int) -> Iterator[Candidate]:
    for m in AT.finditer(text, start, end):
        local = LOCAL_BEFORE.search(text, max(0, m.start() - LONGEST), m.start()) if m.start() else None
        if not local or not _edge(text, local.start()):
            continue
        a, at, labels, signs = local.start(), m.end(), 0, set()
        while label := LABEL.match(text, at, min(len(text), a + LONGEST)):
            labels, b = labels + 1, label.end()
            dot = DOT.match(text, b)
            goes_on = bool(dot) and LABEL.match(text, dot.end()) is not None
            if labels > 1 and (goes_on or b >= len(text) or not (text[b].isalnum() or text[b] in "@_%")):
                cue, lead, after = _context(text, a, b)
                yield a, b, "email", ("plain" if m[0].strip().isalpha() else "marked", "goes on" if goes_on else "ends", "".join(sorted(signs)), "-", min(labels, 5), 2 <= b - label.start() <= 6, cue, lead, after, "-")
            if not goes_on:
                break
            signs.add("." if dot[0] == "." else "word" if dot[0].strip().isalpha() else "mark")
            at = dot.end()


def _secrets(text: str, start: int, end: int) -> Iterator[Candidate]:
    for m in WORDY.finditer(text, start, end):
        a, b = m.span()
        body = m[0]
        n = b - a
        if n > LONGEST or not _stops(text, b):
            continue
        digits = sum(c.isdigit() for c in body)
        if digits == n:
            continue
        alphabet = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", body) else "word" if body.replace("_", "").isalnum() else "64"
        turns = sum(x.isdigit() != y.isdigit() for x, y in zip(body, body[1:]))
        size = n if n in (32, 40, 64) else min(n // 8 * 8, 96)
        cue, lead, after = _context(text, a, b)
        uuid = body.count("-") == 4 and n == 36
        yield a, b, "secret", (alphabet, size, "uuid" if uuid else "-", min(10 * digits // n, 9), min(10 * turns // n, 6), body.islower() or body.isupper(), cue, lead, after, "-")


def candidates(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> list[Candidate]:
    """The candidate segments within a window that touch none of the places taken (in order, apart)."""
    starts = [a for a, _ in taken]
    out = list(_numbers(text, start, end, taken))
    for make in (_hexes, _mails, _secrets):
        for c in make(text, start, end):
            at = bisect_left(starts, c[1])
            if not at or taken[at - 1][1] <= c[0]:
                out.append(c)
    return out


def features(kind: str, key: Key) -> list[str]:
    """Names of the features of a whole span as a segment of a kind."""
    return [f"{kind}|bias", *[f"{kind}|{n} {v}" for n, v in zip(NAMES, key)], f"{kind}|{key[0]} {key[1]}", f"{kind}|{key[5]} {key[3]}", f"{kind}|{key[0]} {key[6]} {key[9]}"]


class Weights(dict):
    """Weights by feature name, and the scores of the segments seen, forgotten at a bound."""

    BOUND = 100_000

    def __init__(self, *args):
        super().__init__(*args)
        self.known: dict[tuple[str, Key], float] = {}

    def score(self, kind: str, key: Key) -> float:
        found = self.known.get((kind, key))
        if found is None:
            if len(self.known) >= self.BOUND:
                self.known.clear()
            found = self.known[kind, key] = sum(self.get(x, 0.0) for x in features(kind, key))
        return found

    def __reduce__(self):
        return Weights, (dict(self),)


def decode(found: list[Candidate], w: Weights) -> list[Span]:
    """The best sequence of outside characters and segments. Only ends of segments need a place in the table, as characters outside score nothing."""
    good = sorted((b, a, k, s) for a, b, k, key in found if (s := w.score(k, key) - MARGIN) > 0)
    ends, best, back = [-1], [0.0], [None]
    for b, a, k, s in good:
        if b != ends[-1]:
            ends.append(b)
            best.append(best[-1])
            back.append(None)
        to = bisect_right(ends, a, 0, len(ends) - 1) - 1
        if best[to] + s > best[-1]:
            best[-1], back[-1] = best[to] + s, (a, k, to)
    out, j = [], len(ends) - 1
    while j > 0:
        if back[j]:
            out.append((back[j][0], ends[j], back[j][1]))
            j = back[j][2]
        else:
            j -= 1
    return out[::-1]


def _gradient(found: list[Candidate], gold: set[Span], w: dict[str, float]) -> dict[str, float]:
    """Observed less expected feature counts of a text: the gradient of its log-likelihood."""
    places = sorted({p for a, b, *_ in found for p in (a, b)})
    n, at = len(places), {p: i for i, p in enumerate(places)}
    ends, starts, names = defaultdict(list), defaultdict(list), [features(k, key) for *_, k, key in found]
    scores = [sum(w.get(x, 0.0) for x in f) for f in names]
    for x, (a, b, *_) in enumerate(found):
        ends[at[b]].append(x)
        starts[at[a]].append(x)
    join = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
    fore, back = [0.0] * n, [0.0] * n
    for j in range(1, n):
        fore[j] = join([fore[j - 1], *(fore[at[found[x][0]]] + scores[x] for x in ends[j])])
    for i in range(n - 2, -1, -1):
        back[i] = join([back[i + 1], *(back[at[found[x][1]]] + scores[x] for x in starts[i])])
    out: dict[str, float] = defaultdict(float)
    for x, (a, b, k, _) in enumerate(found):
        gain = ((a, b, k) in gold) - math.exp(min(0.0, fore[at[a]] + scores[x] + back[at[b]] - fore[-1]))
        for name in names[x]:
            out[name] += gain
    return out


class Maker:
    """Made-up values: of each kind, and of numbers and words that are none."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def num(self, k: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(k))

    def fill(self, form: str) -> str:
        """# is a digit, N one from 2 to 9, h a hex digit, w a word."""
        some = {"#": lambda: self.num(1), "N": lambda: self.r.choice("23456789"), "h": lambda: self.r.choice("0123456789abcdef"), "w": self.word}
        return "".join(some[c]() if c in some else c for c in form)

    def word(self) -> str:
        return "".join(self.r.choice(["an", "ter", "lo", "mi", "sha", "ed", "on"]) for _ in range(self.r.randint(1, 3)))

    def phone(self) -> str:
        return self.fill(self.r.choice(["(N##) N##-####", "N##-N##-####", "(N##) N## ####", "N##.N##.####", "1-N##-N##-####", "0N## ### ####", "0N ## ## ## ##", "0## #######", "(0##) ### ## ##", "0###-######", "00## N## ######", "0N.##.##.##.##"]))

    def card(self) -> str:
        n = self.r.choice([16, 16, 16, 15])
        d = self.r.choice("3456") + self.num(n - 2)
        d = next(d + c for c in "0123456789" if luhn(d + c))
        sign = self.r.choice([".", "/", " - ", "  "])
        return sign.join([d[:4], d[4:10], d[10:]] if n == 15 else [d[i : i + 4] for i in range(0, 16, 4)])

    def ip(self) -> str:
        groups = [f"{self.r.getrandbits(16):x}" for _ in range(8)]
        return self.r.choice([":".join(groups), ":".join(g.zfill(4) for g in groups), f"2001:db8:{groups[0]}::{groups[1]}", f"fe80::{':'.join(groups[:4])}", f"{groups[0]}:{groups[1]}::{groups[2]}"])

    def email(self) -> str:
        at = self.r.choice([" [at] ", " (at) ", "[at]", " {at} ", "(@)", " at "])
        dot = " dot " if at == " at " else self.r.choice([" [dot] ", " (dot) ", ".", "[dot]", " dot "])
        host = dot.join([self.word() for _ in range(self.r.choice([1, 1, 2]))] + [self.r.choice(["com", "org", "net", "de"])])
        return f"{self.word()}{self.r.choice(['', '.' + self.word(), self.num(2)])}{at}{host}"

    def secret(self) -> str:
        n = self.r.choice([20, 24, 32, 40, 48, 64])
        alphabet = self.r.choice(["0123456789abcdef", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-"])
        return self.r.choice(["", "", "sk_", "ghp_"]) + "".join(self.r.choice(alphabet) for _ in range(n))

    def other(self) -> str:
        y = self.r.randint(1900, 2100)
        forms = [f"{y}-##-##", "#" * self.r.randint(9, 19), "#,###,###.##", "978-3-##-######-#", f"{y}/##/## ##:##:##", "####-####-####", "### ### ### ###", f"##/##/{y} ####", "#####-####-###", "####.####.####.####", "######/######", f"{y}-{y + 4} ####", "##:##:##", "##:##:##:##", "hh:hh:hh:hh:hh:hh", "#########", "### ### ###", f"## ## ## ## {y}", "w_w_w_w_w_##", "wwwwwwww#", f"{y}{'#' * 10}", "#.########", "###-##-####-##"]
        return self.fill(self.r.choice(forms))

    def checksum(self) -> str:
        return self.r.choice([self.fill("h" * self.r.choice([32, 40, 64])), self.fill("hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh")])

    def sentence(self) -> tuple[str, list[Span]]:
        """A sentence with its spans."""
        text, spans = "", []
        for _ in range(self.r.randint(1, 3)):
            kind = self.r.choice([*KINDS, "secret", "other", "other", "other", "other", "checksum"])
            cued = "other" if kind == "checksum" else kind
            # A secret shows only by what stands before it.
            cue = self.r.choice(CUES[cued]) if self.r.random() < (1 if kind == "secret" else 0.7 if kind == "checksum" else 0.4) else self.word()
            text += f"{self.word()} {self.word()} {cue}"
            text += self.r.choice([" = \"", ": ", "=", " '", " ", ": \""]) if kind in ("secret", "checksum") else self.r.choice([" ", " ", ": "])
            body = getattr(self, kind)()
            if kind not in ("other", "checksum"):
                spans.append((len(text), len(text) + len(body), kind))
            text += body + (text[-1] if text[-1] in "\"'" else "") + self.r.choice([" ", ". ", ", ", "; "])
        return text + self.word(), spans


@cache
def weights() -> Weights:
    """The fitted weights."""
    maker, data = Maker(7), []
    for _ in range(EXAMPLES):
        text, spans = maker.sentence()
        found = candidates(text, 0, len(text), [])
        if found:
            data.append((found, {(a, b, k) for a, b, k, _ in found} & set(spans)))
    w: dict[str, float] = defaultdict(float)
    for t in range(ROUNDS):
        for found, gold in data:
            for name, g in _gradient(found, gold, w).items():
                w[name] += 0.3 / (1 + 0.3 * t) * g
    return Weights({k: round(v, 4) for k, v in w.items() if abs(v) > 0.01})


def added_spans(text: str, base: list[Span], w: Weights) -> list[Span]:
    """Spans of the random field that touch no base span."""
    windows: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - LONGEST), min(len(text), m.end() + LONGEST)
        if windows and a <= windows[-1][1]:
            windows[-1][1] = b
        else:
            windows.append([a, b])
    if not windows:
        return []
    taken: list[tuple[int, int]] = []
    for a, b, _ in sorted(base):
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    starts, ends, out = [a for a, _ in taken], [b for _, b in taken], []
    for a, b in windows:
        found = candidates(text, a, b, taken[bisect_right(ends, a) : bisect_left(starts, b)])
        if found:
            out += decode(found, w)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(text: str | None, w: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by start and then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    extra = added_spans(text, base, w)
    return base, sorted(base + extra, key=_order) if extra else base


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of every row."""
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for t in batch["text"]:
                b, e = find(t.as_py(), w)
                base.append(b)
                every.append(joined(e))
            counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *counts, pa.array(sha, pa.string()), pa.array(every, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None, w: Weights) -> str | None:
    """The text with every span, or run of overlapping spans, as the name of its first kind in angle brackets."""
    spans = find(text, w)[1]
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, and n_chars (if there) as the new length."""
    w = weights()

    @F.pandas_udf("string")
    def hide(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: masked(t, w))

    hide = hide.asNondeterministic()  # so that the text is masked once and not again for its length
    out = docs.withColumn("text", hide("text"))
    out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
