"""HTML of pages: cleaning, structural signals, text nodes, page scores, RDAP records. Parsing runs in vectorised Python; regex twins are JVM-side."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content no reader sees.
DROPPED = ("script", "style", "svg", "template", "noscript")
SIGNALS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("forms", "password_inputs", "inputs", "links", "iframes")])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def clean_regex(html: Column) -> Column:
    """html without comments and dropped elements, by regular expressions."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def signals_regex(html: Column) -> Column:
    """struct(forms, password_inputs, inputs, links, iframes) of cleaned html, by regular expressions."""
    n = lambda p: F.regexp_count(html, F.lit(p)).cast("int")
    return F.struct(n(r"(?i)<form\b").alias("forms"), n(r"(?i)<input\b[^>]*\btype\s*=\s*[\"']?password").alias("password_inputs"), n(r"(?i)<input\b").alias("inputs"), n(r"(?i)<a\b[^>]*\bhref").alias("links"), n(r"(?i)<iframe\b").alias("iframes"))


class _Reader(HTMLParser):
    """Walks a page and keeps counts and text nodes with their paths."""

    def __init__(self, dropped: tuple = DROPPED):
        super().__init__(convert_charrefs=True)
        self.dropped, self.hidden = dropped, 0
        self.counts = dict.fromkeys(("forms", "password_inputs", "inputs", "links", "iframes"), 0)
        self.path: list[tuple[str, int]] = []
        self.seen: list[dict[str, int]] = [{}]
        self.nodes: list[tuple[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.dropped:
            self.hidden += 1
            return
        if self.hidden:
            return
        named = {k: (v or "") for k, v in attrs}
        for key, on in (("forms", tag == "form"), ("inputs", tag == "input"), ("password_inputs", tag == "input" and named.get("type", "").lower() == "password"), ("links", tag == "a" and "href" in named), ("iframes", tag == "iframe")):
            self.counts[key] += on
        n = self.seen[-1][tag] = self.seen[-1].get(tag, 0) + 1
        if tag not in VOID:
            self.path.append((tag, n))
            self.seen.append({})

    def handle_endtag(self, tag: str) -> None:
        if tag in self.dropped:
            self.hidden = max(0, self.hidden - 1)
            return
        if not self.hidden and any(t == tag for t, _ in self.path):
            while self.path:
                t, _ = self.path.pop()
                self.seen.pop()
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.hidden and (text := " ".join(data.split())):
            self.nodes.append((text, "/" + "/".join(f"{t}[{n}]" for t, n in self.path)))


def _read(html: str | None) -> _Reader | None:
    if html is None:
        return None
    r = _Reader()
    r.feed(html)
    r.close()
    return r


@F.pandas_udf(SIGNALS)
def signals(html):  # noqa: ANN001, ANN201
    """Structural signals of pages, read by a parser."""
    import pandas as pd

    return pd.DataFrame([(_read(h) or _Reader()).counts for h in html])


def text_nodes(pages: DataFrame, most: int = 0) -> DataFrame:
    """page_id, ordinal, text, xpath of every page's text nodes, at most `most` a page (0: all); parsing failures give no rows. Pages go through Python in Arrow batches."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        names, kinds = ["page_id", "ordinal", "text", "xpath"], [pa.int64(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist()):
                r = _read(html)
                nodes = r.nodes if r else []
                rows += [(page, i, text, path) for i, (text, path) in enumerate(nodes[:most] if most else nodes)]
            for a in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 50_000]), kinds)], names=names)

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, ordinal int, text string, xpath string")


def logistic_score(features: dict[str, tuple[Column, float]], bias: float) -> Column:
    """A page score from weighted columns; the place where a served model plugs in."""
    total = F.lit(bias)
    for c, w in features.values():
        total = total + F.lit(w) * c
    return 1 / (1 + F.exp(-total))


RDAP = "entities array<struct<roles: array<string>, vcardArray: string>>, events array<struct<eventAction: string, eventDate: string>>, nameservers array<struct<ldhName: string>>, status array<string>"


def registration(record: Column) -> Column:
    """struct(registrar, created, expires, nameservers) of an RDAP record: the first name of the last registrar, dates that parse, at most 12 name servers."""
    r = F.from_json(record, RDAP)
    registrar = F.try_element_at(F.filter(r["entities"], lambda e: F.array_contains(e.roles, "registrar")), F.lit(-1))
    when = lambda a: F.try_to_timestamp(F.get(F.transform(F.filter(r["events"], lambda e: e.eventAction == a), lambda e: e.eventDate), 0))
    return F.struct(
        F.nullif(F.regexp_extract(registrar["vcardArray"], r'\["fn",\s*\{[^}]*\},\s*"[^"]*",\s*"([^"]*)"', 1), F.lit("")).alias("registrar"),
        when("registration").alias("created"), when("expiration").alias("expires"),
        F.slice(F.transform(r["nameservers"], lambda n: F.lower(n.ldhName)), 1, 12).alias("nameservers"),
    )
