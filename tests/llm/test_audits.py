"""Operators 11 to 13 against brute-force versions and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_components, corpus, docs, near, prose, word_sets
from urlmill.llm import divergence, minhash, trie

# ---- 11

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute_audit(rows, least, top=10):
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    rows = [(lang or "", source or "", TERM.findall(lower(t))) for lang, source, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for r in own for t in set(r[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        groups = {s: Counter(t for r in own if r[1] == s for t in r[2] if t in set(kept)) for s in {r[1] for r in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s], "term": [(t, f(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, i + 1) for i, x in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


AUDIT = "lang string, source string, text string, term string, n long, docs int, value string"


def audited(spark, rows, **how):
    return sorted(map(tuple, divergence.audit(spark.createDataFrame([(*r, "x", 1, 2, "v") for r in rows], AUDIT), **how).collect()))


@pytest.mark.parametrize("least,held", [(1, 300_000), (3, 5), (1000, 300_000)])
def test_divergence(spark, monkeypatch, least, held):
    monkeypatch.setattr(divergence, "HELD", held)
    r = random.Random(3)
    vocab = [f"{a}{b}" for a in ("a", "Ab", "é", "ÉA", "b", "漢", "Z") for b in ("", "q", "é")]
    rows = [(r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "S", "é", None]), " 1-".join(r.choices(vocab, weights=range(1, 22), k=r.randint(0, 30)))) for _ in range(150)]
    rows += rows[:5] + [("fr", "only", "one two two"), ("xx", "a", None), ("xx", "b", ""), ("xx", "c", "12 \x00 [`{\x7f"), ("en", "huge", "word " * 100_000)]
    assert audited(spark, rows, least=least) == brute_audit(rows, least)


def test_divergence_ties_and_top(spark):
    """Terms of one vector, more than the top holds, rank by their UTF-8 bytes."""
    names = [f"t{chr(97 + i)}" for i in range(20)] + ["é", "zz", "\U0001f600", "～"]
    rows = [("en", "a", " ".join(names)), ("en", "b", "other"), ("en", "a", "other other")]
    got = audited(spark, rows, least=1)
    assert got == brute_audit(rows, 1) and [x[3] for x in got if x[2] == "term" and x[1] == "a"] == sorted(names, key=str.encode)[:10]


def test_shares_are_exact(spark):
    """Counts whose products need more than 64 bits."""
    counts = [(n, t, v) for n in (0, 1, 7, 10**10, 4 * 10**12) for t in (4 * 10**12, 10**13 + 7) for v in (1, 3, 10**9)]
    df = spark.createDataFrame(counts, "n long, t long, v long").select("*", divergence.share(F.col("n"), F.col("t"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.n + 2) // (r.t + 2 * r.v) for r in df.collect())


# ---- 12


def brute_trie(rows, family=trie.FAMILY, heads=trie.HEADS):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    full = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        full[c] = tuple(turns.get(c - c % family, [])[:h] + own[h:])
    nodes = {}
    for c, s in full.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    ends = {k: ",".join(str(c) for c in sorted(m) if full[c] == k) for k, m in nodes.items()}
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in nodes.items())


CONV = "conv_id long, turn long, role string, text string, place string, h1 int, depth string, x1 string"


def tried(spark, rows):
    d = spark.createDataFrame([(*r, "p", 1, "d", "x") for r in rows], CONV)
    turns = trie.hashed(d)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.trie(trie.rebuilt(turns), turns.select("conv_id").distinct()).collect())


@pytest.mark.parametrize("piece,chunk", [(4096, 4096), (3, 4)])
def test_trie(spark, monkeypatch, piece, chunk):
    monkeypatch.setattr(trie, "PIECE", piece)
    monkeypatch.setattr(trie.ends_hashed, "__defaults__", (piece,))
    monkeypatch.setattr("urlmill.llm.chat.CHUNK", chunk)
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", None, ""]) if t % 3 == 2 else "user", f"t{r.choice([0, 0, 1])}-{t}é" if t % 4 else None) for c in range(90, 240) for t in range(r.randint(1, 8))]
    rows += [(c, t, "user", "same") for c in (1003, 1007, 1099, 1100) for t in range(40)]  # deep, and a family without its lead
    rows += [(2000, 1, "a", "q"), (2000, 1, "a", "p"), (2000, None, "b", "z"), (2000, 1, "a", "p"), (2001, 5, None, None), (None, 1, "a", "x"), (-5, 1, "a", "b"), (-205, 2, "a", "b"), (2050, 1, "user", "long " * 50_000)]
    assert tried(spark, rows) == brute_trie(rows)


def test_trie_of_copies(spark):
    """One conversation under many ids, whose list of ends goes through several pieces."""
    rows = [(c, t, "user", f"t{t}") for c in range(6000) for t in (0, 1)]
    got = tried(spark, rows)
    assert got == brute_trie(rows) and max(x[3] for x in got) == 6000


# ---- 13


@pytest.mark.parametrize("block,bound", [(1000, 2000), (2, 3)])
def test_minhash(spark, block, bound):
    texts = corpus()
    sets = word_sets(texts, 5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.connected(docs(spark, texts), block=block, bound=bound).collect()}
    assert got == {i: (len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, brute_components(sets, 85, 100)))}


@pytest.mark.parametrize("block", [1000, 4])
def test_minhash_near_the_threshold(spark, block):
    """Many pairs just above and below the threshold, a frequent passage in most documents."""
    r, texts, shared = random.Random(5), [], prose(77, 70, 4000)
    for g in range(12):
        base = prose(300 + g, r.choice([30, 60, 150]), 4000)
        texts += [" ".join(near(1000 * g + i, base, r.choice([0.004, 0.01, 0.02])) + (shared if i % 3 else [])) for i in range(14)]
    sets = word_sets(texts, 5)
    want = brute_components(sets, 85, 100)
    assert [r.component_id for r in minhash.connected(docs(spark, texts), block=block).orderBy("doc_id").collect()] == want and 20 < len(set(want)) < len(texts)


def test_minhash_odd_rows(spark):
    d = docs(spark, ["a b c d e f g"] * 2 + ["x y z"])
    d = d.unionByName(d).unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.connected(d).collect())
    assert got == {(0, 0, True): 2, (1, 0, False): 2, (2, 2, True): 2, (None, None, True): 1}
    kept = minhash.deduplicated(d)
    assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == {0: 2, 2: 2, None: 1}


def test_signatures_agree_as_often_as_sets_overlap():
    r = np.random.default_rng(4)
    for share in (0.5, 0.85):
        seen = []
        for n in (40, 400):
            for _ in range(150):
                x = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
                cut = round(2 * n * (1 - share) / 2)
                seen.append((minhash.signature(x[cut:]) == minhash.signature(x[: 2 * n - cut])).sum())
        j = (2 * n - 2 * cut) / (2 * n)
        assert abs(np.mean(seen) / minhash.COORDS - j) < 0.02 and abs(np.std(seen) - (minhash.COORDS * j * (1 - j)) ** 0.5) < 0.6


def test_ties_within_lists_connect_all_retained_pairs():
    r = np.random.default_rng(1)
    for _ in range(30):
        cell = np.sort(r.integers(0, 4, 60))
        low = r.integers(0, 3, (60, minhash.COORDS), dtype=np.uint8)
        for i in range(60):
            if r.random() < 0.7:
                low[i] = low[r.integers(0, 60)]
                low[i, : r.integers(0, 60)] = 9
        same = [(i, j) for i in range(60) for j in range(i) if cell[i] == cell[j] and (low[i] == low[j]).sum() >= 32]
        a, b = minhash.tied(cell, low, 32)
        assert all(cell[x] == cell[y] for x, y in zip(a, b))

        def tops(pairs):
            top = list(range(60))
            for x, y in pairs:
                u, v = sorted((top[x], top[y]))
                top = [u if t == v else t for t in top]
            return top

        assert tops(same) == tops(zip(a, b))


# ---- the pipeline on odd rows


def test_pipeline_odd_rows(spark, sf, tmp_path):
    """Null and empty texts, null and repeated doc_ids, repeated rows, null languages and sources, columns with clashing names; and empty tables."""
    import corpus_pipeline as c

    good = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (1000, "", "en", "s", 0), (1001, " \n", None, None, 2), (1002, None, "en", None, None), (None, "a b", "en", "s", 3)], good.schema)
    docs_ = good.unionByName(odd).unionByName(good.limit(3)).withColumns({"row": F.lit(1), "f": F.lit("x"), "copies": F.lit(2), "h": F.lit("h")})
    docs_.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = c.run(spark, str(tmp_path))
    rows = out.collect()
    assert rows and set(docs_.columns) <= set(out.columns) and all(r.exact and r.row == 1 and r.f == "x" and r.copies == 2 for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in good.collect()}
    docs_.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert c.run(spark, f"{tmp_path}/none").count() == 0


def test_html_short_own_text_beside_a_longer_equal_notice():
    from urlmill.llm import html

    notice = "This town publishes its notes without any warranty of being right or complete at any time."
    page = "<html><body><div><div>{}</div><div>{}</div></div></body></html>"
    pages = [page.format(f"Meeting of day {i}", notice) for i in range(12)]
    assert html.extract(pages) == [f"Meeting of day {i}" for i in range(12)]
    # Versions of one article keep what they share.
    article = "<html><body><div>{}</div></body></html>"
    same = "".join(f"<p>Paragraph {i} of the one report.</p>" for i in range(9))
    got = html.extract([article.format(f"{same}<p>Version {i}</p>") for i in range(12)])
    assert all("Paragraph 4 of the one report." in t and f"Version {i}" in t for i, t in enumerate(got))


def test_html_nested_lists_take_linear_time():
    import time

    from urlmill.llm import html

    def seconds(n):
        began = time.perf_counter()
        assert html.extract(["<ul><li></li><li>" * n + "x"]) == ["x"]
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 16 * max(seconds(2_000), 0.02)


def test_html_menu_lists_by_bottom_up_marks():
    from urlmill.llm import html

    r = random.Random(5)

    def item(depth):
        parts = [r.choice(("", " ", "t", "<a>l</a>", "<a><b>l</b></a>", "<b> </b>", "<form>f</form>")) for _ in range(2)]
        if depth and r.random() < 0.6:
            parts.append("<ul>" + "".join(f"<li>{item(depth - 1)}</li>" for _ in range(r.randint(0, 3))) + "</ul>")
        return "".join(parts)

    def plain(x):  # from the definition, top down
        return not x.isspace() and x != "" if isinstance(x, str) else x.tag != "a" and not x.skip and any(map(plain, x.kids))

    for _ in range(300):
        top = html.parse(f"<ul><li>{item(4)}</li></ul>")
        marks, todo = html._plain(top), [top]
        while todo:
            x = todo.pop()
            assert (id(x) in marks) == plain(x)
            todo += [k for k in x.kids if not isinstance(k, str)]


def test_html_groups_are_bounded_by_characters(spark):
    from urlmill.llm import html

    assert [html.group_end(*x) for x in (([5, 5, 5], 2, 100), ([5, 5, 5], 9, 10), ([50, 5], 9, 10), ([4, 4, 4], 9, 11), ([1], 9, 10), ([0] * 5, 3, 0))] == [2, 2, 1, 2, 1, 3]
    rows = [(i, f"https://h{i % 2}.org/{i}", f"<article><p>Text {i}</p></article>" * (1 + i % 5)) for i in range(60)] + [(99, "https://h0.org/", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in html.extract_pages(d).collect()}
    assert len(whole) == 61 and {r.page_id: r.text for r in html.extract_pages(d, chars=300).collect()} == whole == {r.page_id: r.text for r in html.extract_pages(d, chars=1).collect()}
