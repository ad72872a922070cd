"""Operator 1: exact n-gram Jaccard join in the metric space of shingle sets.

Method. The Jaccard distance is a metric, so pivots split a set of documents into Voronoi regions, a pair within distance r of each other lies
within 2r of the pivot of either's region, and only documents in that window need a look across the border. Pivots alone don't split a corpus:
nearly all documents share no shingle with a pivot, hence are at distance 1 from it, and every window would hold everything. So the
join starts with regions in which distances say something, and these are exact too:

 1. Signatures. The hash range is cut into m slices, m fixed by a document's size class. A pair with J >= t differs in at most D = (1-t)/t * n
    shingles (n: the smaller size), so if one of the two fills more than D slices, some slice holds equal, non-empty parts of both, and of the
    b slices that a document fills, D + 1 are enough if both choose them in the same order; those with most shingles go first, as
    chance makes few equal. (A document that fills too few slices also signs at twice the slices, and so on.) Documents near a class border
    sign in the next class too.
 2. Regions. Documents with a signature in common are linked in stars, and connected components of the stars are regions: every
    pair above the threshold lies inside one. Equal sets collapse to their smallest doc_id.
 3. Join within a region (`join_region`): pivots are taken until each document lies within r of one; documents that fall to one pivot are linked
    through it, and pairs are compared across regions only inside the 2r window and where no pivot's triangle inequality rules them out.
 4. Regions beyond BOUND documents or shingles are split first, over many tasks. By size: sets of J >= t differ in size by a factor of at most 1/t, so a band
    of sizes and the next one hold all pairs of its own. What is still beyond the bound is split by pivots (`_wide`): all documents are measured against up to PIVOTS
    of them, no two of which are linked. Each document is native to the cell of its nearest pivot, linked with the pivots within r, and replicated as a
    guest into each cell whose pivot is at most 2r farther than its own; pairs are then sought within cells only. A cell that fits a task is joined as in 3, a larger one
    is split again in the same way. Where pivots don't tell documents apart (cells of more than half of a region, or more than twice its documents in all), those beyond r of the pivot that has most
    within r are packed into blocks and meet the blocks of the region; what is within r of it is one component.

Results are exact but for collisions of 64-bit shingle hashes.

Scale: only (signature, doc_id) rows and the texts of documents in regions are shuffled. Copies inside a task are linked before the shuffle, so a text
that a third of all documents copy costs one row a signature and task. No group of documents is held by one task beyond BOUND.

Defined cases: a null or wordless text has an empty set, no link, and is its own component; fewer than k words are one shingle; repeated
doc_ids are one document with the union of their links; a null doc_id takes no part in links and is its own component (null); other columns are ignored; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, U, WordHashes, grams, join_back, materialize, mix, slices, spread, table, tidy, unused
from .components import components

GROWTH, SLACK, BOUND, SHINGLES, PIVOTS, LEVELS, FEW = 1.5, 1.25, 1000, 2_000_000, 8, 8, 200_000
NO_ROWS = np.empty(0, np.uint64)


@cache
def _hashes() -> WordHashes:
    return WordHashes()


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; A-Z lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return NO_ROWS
    s = np.sort(grams(_hashes().of(words), k))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


@cache
def borders(num: int, den: int) -> list[int]:
    """First sizes of the size classes."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of a set; sets with Jaccard >= num/den have one in common."""
    n, first = len(s), borders(num, den)
    if not n:
        return NO_ROWS
    c = int(np.searchsorted(first, n, "right")) - 1
    need, scrambled = (den - num) * n // num + 1, mix(s ^ U(0xA5A5A5A5))
    out = []
    for cls in (c, c + 1) if den * n >= num * first[c + 1] else (c,):
        m = max(1, int(np.ceil((first[cls + 1] - 1) * (den - num) / num * SLACK)))
        level = 0
        while True:
            at = ((s >> U(32)) * U(m)) >> U(32)
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sig = mix(np.add.reduceat(scrambled, starts) + mix(at[starts] + U((cls << 40) + (level << 48) + 1)))
            if len(sig) >= need:
                if len(sig) > need:
                    sizes = np.concatenate([starts[1:], [n]]) - starts
                    key = (np.minimum(sizes, 255).astype(np.uint64) << U(56)) | (sig >> U(8))
                    sig = sig[np.argpartition(key, len(key) - need)[len(key) - need :]]
                out.append(sig)
                break
            out.append(sig)
            level, m = level + 1, 2 * m
    return np.concatenate(out)


def signed(sized: DataFrame) -> DataFrame:
    """(sig, doc): the signatures of measured documents. Equal signatures inside a task meet there: what follows the first is a pair of rows under a signature of
    its own, which links the two documents just as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, docs, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, doc = np.concatenate(sigs), np.concatenate(docs)
            order = np.argsort(sig, kind="stable")
            sig, doc = sig[order], doc[order]
            head = np.concatenate([[True], sig[1:] != sig[:-1]])
            lead = doc[np.flatnonzero(head)[np.cumsum(head) - 1]]
            a, b = np.minimum(lead, doc)[~head], np.maximum(lead, doc)[~head]
            pair = np.unique(np.stack([a, b])[:, a != b], axis=1)
            own = mix(mix(pair[0].astype(np.uint64)) + pair[1].astype(np.uint64) + U(77))
            out_s, out_d = np.concatenate([sig[head], own, own]), np.concatenate([doc[head], pair[0], pair[1]])
            for x in range(0, len(out_s), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(out_s[x : x + 100_000].view(np.int64)), pa.array(out_d[x : x + 100_000])], names=["sig", "doc"])

        for batch in slices(batches):
            lists = batch["sigs"]
            sigs.append(lists.flatten().to_numpy().view(np.uint64))
            docs.append(np.repeat(batch["doc_id"].to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)))
            held += len(sigs[-1])
            if held > 2_000_000:
                yield from flush()
                sigs, docs, held = [], [], 0
        if held:
            yield from flush()
        tidy()

    return sized.where("n_shingles > 0 and doc_id is not null").select("doc_id", "sigs").mapInArrow(run, "sig long, doc long")


def measured(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, and its signatures: texts are cut to shingles once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, f, g, sigs = [], [], [], []
            for t in batch["text"].to_pylist():
                s = shingles(t, k)
                n.append(len(s))
                f.append(int(mix(s).sum(dtype=np.uint64)) if len(s) else 0)
                g.append(int(mix(s ^ U(0x5BD1E995)).sum(dtype=np.uint64)) if len(s) else 0)
                sigs.append(signatures(s, num, den))
            both = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (f, g)]
            ends = pa.array(np.cumsum([0, *map(len, sigs)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([NO_ROWS, *sigs]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), *both, lists], names=["doc_id", "n_shingles", "f", "g", "sigs"])
        _hashes().clear()
        tidy()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f long, g long, sigs array<long>")


class Sets:
    """Sets of a region as rows of one list of entries; overlap of a set with many is one pass over their entries."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.size)])
        self.values, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(len(self.values), np.int32)

    def row(self, i: int) -> np.ndarray:
        return self.ids[self.starts[i] : self.starts[i + 1]]

    def overlap(self, i: int, rows: np.ndarray | None = None) -> np.ndarray:
        """Sizes of the intersections of set i with the given sets, or with all."""
        self.flag[self.row(i)] = 1
        if rows is None:
            out = np.add.reduceat(self.flag[self.ids], self.starts[:-1])
        else:
            out = np.array([self.flag[self.row(r)].sum() for r in rows], np.int64)
        self.flag[self.row(i)] = 0
        return out


def join_region(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set of a region, the first set of its component under Jaccard >= num/den; sets must not be empty."""
    n, r = len(sets), (den - num) / den + 1e-5  # more than the rounding of distances
    all_, top = Sets(sets), np.arange(n)
    near, home, met = np.full(n, np.inf, np.float32), np.full(n, -1), np.zeros(n, bool)
    far = []
    for i in range(n):
        if met[i]:
            continue
        inter = all_.overlap(i)
        union = all_.size + all_.size[i] - inter
        linked = den * inter >= num * union
        distance = (1.0 - inter / union).astype(np.float32)
        home[distance < near] = len(far)
        near, met = np.minimum(near, distance), met | linked
        tops = np.unique(top[linked])
        top[np.isin(top, tops)] = tops[0]
        far.append(distance)
    far_ = np.stack(far)  # pivots x documents
    for p in range(len(far)):
        natives = np.flatnonzero(home == p)
        if len(natives) < 2 or (top == top[0]).all():
            continue  # a pivot on its own has met all others
        for g in np.flatnonzero((far_[p] <= 2 * r) & (home > p)):  # guests: those of later regions inside the window
            rows = natives[top[natives] != top[g]]
            rows = rows[(np.abs(far_[:, rows] - far_[:, [g]]) <= r).all(0)] if len(rows) else rows
            for x, inter in zip(rows, all_.overlap(int(g), rows)):
                if den * inter >= num * (all_.size[g] + all_.size[x] - inter):
                    a, b = sorted((top[g], top[x]))
                    top[top == b] = a
    return top


def _regions(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of consecutive rows with equal keys."""
    key, held = None, []
    for batch in slices(batches):
        names = [batch.schema.names.index(k) for k in keys]
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            now = tuple(row[i] for i in names)
            if now != key and held:
                yield key, held
                held = []
            key = now
            held.append(row)
    if held:
        yield key, held


def _grouped(df: DataFrame, keys: list[str], then: list[str], work) -> DataFrame:
    """The links (a, b) that work(rows) yields for each group of df under keys, in the order of the columns `then`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in _regions(batches, keys):
            for x, y in work(rows):
                a.append(x)
                b.append(y)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        _hashes().clear()
        tidy()

    return df.repartition(spread(df), *keys).sortWithinPartitions(*keys, *then).mapInArrow(run, "a long, b long")


def links(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, bound: int = BOUND, max_shingles: int = SHINGLES) -> tuple[DataFrame, DataFrame]:
    """The measured documents, and links (a, b) whose components are those of all pairs with Jaccard >= num/den."""
    if not 5 * den < 9 * num < 9 * den:
        raise ValueError("the threshold must lie above 5/9 and below 1")
    raw = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    sized = materialize(measured(raw, k, num, den), "jaccard")
    low = F.min("doc").over(Window.partitionBy("sig"))
    stars = signed(sized).withColumn("low", low).where("low < doc").select(F.col("low").alias("a"), F.col("doc").alias("b"))
    region = components(stars, "jaccard-stars").toDF("doc_id", "region")
    sized = sized.drop("sigs")
    return sized, inside(raw, sized, region, k, num, den, bound, max_shingles)


def inside(raw: DataFrame, sized: DataFrame, region: DataFrame, k: int, num: int, den: int, bound: int = BOUND, max_shingles: int = SHINGLES) -> DataFrame:
    """Links (a, b) whose components are those of all pairs with Jaccard >= num/den, where each pair of different sets lies in one region. raw: doc_id, text;
    sized: doc_id, n_shingles, f, g; region: doc_id, region."""
    members = sized.join(region, "doc_id")
    same = members.groupBy("region", "f", "g").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    per = same.groupBy("region").agg(F.count(F.lit(1)).alias("reps"), F.sum("n").alias("all_n")).where("reps > 1")
    reps = materialize(same.join(per, "region").select("rep", "region", "n", ((F.col("reps") > bound) | (F.col("all_n") > max_shingles)).alias("wide")), "jaccard-reps")
    full = sized.where("n_shingles > 0")
    copies = join_back(full, full.groupBy("f", "g").agg(F.min("doc_id").alias("a")), "f", "g").select("a", F.col("doc_id").alias("b")).where("a < b")

    def whole(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        return _found([r[0] for r in rows], [r[2] for r in rows], k, num, den)

    if reps.where("wide").limit(1).count():
        reps = materialize(reps.where("not wide").unionByName(_bands(reps.where("wide"), num, den, bound, max_shingles)), "jaccard-parts")
    tasks, split = (reps.where(x).select("rep", "region", "n") for x in ("not wide", "wide"))
    with_text = lambda some: raw.join(some, raw.doc_id == F.col("rep")).select("rep", "region", "n", "text")
    out = copies.unionAll(_grouped(with_text(tasks).select("rep", "region", "text"), ["region"], [], whole))
    if many := split.count():
        # A few numbers a row: up to FEW rows are sent to the texts, so that these are not shuffled a second time.
        out = out.unionAll(_wide(with_text(F.broadcast(split) if many <= FEW else split), k, num, den, bound, max_shingles))
    return out


def _found(ids: list[int], texts: list[bytes], k: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links of a region: each document with the first of its component."""
    for i, top in enumerate(join_region([shingles(t, k) for t in texts], num, den)):
        if i != top:
            yield ids[top], ids[i]


def _measured_blocks(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Distances `d` of every document of a block from the region's pivots, whether they are linked, `on`, and the pivots linked. Rows (region, block, nr, rep, n, text): pivots
    have a number nr, documents of the block 0; pivots of a region come in one order to each of its blocks."""
    kinds = "region long, rep long, n long, d array<float>, on array<boolean>, pivots array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (region, _), group in _regions(batches, ["region", "block"]):
            pivots = [x for x in group if x[2]]
            docs = [x for x in group if not x[2]]
            if not docs:
                continue
            sets = Sets([shingles(x[5], k) for x in pivots + docs])
            d, on = np.empty((len(docs), len(pivots)), np.float32), np.empty((len(docs), len(pivots)), bool)
            for p in range(len(pivots)):
                inter = sets.overlap(p)
                union = sets.size + sets.size[p] - inter
                d[:, p], on[:, p] = (1.0 - inter / union)[len(pivots) :], (den * inter >= num * union)[len(pivots) :]
            linked = [[pivots[p][3] for p in np.flatnonzero(x)] for x in on]
            cols = [pa.array([region] * len(docs), pa.int64()), pa.array([x[3] for x in docs], pa.int64()), pa.array([x[4] for x in docs], pa.int64()), pa.array(list(d), pa.list_(pa.float32())), pa.array(list(on), pa.list_(pa.bool_())), pa.array(linked, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["region", "rep", "n", "d", "on", "pivots"])
        _hashes().clear()
        tidy()

    dealt = rows.select("region", "block", "nr", "rep", "n", "text").repartition(spread(rows), "region", "block").sortWithinPartitions("region", "block", F.desc("nr"))
    return dealt.mapInArrow(run, kinds)


def _bands(reps: DataFrame, num: int, den: int, bound: int, max_shingles: int) -> DataFrame:
    """(rep, region, n, wide): the regions cut by size; a part holds a band of sizes and the next larger one."""
    # The base exceeds den / num by more than logarithms are rounded.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.0001 * den / num)))
    parts = reps.select("rep", "region", "n", F.inline(F.array(F.struct(band.alias("band"), F.lit(True).alias("native")), F.struct((band - 1).alias("band"), F.lit(False).alias("native")))))
    per = parts.groupBy("region", "band").agg(F.count_if("native").alias("own"), F.count(F.lit(1)).alias("reps"), F.sum("n").alias("all_n")).where("own > 0 and reps > 1")
    cut = join_back(parts, per.drop("own"), "region", "band")
    return cut.select("rep", F.xxhash64("region", "band").alias("region"), "n", ((F.col("reps") > bound) | (F.col("all_n") > max_shingles)).alias("wide"))


def _wide(texts: DataFrame, k: int, num: int, den: int, bound: int, max_shingles: int, level: int = 0) -> DataFrame:
    """Links of regions that no single task may hold. texts: rep, region, n (shingles), text."""
    r = (den - num) / den + 1e-5  # more than the rounding of distances
    blocks_of = lambda count, shingles: F.ceil(F.greatest(count / bound, shingles / max_shingles)).cast("long")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    texts = materialize(texts.select("rep", "region", "n", "text"), "jaccard-wide")
    per = texts.groupBy("region").agg(F.count(F.lit(1)).alias("reps"), blocks_of(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    held = join_back(texts, per, "region").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(level)), F.col("blocks")))
    # Pivots: the first of each of PIVOTS samples of a block, of which the first PIVOTS of a region.
    some = held.groupBy("region", "blocks", "block", F.pmod(F.xxhash64("rep", F.lit(-1 - level)), F.lit(PIVOTS))).agg(F.min(F.struct(F.xxhash64("rep", F.lit(2 + level)).alias("h"), "rep")).alias("p"))
    chosen = some.select("region", "blocks", "p.rep", F.row_number().over(Window.partitionBy("region").orderBy("p.h", "p.rep")).alias("place")).where(F.col("place") <= PIVOTS)
    chosen = materialize(chosen.withColumn("nr", PIVOTS + 1 - F.col("place")), "jaccard-pivots")
    pivots = texts.join(chosen, ["region", "rep"]).withColumn("block", upto("blocks"))
    columns = ["region", "block", "nr", "rep", "n", "text"]
    seen = materialize(_measured_blocks(held.withColumn("nr", F.lit(0)).select(columns).unionByName(pivots.select(columns)), k, num, den), "jaccard-distances")
    out = seen.select(F.explode("pivots").alias("a"), F.col("rep").alias("b")).where("a <> b")
    # A pivot that is linked with an earlier one would only cut a cell of near copies in two.
    own = seen.join(chosen, ["region", "rep"]).where(~F.exists(F.slice("on", 1, F.col("place") - 1), lambda x: x))
    kept = own.groupBy("region").agg(F.array_sort(F.collect_list(F.col("place").cast("int"))).alias("kept"))
    home = F.array_min(F.transform("kept", lambda p: F.struct(F.element_at("d", p).alias("d"), p.alias("p"))))
    near = join_back(seen.drop("pivots"), kept, "region").withColumn("home", home)
    guest = F.transform(F.filter("kept", lambda p: (p != F.col("home.p")) & (F.element_at("d", p) <= F.col("home.d") + 2 * r)), lambda p: F.struct(p.cast("long").alias("cell"), F.lit(True).alias("loose")))
    native = F.array(F.struct(F.col("home.p").cast("long").alias("cell"), (~F.element_at("on", F.col("home.p"))).alias("loose")))
    placed = near.select("region", "rep", "n", F.inline(F.concat(native, guest)))
    cells = placed.groupBy("region", "cell").agg(F.count(F.lit(1)).alias("all"), F.sum("n").alias("all_n"), F.count_if("loose").alias("looses"))
    cells = materialize(cells, "jaccard-cells")
    split = (F.sum("all") <= 2 * F.first("reps")) & (2 * F.max("all") <= F.first("reps")) & F.lit(level < LEVELS)
    regions = cells.join(chosen.select("region").distinct(), "region").join(per, "region").groupBy("region", "blocks").agg(split.alias("split"), F.max_by("cell", F.col("all") - F.col("looses")).alias("main"))
    regions = materialize(regions, "jaccard-ways")

    if regions.where("split").limit(1).count():
        small = (F.col("all") <= bound) & (F.col("all_n") <= max_shingles)
        parts = cells.join(regions.where("split").select("region"), "region").where("looses > 0").select("region", "cell", small.alias("small"))
        rows = texts.select("region", "rep", "text").join(join_back(placed, parts, "region", "cell"), ["region", "rep"])
        rows = rows.select("rep", F.xxhash64("region", "cell", F.lit(level)).alias("region"), "text", "n", "small")

        def whole(rows: list[tuple]) -> Iterator[tuple[int, int]]:
            return _found([x[0] for x in rows], [x[2] for x in rows], k, num, den)

        out = out.unionAll(_grouped(rows.where("small"), ["region"], [], whole))
        if parts.where("not small").limit(1).count():
            out = out.unionAll(_wide(rows.where("not small"), k, num, den, bound, max_shingles, level + 1))

    if regions.where("not split").limit(1).count():
        rows = join_back(seen.select("region", "rep", "n", "on"), regions.where("not split").drop("split"), "region").select("region", "blocks", "rep", "n", (~F.element_at("on", F.col("main").cast("int"))).alias("loose"))
        grids = rows.where("loose").groupBy("region").agg(blocks_of(F.count(F.lit(1)), F.sum("n")).alias("grids"))
        rows = texts.select("region", "rep", "text").join(join_back(rows, grids, "region"), ["region", "rep"])
        left = rows.where("loose").withColumn("grid", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("grids"))).withColumn("block", upto("blocks"))
        right = rows.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks"))).withColumn("grid", upto("grids"))
        keys = ["region", "grid", "block"]

        def compare(rows: list[tuple]) -> Iterator[tuple[int, int]]:
            # A loose document may be on both sides.
            each = {x[3]: x[4] for x in rows}
            return _found(list(each), list(each.values()), k, num, den)

        out = out.unionAll(_grouped(left.select(*keys, "rep", "text").unionByName(right.select(*keys, "rep", "text")), keys, [], compare))
    return out


def connected(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, **how) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that links reach."""
    sized, found = links(docs, k, num, den, **how)
    groups = components(found, "jaccard-links").toDF("node", "component")
    return sized.join(groups, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, **how) -> DataFrame:
    """docs without those whose component holds a smaller doc_id."""
    name = unused("_later", docs)
    later = connected(docs, k, num, den, **how).where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(later, F.col("doc_id") == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACE}]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = s.doc_id
"""
