"""Near-duplicate classes by a T-occurrence n-gram Jaccard join.

Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets. Linked sets share at least
T(n) = ceil(percent * n / 100) shingles for the size n of either one, which drives every step:

1. Rows with equal sets become one class with a number of its own.
2. Each class sends the n - T(n) + e(n) smallest of its shingle hashes, e(n) = max(1, 0.15 n). Linked classes share at
   least r(n) = e(T(n)) of them, for the size n of either one, so a class that shares fewer has no link and drops out;
   that is repeated as long as classes drop out, at most `PRUNINGS` times. Hashes are dealt by ranges of (hash, class),
   which splits hashes of any frequency.
3. A class keeps all but the r - 1 most frequent of its shared hashes. The rarest hash that two linked classes share has
   r - 1 more frequent shared ones in both, so both keep it. Classes with a common kept hash are joined to blocks
   (connected components, each hash linking its classes to the smallest one).
4. In a block the T-occurrence search runs over inverted lists, class by class in order of size: the sorted short lists
   are merged and counted, classes that can still reach T are probed in the few long lists by binary search (DivideSkip),
   and the exact overlap decides. Classes that are connected already are not probed. Blocks above `UNIT` shingles are cut
   into parts, and every pair of parts is a unit of its own.
5. Components of the links, and of the ids whose rows are in several of them, give the result.

Nothing is capped or sampled. Defined cases: null and empty texts have the empty set and link with nothing; texts with
fewer words than a shingle are one shingle; rows with one doc_id are one document with the links of each; null doc_ids
count as one document, named null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelore.llm.common import cut_lineage, large, partitions
from sitelore.llm.fingerprints import mix
from sitelore.llm.words import shingle_sets
from sitelore.operators.quality import connected_components

PRUNINGS = 3
#: shingles of a block that one search holds
UNIT = 4_000_000
_NULL = -(1 << 63)


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _extra(n: int) -> int:
    return max(1, 15 * n // 100)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def _sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large(batches, "text", 2 << 20):
            sets = shingle_sets(_texts(batch), words)
            sizes = [len(s) for s in sets]
            sums = np.array([[mix(s + np.uint64(k)).sum(dtype=np.uint64) for k in (1, 2)] for s in sets], np.uint64)
            sent = [s[:n - _needed(n, percent) + _extra(n)] for s, n in zip(sets, sizes)]
            flat = np.concatenate(sent).view(np.int64)
            yield pa.record_batch([
                batch.column("doc_id"), batch.column("t"), pa.array(sizes, pa.int64()), pa.array(sums.view(np.int64)[:, 0].copy()),
                pa.array(sums.view(np.int64)[:, 1].copy()),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in sent])], pa.int32()),
                                         pa.array(flat))], ["doc_id", "t", "n", "h1", "h2", "sent"])

    return docs.mapInArrow(run, "doc_id long, t long, n long, h1 long, h2 long, sent array<long>")


def _repeated(sent: DataFrame) -> DataFrame:
    """Rows (hash, rep) of sorted ranges without the hashes that occur once; hashes at the edges of a range stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None  # the last hash's rows so far: all of them, or two when there are more
        first = True

        def batch_of(rows: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], ["hash", "rep"])

        for batch in batches:
            rows = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            if not len(rows):
                continue
            if rest is not None:
                rows = np.vstack([rest, rows])
            new = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
            begin = np.flatnonzero(new)
            length = np.diff(np.r_[begin, len(rows)])
            keep = length > 1
            if first:  # the range's first hash may go on in the range before
                keep[0] = True
                first = len(begin) == 1
            if length[-1] > 1:  # known to repeat: all but one row of it can go on
                out = np.repeat(keep, length)
                out[-1] = False
                held = rows[-1:]
                # its last row is marked to stay by being sent with a copy
                yield batch_of(rows[out])
                rest = np.vstack([held, held])
            else:
                keep[-1] = False
                yield batch_of(rows[np.repeat(keep, length)])
                rest = rows[-1:]
        if rest is not None:  # the range's last hash may go on in the next one
            yield batch_of(rest[:1])

    return sent.mapInArrow(run, "hash long, rep long").distinct()


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def search(ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], percent: int, across: bool) -> list[tuple[int, int]]:
    """Links that connect the linked sets, found by T-occurrence search. `across` asks for pairs of two parts only."""
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), int(ids[k])))
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    part = parts[order]
    tokens = np.concatenate([sets[k] for k in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    by_token = np.argsort(tokens, kind="stable")  # lists come out ascending in size order
    _, number, length = np.unique(tokens, return_inverse=True, return_counts=True)
    lists = owner[by_token]
    begin = np.cumsum(length) - length
    # the place of each entry in its own list: entries in front of it belong to smaller sets
    at = np.empty(len(tokens), np.int64)
    at[by_token] = np.arange(len(tokens))
    forest = _Forest(len(order))
    links: list[tuple[int, int]] = []
    stops = np.cumsum(sizes)
    floor = np.searchsorted(sizes * 100, percent * sizes)  # the first set that is large enough for x
    for x in range(len(order)):
        n = int(sizes[x])
        if floor[x] >= x or not n:
            continue
        own = slice(int(stops[x] - n), int(stops[x]))
        starts, ends = begin[number[own]], at[own]
        # the part of each list between the smallest partner and x itself
        lengths = ends - starts
        some = lengths > 0
        need = _needed(n, percent)
        if int(some.sum()) < need:
            continue
        starts, ends, lengths = starts[some], ends[some], lengths[some]
        longest = int(lengths.max())
        long = min(need - 1, int(need / (0.05 * np.log2(longest + 1) + 1))) if longest > 8 else 0
        rank = np.argsort(lengths, kind="stable")
        short = rank[:len(rank) - long]
        # merge the sorted short lists and count equal neighbours
        total = int(lengths[short].sum())
        shift = np.repeat(starts[short] - np.r_[0, np.cumsum(lengths[short])[:-1]], lengths[short])
        merged = np.sort(lists[np.arange(total) + shift], kind="stable")
        merged = merged[np.searchsorted(merged, floor[x]):]
        if not len(merged):
            continue
        edge = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]])
        count = np.diff(np.r_[edge, len(merged)])
        fit = count >= need - long
        found, count = merged[edge][fit], count[fit]
        if across:
            found, count = found[part[found] != part[x]], count[part[found] != part[x]]
        root = forest.find(x)
        apart = np.array([forest.find(int(y)) != root for y in found], bool)
        found, count = found[apart], count[apart].copy()
        for k in rank[len(rank) - long:]:  # probe the long lists by binary search
            if not len(found):
                break
            one = lists[starts[k]:ends[k]]
            place = np.minimum(np.searchsorted(one, found), len(one) - 1)
            count += one[place] == found
        good = 100 * count >= percent * (n + sizes[found] - count)
        for y in found[good]:
            if forest.join(x, int(y)):
                links.append((int(ids[order[x]]), int(ids[order[int(y)]])))
    return links


def _units(rows: DataFrame, percent: int) -> DataFrame:
    """Links (id_a, id_b) of rows (unit, across, part, rep, shingles) sorted by unit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        unit, across = None, False

        def close() -> pa.RecordBatch:
            links = search(np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held]),
                           [np.frombuffer(h[2], np.uint64) for h in held], percent, across)
            return pa.record_batch([pa.array([a for a, _ in links], pa.int64()),
                                    pa.array([b for _, b in links], pa.int64())], ["id_a", "id_b"])

        for batch in large(batches, "shingles"):
            for u, a, p, r, s in zip(*(batch.column(k).to_pylist() for k in ("unit", "across", "part", "rep", "shingles"))):
                if u != unit and held:
                    yield close()
                    held = []
                unit, across = u, a
                held.append((r, p, s))
        if held:
            yield close()

    return rows.mapInArrow(run, "id_a long, id_b long")


def classes(docs: DataFrame, words: int = 4, percent: int = 85, unit: int = UNIT) -> DataFrame:
    """(doc_id, n_shingles, component_id, copies) for rows (doc_id, text); copies counts the rows of the id."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), "text",
                       F.xxhash64("text").alias("t"))
    sketches = cut_lineage(_sketches(docs, words, percent))
    # an id may have rows of different sets: classes have numbers, and (doc_id, t) finds the text of one row of each
    equal = cut_lineage(sketches.filter("n > 0").groupBy("n", "h1", "h2").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("t", "doc_id").alias("t"))
        .withColumn("rep", F.monotonically_increasing_id()))
    nodes = cut_lineage(sketches.select("doc_id", "n", "h1", "h2").join(
        equal.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"], "left").select("doc_id", "n", "rep"))
    reps = equal.select("rep", "n")
    sent = (sketches.join(equal, ["n", "h1", "h2", "doc_id", "t"])
            .select(F.explode("sent").alias("hash"), "rep"))
    ranges = sent.repartitionByRange(partitions(docs), "hash", "rep").sortWithinPartitions("hash", "rep")
    shared = cut_lineage(_repeated(ranges))

    least = F.greatest(F.lit(1), F.expr(f"(15 * (({percent} * n + 99) div 100)) div 100"))
    rows, left = shared, -1
    for _ in range(PRUNINGS):
        many = rows.groupBy("hash").agg(F.count("*").alias("df")).filter("df > 1")
        counted = rows.join(many, "hash")
        able = counted.groupBy("rep").agg(F.count("*").alias("c")).join(reps, "rep").filter(F.col("c") >= least)
        able = cut_lineage(able.select("rep", "n", "c"))
        rows = cut_lineage(counted.join(able.select("rep"), "rep", "left_semi").select("hash", "rep"))
        before, left = left, able.count()
        if left == before:
            break
    many = rows.groupBy("hash").agg(F.count("*").alias("df")).filter("df > 1")
    each = Window.partitionBy("rep")
    routed = (rows.join(many, "hash").join(able.select("rep", "n"), "rep")
              .withColumn("c", F.count("*").over(each))
              .withColumn("k", F.row_number().over(each.orderBy("df", "hash")))
              .filter(F.col("k") <= F.col("c") - least + 1).select("hash", "rep"))
    routed = cut_lineage(routed)
    hubs = routed.groupBy("hash").agg(F.min("rep").alias("hub"), F.count("*").alias("df")).filter("df > 1")
    edges = (routed.join(hubs, "hash").filter("rep != hub")
             .select(F.col("hub").alias("id_a"), F.col("rep").alias("id_b")).distinct())
    blocks = connected_components(edges).join(able.select(F.col("rep").alias("id"), "n"), "id")
    whole = blocks.groupBy("component").agg(F.sum("n").alias("total"))
    cuts = F.when(F.col("total") <= unit, 1).otherwise(F.ceil(F.col("total") * 2 / unit)).cast("int")
    placed = (blocks.join(whole.select("component", cuts.alias("cuts")), "component")
              .withColumn("part", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
              .select("id", "component", "part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
              .select(F.col("id").alias("rep"), "part", (F.col("part") != F.col("other")).alias("across"), F.xxhash64(
                  "component", F.least("part", "other"), F.greatest("part", "other")).alias("unit")))
    routes = placed.groupBy("rep").agg(F.collect_list(F.struct("unit", "across", "part")).alias("routes"))
    routes = routes.join(equal.select("rep", "doc_id", "t"), "rep")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large(batches, "text", 2 << 20):
            sets = [s.tobytes() for s in shingle_sets(_texts(batch), words)]
            yield pa.record_batch([batch.column("rep"), batch.column("routes"), pa.array(sets, pa.binary())],
                                  ["rep", "routes", "shingles"])

    kind = "array<struct<unit:long,across:boolean,part:int>>"
    sets = (docs.join(routes, ["doc_id", "t"]).select("rep", "routes", "text")
            .mapInArrow(shingled, f"rep long, routes {kind}, shingles binary")
            .select(F.inline("routes"), "rep", "shingles"))
    links = _units(sets.repartition(partitions(docs), "unit").sortWithinPartitions("unit", "rep"), percent)
    links = links.filter("id_a != id_b")
    found = connected_components(links).withColumnRenamed("id", "rep")
    # a component is named by its smallest id; ids with rows in several components join them
    grouped = (nodes.filter("rep is not null").join(found, "rep", "left")
               .select("doc_id", "n", F.coalesce("component", "rep").alias("group")))
    names = grouped.groupBy("group").agg(F.min("doc_id").alias("name"))
    named = cut_lineage(grouped.join(names, "group").select("doc_id", "n", "name").unionByName(
        nodes.filter("rep is null").select("doc_id", "n", F.lit(None).cast("long").alias("name"))))
    out = cut_lineage(named.groupBy("doc_id").agg(
        F.max("n").alias("n_shingles"), F.coalesce(F.min("name"), F.col("doc_id")).alias("component_id"),
        F.count("*").alias("copies"), F.max("name").alias("other")))
    several = out.filter("other > component_id")
    if several.limit(1).count():
        edges = (named.join(several.select("doc_id", "component_id"), "doc_id").filter("name > component_id")
                 .select(F.col("component_id").alias("id_a"), F.col("name").alias("id_b")).distinct())
        wider = connected_components(edges).select(F.col("id").alias("component_id"), "component")
        out = out.join(wider, "component_id", "left").withColumn("component_id", F.coalesce("component", "component_id"))
    null = F.lit(_NULL)
    return out.select(F.nullif("doc_id", null).alias("doc_id"), "n_shingles",
                      F.nullif("component_id", null).alias("component_id"), "copies")


def op8_ngram_join(docs: DataFrame) -> DataFrame:
    """One row per document; rows with one doc_id are one document."""
    return classes(docs, 4, 85).select("doc_id", "n_shingles", "component_id")
