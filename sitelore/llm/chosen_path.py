"""Near-duplicate classes by a chosen-path set similarity join.

1. Rows with equal shingle sets become one class. A class has `MINS` minwise tokens, the smallest shingle under as many
   hash functions.
2. `TREES` independent trees branch the classes. The root chooses two of the minwise tokens, its children one, every
   other node one or two (a hash of the node decides which), and classes with the same token go to the same child;
   classes of Jaccard similarity s stay together with probability s a branch. The first two levels are branched at once.
   Children of one class end their path. A node of at most `SMALL` classes is not branched further, nor is one of depth
   `DEPTH` + 1. A larger node is first compared with one of its classes, which settles nodes of near copies at once.
3. The classes of a node are compared exhaustively by their minwise tokens. Pairs that agree in `percent` less `MARGIN`
   percent of them are candidates (a pair at the threshold is below that with a probability of about 5e-6); a node
   yields only candidates that connect classes it has not connected before. Small nodes with the same classes are
   compared once. A pair of similarity 0.8 meets in no node with a probability of 0.36^16 < 1e-7 where its nodes are small
   and about 1e-4 where all of them need the full depth.
4. Components of the candidates are blocks. In a block all pairs of classes that are candidates and not yet connected are
   compared on the full shingle sets, and those that reach `percent` link.
5. Components of the links, and of ids whose rows are in several of them, give the result.

A node or block that is too large for one task is cut into parts that all hold its first classes, too. Those connect
nearly all parts of a group of near copies; what is left over, outside the largest component, is then compared with every
part. So no pair is left out, and a group of near copies is not compared pair by pair.

Nothing is capped or sampled. Defined cases: null and empty texts have the empty set and link with nothing; texts with
fewer words than a shingle are one shingle; rows with one doc_id are one document with the links of each; null doc_ids
(and the smallest long) count as one document, named null and kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelore.llm.common import cut_lineage, large, partitions
from sitelore.llm.components import components
from sitelore.llm.fingerprints import mix
from sitelore.llm.words import shingle_sets

MINS, TREES, DEPTH, SMALL, MARGIN, CLOSE = 64, 8, 3, 256, 24, 59
#: classes of a node, and shingles of a block, that one task holds
NODE_UNIT, BLOCK_UNIT = 10_000, 4_000_000
PIVOTS = 4
_NULL = -(1 << 63)
_SALT = mix(np.arange(1, 2 * MINS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_ODD = _SALT[MINS:] | np.uint64(1)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, MINS) uint32: the high half of each set's smallest hash under MINS functions; empty sets have zeros."""
    out = np.zeros((len(sets), MINS), np.uint32)
    some = [k for k, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[k] for k in some])
        begin = np.r_[0, np.cumsum([len(sets[k]) for k in some])[:-1]]
        for k in range(MINS):
            out[some, k] = np.minimum.reduceat((flat ^ _SALT[k]) * _ODD[k], begin) >> np.uint64(32)
    return out


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large(batches, "text", 4 << 20):
            sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], words)
            sums = np.array([[mix(s + np.uint64(k)).sum(dtype=np.uint64) for k in (3, 4)] for s in sets], np.uint64)
            yield pa.record_batch([
                batch.column("doc_id"), batch.column("t"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(sums.view(np.int64)[:, 0].copy()), pa.array(sums.view(np.int64)[:, 1].copy()),
                pa.array([m.tobytes() for m in minwise(sets)], pa.binary())], ["doc_id", "t", "n", "h1", "h2", "mins"])

    return docs.mapInArrow(run, "doc_id long, t long, n long, h1 long, h2 long, mins binary")


def _mins(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, MINS)


def _children(nodes: np.ndarray, mins: np.ndarray, choice: np.ndarray) -> np.ndarray:
    token = mins[np.arange(len(mins)), choice].astype(np.uint64)
    return mix((nodes + _SALT[choice]) * _ODD[0] + token).view(np.int64)


def _roots(classes: DataFrame) -> DataFrame:
    """The nodes of depth two, which are branched without a look at the nodes between."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mins = _mins(batch.column("mins"))
            for k in range(2 * TREES):
                tree = np.full(len(mins), k // 2 + 1, np.uint64)
                nodes = _children(mix(tree), mins, np.full(len(mins), k)).view(np.uint64)
                nodes = _children(nodes, mins, np.full(len(mins), 2 * TREES + k))
                yield pa.record_batch([pa.array(nodes), batch.column("rep")], ["node", "rep"])

    return classes.select("rep", "mins").mapInArrow(run, "node long, rep long")


def _branches(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy().view(np.uint64)
            mins, rep = _mins(batch.column("mins")), batch.column("rep").to_numpy()
            drawn = mix(nodes ^ _SALT[7])
            first = (drawn % np.uint64(MINS)).astype(int)
            second = ((drawn >> np.uint64(8)) % np.uint64(MINS)).astype(int)
            both = ((drawn >> np.uint64(16)) % np.uint64(4) == 0) & (first != second)
            out = np.r_[_children(nodes, mins, first), _children(nodes[both], mins[both], second[both])]
            yield pa.record_batch([pa.array(out), pa.array(np.r_[rep, rep[both]])], ["node", "rep"])

    return rows.select("node", "rep", "mins").mapInArrow(run, "node long, rep long")


def _shared(rows: DataFrame) -> DataFrame:
    """(node, rep, m) of the nodes with several classes; of small nodes with the same classes, one."""
    sizes = rows.groupBy("node").agg(
        F.count("*").alias("m"), F.expr("bit_xor(xxhash64(rep))").alias("x"),
        F.expr("bit_xor(xxhash64(rep, 1))").alias("y")).filter("m > 1")
    sizes = sizes.withColumn("own", F.when(F.col("m") > SMALL, F.col("node")).otherwise(0))
    once = sizes.groupBy("m", "x", "y", "own").agg(F.min("node").alias("node")).select("node", "m")
    return cut_lineage(rows.join(once, "node"))


def _pivoted(wide: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (node, rep, mins): candidates of wide nodes' pivots, and the rows left, of small nodes and of wide ones.

    Every class of a node is compared with one of them, the pivot. A node whose classes are all candidates of the pivot
    is done, as they are in one block. Otherwise, classes that agree with the pivot in `CLOSE` tokens leave: what links
    with them is near enough to the pivot to be its candidate.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (_mins(batch.column("mins")) == _mins(batch.column("own"))).sum(axis=1)
            yield pa.record_batch([batch.column("node"), batch.column("rep"), batch.column("pivot"), pa.array(agree, pa.int32()),
                                   batch.column("mins")], ["node", "rep", "pivot", "agree", "mins"])

    pivots = wide.groupBy("node").agg(F.min_by(F.struct("rep", "mins"), F.xxhash64("node", "rep")).alias("p")).select(
        "node", F.col("p.rep").alias("pivot"), F.col("p.mins").alias("own"))
    compared = cut_lineage(wide.join(pivots, "node").select("node", "rep", "pivot", "mins", "own").mapInArrow(
        run, "node long, rep long, pivot long, agree int, mins binary"))
    need = MINS * (percent - MARGIN) // 100
    found = compared.filter((F.col("agree") >= need) & (F.col("rep") != F.col("pivot"))).select(
        F.col("pivot").alias("id_a"), F.col("rep").alias("id_b"))
    left = compared.filter(F.col("agree") < CLOSE)
    sizes = left.groupBy("node").agg(F.count("*").alias("m"), F.count_if(F.col("agree") < need).alias("apart"))
    open_ = cut_lineage(sizes.filter("apart > 0 and m > 1").select("node", "m"))
    rows = left.select("node", "rep", "mins")
    return (found, rows.join(open_.filter(F.col("m") <= SMALL), "node", "left_semi"),
            rows.join(open_.filter(F.col("m") > SMALL), "node", "left_semi"))


def _nodes(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, rep) of the nodes to compare, and candidates found on the way."""
    mins = classes.select("rep", "mins")
    level = _shared(_roots(classes))
    nodes, found = [], []
    for depth in range(DEPTH):
        nodes.append(level.filter(F.col("m") <= SMALL))
        wide = level.filter(F.col("m") > SMALL)
        if not wide.limit(1).count():
            break
        near, small, wide = _pivoted(cut_lineage(wide.select("node", "rep").join(mins, "rep")), percent)
        found.append(near)
        nodes.append(small)
        if depth + 1 == DEPTH:
            nodes.append(wide)
        else:
            level = _shared(_branches(wide))
    none = classes.limit(0).select(F.col("rep").alias("id_a"), F.col("rep").alias("id_b"))
    both = [reduce(DataFrame.unionByName, parts) for parts in (
        [n.select("node", "rep") for n in nodes], [none, *found])]
    return both[0], both[1]


class Members:
    """Classes of one unit: numbers, components so far, sides, sizes, minwise tokens and, in blocks, shingle sets."""

    def __init__(self, rows: list[tuple]):
        rows = list({(r[0], r[2]): r for r in rows}.values())
        self.rep, self.group = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.side, self.size = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], np.int64)
        self.mins = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(-1, MINS)
        self.sets = [None if r[5] is None else np.frombuffer(r[5], np.uint64) for r in rows]

    def links(self, percent: int) -> list[tuple[int, int]]:
        """Pairs of the same unit's sides that connect what is apart. Side 1 is compared with side 0 where there is a
        side 1, all with all otherwise."""
        out = []
        need = MINS * (percent - MARGIN) // 100
        across = bool(self.side.any())
        for x in np.flatnonzero(self.side) if across else range(len(self.rep)):
            apart = self.group != self.group[x]
            if across:
                apart &= self.side == 0
            else:
                if not apart.any():
                    break
                apart[:x + 1] = False
            apart &= 100 * np.minimum(self.size, self.size[x]) >= percent * np.maximum(self.size, self.size[x])
            other = np.flatnonzero(apart)
            if not len(other):
                continue
            agree = (self.mins[other] == self.mins[x]).sum(axis=1)
            for y in other[agree >= need][np.argsort(-agree[agree >= need], kind="stable")]:
                if self.group[y] == self.group[x]:
                    continue
                if self.sets[x] is not None:
                    a, b = sorted((self.sets[x], self.sets[y]), key=len)
                    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    common = int((b[place] == a).sum())
                    if 100 * common < percent * (len(a) + len(b) - common):
                        continue
                out.append((int(self.rep[x]), int(self.rep[y])))
                self.group[self.group == self.group[y]] = self.group[x]
        return out


_ROW = ("rep", "comp", "side", "n", "mins", "shingles")


def _compared(units: DataFrame, percent: int) -> DataFrame:
    """(id_a, id_b) of rows (unit, rep, comp, side, n, mins, shingles), unit by unit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        unit = None
        for batch in batches:
            links: list[tuple[int, int]] = []
            for u, *row in zip(*(batch.column(k).to_pylist() for k in ("unit", *_ROW))):
                if u != unit:
                    if len(held) > 1:
                        links += Members(held).links(percent)
                    held, unit = [], u
                held.append(tuple(row))
            yield pa.record_batch([pa.array([a for a, _ in links], pa.int64()),
                                   pa.array([b for _, b in links], pa.int64())], ["id_a", "id_b"])
        if len(held) > 1:
            links = Members(held).links(percent)
            yield pa.record_batch([pa.array([a for a, _ in links], pa.int64()),
                                   pa.array([b for _, b in links], pa.int64())], ["id_a", "id_b"])

    dealt = units.repartition(partitions(units), "unit").sortWithinPartitions("unit", "rep")
    return dealt.select("unit", *_ROW).mapInArrow(run, "id_a long, id_b long").filter("id_a != id_b")


def _linked(rows: DataFrame, weight: str, unit: int, percent: int,
            load: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links that connect the classes of each group of rows (group, rep, n), a written table. `load` adds mins and
    shingles to rows with units; it is called after the rows are dealt to units, so payloads move once."""
    placed = rows.withColumn("comp", F.col("rep")).withColumn("side", F.lit(0))
    totals = rows.groupBy("group").agg(F.sum(weight).alias("total"))
    wide = totals.filter(F.col("total") > unit)
    if not wide.limit(1).count():
        return cut_lineage(_compared(load(placed.withColumnRenamed("group", "unit")), percent))
    cuts = cut_lineage(wide.withColumn("cuts", F.ceil(F.col("total") * 2 / unit).cast("int")).select("group", "cuts"))
    whole = placed.join(cuts, "group", "left_anti").withColumnRenamed("group", "unit")
    parted = placed.join(cuts, "group").withColumn("part", F.pmod(F.xxhash64("rep", "group"), F.col("cuts")).cast("int"))
    first = Window.partitionBy("group").orderBy("rep")
    pivots = (parted.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= PIVOTS).drop("k", "part")
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))))
    parts = parted.unionByName(pivots).distinct().withColumn("unit", F.xxhash64("group", "part"))
    links = cut_lineage(_compared(load(whole.unionByName(parts.select(*whole.columns))), percent))

    found = components(links).select(F.col("id").alias("rep"), F.col("component").alias("found"))
    known = parted.join(found, "rep", "left").withColumn("comp", F.coalesce("found", "rep")).drop("found")
    known = cut_lineage(known)
    sizes = known.groupBy("group", "comp").agg(F.count("*").alias("c"), F.sum(weight).alias("w"))
    main = sizes.groupBy("group").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"),
                                      (F.sum("w") - F.max(F.struct("c", "comp", "w"))["w"]).alias("rest"))
    main = cut_lineage(main.filter("rest > 0").withColumn("others", F.ceil(F.col("rest") * 2 / unit).cast("int")))
    if not main.limit(1).count():
        return links
    both = known.join(main, "group")
    every = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    each = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    left = both.withColumn("other", every)
    rest = (both.filter("comp != main").withColumn("side", F.lit(1)).drop("part")
            .withColumn("other", F.pmod(F.xxhash64("rep", "main"), F.col("others")).cast("int")).withColumn("part", each))
    units = left.unionByName(rest.select(*left.columns)).withColumn("unit", F.xxhash64("group", "part", "other"))
    more = _compared(load(units.select(*whole.columns)), percent)
    return cut_lineage(links.unionByName(more))


def classes(docs: DataFrame, words: int = 4, percent: int = 80, node_unit: int = NODE_UNIT,
            block_unit: int = BLOCK_UNIT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for rows (doc_id, text)."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), "text",
                       F.xxhash64("text").alias("t"))
    sketches = cut_lineage(_sketches(docs, words))
    equal = cut_lineage(sketches.filter("n > 0").groupBy("n", "h1", "h2").agg(
        F.min(F.struct("doc_id", "t")).alias("one"), F.first("mins").alias("mins"))
        .select("n", "h1", "h2", "one.doc_id", "one.t", "mins").withColumn("rep", F.monotonically_increasing_id()))
    nodes = cut_lineage(sketches.select("doc_id", "n", "h1", "h2").join(
        equal.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"], "left").select("doc_id", "n", "rep"))

    tokens = equal.select("rep", "mins")
    sizes = equal.select("rep", "n")
    compared, found = _nodes(equal, percent)
    asked = cut_lineage(compared.withColumnRenamed("node", "group").join(sizes, "rep").withColumn("one", F.lit(1)))
    candidates = _linked(asked, "one", node_unit, percent, lambda u: u.join(tokens, "rep").withColumn(
        "shingles", F.lit(None).cast("binary")))
    blocks = components(candidates.unionByName(found)).select(F.col("id").alias("rep"), F.col("component").alias("group"))
    blocks = cut_lineage(blocks.join(sizes, "rep"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat id and text
        for batch in large(batches, "text", 4 << 20):
            if len(seen) > 100_000:
                seen.clear()
            new = []
            for rep in batch.column("rep").to_pylist():
                new.append(rep not in seen)
                seen.add(rep)
            batch = batch.filter(pa.array(new))
            sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], words)
            yield pa.record_batch([batch.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())],
                                  ["rep", "shingles"])

    wanted = blocks.select("rep").join(equal.select("rep", "doc_id", "t"), "rep")
    sets = cut_lineage(docs.join(wanted, ["doc_id", "t"]).select("rep", "text").mapInArrow(
        shingled, "rep long, shingles binary"))
    links = _linked(blocks, "n", block_unit, percent, lambda u: u.join(tokens, "rep").join(sets, "rep"))

    # a component is named by its smallest id; ids with rows in several components join them
    found = components(links).select(F.col("id").alias("rep"), "component")
    held = cut_lineage(nodes.join(found, "rep", "left").select(
        "doc_id", "n", F.coalesce("component", "rep").alias("group")))
    names = held.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("name"))
    named = held.join(names, "group", "left").select("doc_id", "n", F.coalesce("name", "doc_id").alias("name"))
    out = cut_lineage(named.groupBy("doc_id").agg(
        F.max("n").alias("n_shingles"), F.min("name").alias("component_id"), F.max("name").alias("last")))
    several = out.filter("last > component_id").select("doc_id", "component_id")
    if several.limit(1).count():
        edges = named.join(several, "doc_id").filter("name > component_id").select(
            F.col("component_id").alias("id_a"), F.col("name").alias("id_b")).distinct()
        wider = components(edges).select(F.col("id").alias("component_id"), "component")
        out = out.join(wider, "component_id", "left").withColumn("component_id", F.coalesce("component", "component_id"))
    null = F.lit(_NULL)
    return out.select(F.nullif("doc_id", null).alias("doc_id"), "n_shingles",
                      F.nullif("component_id", null).alias("component_id"))


def op13_near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document; the document that names its component is kept."""
    return classes(docs, 4, 80).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
