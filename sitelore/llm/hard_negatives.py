"""Hard-negative mining by threshold joins over an inverted index with norm bounds.

Vectors are integer vectors (floor of 256 times a component), scores are their inner products. For each anchor the best
rows of its own label are its positives; for each positive, the best rows of other labels whose score lies in a window
below the positive's are its hard negatives. Both are found by a join "score >= threshold" whose threshold falls from
round to round:

1. Of rows with equal vector and label only those with the smallest ids can be among an anchor's first rows, so as many
   as one result holds stay. Anchors of equal vector and label are one query.
2. Rows are packed in blocks and dealt to units. Query blocks, which are rows of a table as well, are sent to every unit;
   nothing passes the driver.
3. A unit's index holds the vectors dimension by dimension. From the dimension on behind which a vector's suffix norm
   cannot reach the lowest threshold of the queries, its components stay out of the index; lists are kept in order of
   that length, so the list of a dimension is a prefix of the rows.
4. Queries run down the lists in slabs of dimensions and add up partial scores. After each slab, a pair whose partial
   score plus the product of both remaining norms is below the query's threshold is dropped. What survives is scored in
   full, and every unit returns the first rows of each window.
5. Queries whose windows are full are done; the others come back with a lower threshold, at last with none (positives) or
   with the bottom of the window (negatives).

Nothing is sampled. Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part;
of rows that share an id the one with the smallest label, then packed vector, takes part; components that a shorter vector lacks are zero; scores beyond 2^53 are exact modulo 2^64; an
anchor without rows of its label, or with a positive of negative score, has no negatives there; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelore.llm.common import cut_lineage, partitions

#: rows of a block, rows of a unit, queries of a block, dimensions of a slab
BLOCK, UNIT, QUERIES, SLAB = 2048, 32_768, 256, 8
#: thresholds of the rounds for positives, as shares of the query's squared norm
SHARES = (0.5, 0.3, 0.18, None)
#: the threshold of the next round for negatives
FALL = 0.75
_LOW = -(1 << 62)


def _pack(row: np.ndarray) -> bytes:
    """Integers in the narrowest of three widths, which the first byte names."""
    most = int(np.abs(row).max()) if len(row) else 0
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + row.astype(f"<i{width}").tobytes()


def _matrix(packed: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(p, f"<i{p[0]}", offset=1) for p in packed]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for k, row in enumerate(rows):
        out[k, :len(row)] = row
    return out


def integer_rows(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v is the packed integer vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, packed = [], []
            for row in batch.column("v"):
                values = row.values.to_numpy(zero_copy_only=False).astype(float)  # a null component becomes nan
                good = bool(np.isfinite(values).all())
                keep.append(good)
                if good:
                    scaled = np.clip(np.floor(scale * values), -float(1 << 62), float(1 << 62))
                    packed.append(_pack(scaled.astype(np.int64)))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("vec_id").filter(mask), batch.column("label").filter(mask),
                                   pa.array(packed, pa.binary())], ["vec_id", "label", "v"])

    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.col(vector).alias("v")).dropna()
    whole = some.mapInArrow(run, "vec_id long, label long, v binary")
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one")).select("vec_id", "one.label", "one.v")


class Index:
    """The vectors of a unit as lists per dimension, dimensions in descending order of their squared sum."""

    def __init__(self, vectors: np.ndarray, slab: int = SLAB):
        self.whole = vectors
        self.dims = np.argsort(-(vectors.astype(float) ** 2).sum(axis=0), kind="stable")
        self.x = vectors[:, self.dims].astype(float)
        self.cuts = list(range(0, self.x.shape[1], slab)) + [self.x.shape[1]]
        self.rest = self._rest(self.x)
        self.most = float(np.abs(self.x).max(initial=0))

    def _rest(self, x: np.ndarray) -> np.ndarray:
        """Norms of what is left of each row from the start of each slab on, and 0 behind the last."""
        squares = [(x[:, a:b] ** 2).sum(axis=1) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        return np.sqrt(np.cumsum([np.zeros(len(x)), *reversed(squares)], axis=0)[::-1].T)

    def join(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, query, score) of all pairs with score >= least[query]."""
        width = max(queries.shape[1], self.whole.shape[1])
        if self.most * float(np.abs(queries).max(initial=0)) * max(width, 1) >= float(1 << 52):  # beyond exact doubles
            same = min(queries.shape[1], self.whole.shape[1])
            scores = self.whole[:, :same] @ queries[:, :same].T
            row, query = np.nonzero(scores >= least)
            return row, query, scores[row, query]
        wide = np.zeros((len(queries), self.whole.shape[1]))
        same = min(queries.shape[1], self.whole.shape[1])
        wide[:, :same] = queries[:, :same]
        q = wide[:, self.dims]
        q_rest = self._rest(q)
        floor = least - 0.5
        # slabs of each row in the index: behind them the suffix norm cannot reach any threshold
        length = (self.rest[:, :-1] * q_rest[:, 0].max(initial=0) >= floor.min(initial=np.inf)).sum(axis=1)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        length = length[order]
        partial = np.zeros((len(order), len(q)))
        row = query = None  # pairs, once few are left
        for s, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            n = int(np.searchsorted(-length, -s, "left"))  # rows whose lists of this slab exist
            if not n:
                break
            if row is None:
                partial[:n] += self.x[order[:n], a:b] @ q[:, a:b].T
                # rows that left the index earlier keep the bound of the place where they did
                gone = self.rest[order, np.minimum(length, s + 1)]
                at = q_rest[:, np.minimum(length, s + 1)].T
                alive = partial + gone[:, None] * at >= floor
                if alive.mean() < 0.125 or s + 2 == len(self.cuts):
                    row, query = np.nonzero(alive)
                    partial = partial[row, query]
            else:
                on = row < n
                partial[on] += np.einsum("pd,pd->p", self.x[order[row[on]], a:b], q[query[on], a:b])
                end = np.minimum(length[row], s + 1)
                alive = partial + self.rest[order[row], end] * q_rest[query, end] >= floor[query]
                row, query, partial = row[alive], query[alive], partial[alive]
        if row is None:
            row, query = np.nonzero(np.ones_like(partial, bool))
        row = order[row]
        scores = np.empty(len(row), np.int64)
        for k in range(0, len(row), 1 << 16):  # the components that were not indexed, with the rest
            part = slice(k, k + (1 << 16))
            scores[part] = np.einsum("pd,pd->p", self.x[row[part]], q[query[part]])
        good = scores >= least[query]
        return row[good], query[good], scores[good]


def _first(query: np.ndarray, score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first `count` entries of each query by falling score and rising id."""
    order = np.lexsort((ids, -score, query))
    begin = np.flatnonzero(np.r_[True, query[order][1:] != query[order][:-1]])
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
    return order[rank < count]


def _blocks(rows: DataFrame, size: int, kind: int) -> DataFrame:
    """Rows (id, label, v, t, tops) as blocks of `size`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(table: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "kind": kind, "ids": table.column("id").to_pylist(), "labels": table.column("label").to_pylist(),
                "vs": table.column("v").to_pylist(), "t": table.column("t").to_pylist(),
                "tops": table.column("tops").to_pylist()}], schema)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held).combine_chunks()
                for k in range(0, table.num_rows - size + 1, size):
                    yield block(table.slice(k, size))
                rest = table.num_rows % size
                held = table.slice(table.num_rows - rest).to_batches() if rest else []
        if held:
            yield block(pa.Table.from_batches(held))

    schema = pa.schema([("kind", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())),
                        ("vs", pa.list_(pa.binary())), ("t", pa.list_(pa.int64())),
                        ("tops", pa.list_(pa.list_(pa.int64())))])
    return rows.select("id", "label", "v", "t", "tops").mapInArrow(
        run, "kind int, ids array<long>, labels array<long>, vs array<binary>, t array<long>, tops array<array<long>>")


def _least(window: int, low: int) -> int:
    return -(-low * window // 100)


def _units(blocks: DataFrame, units: int, same: bool, count: int, low: int, high: int) -> DataFrame:
    """(qid, top, vec_id, score) of rows and queries dealt to units: the first `count` of each query (and window)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, index = None, [], None
        for batch in batches:
            for b in batch.to_pylist():
                if b["unit"] != unit:
                    unit, held, index = b["unit"], [], None
                if b["kind"] == 0:
                    held.append((np.array(b["ids"]), np.array(b["labels"]), b["vs"]))
                    continue
                if not held:
                    continue
                if index is None:
                    ids, labels = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                    vectors = _matrix([v for h in held for v in h[2]])
                    index = [(ids[k:k + 4 * BLOCK], labels[k:k + 4 * BLOCK], Index(vectors[k:k + 4 * BLOCK]))
                             for k in range(0, len(ids), 4 * BLOCK)]
                yield answers(index, b)

    def answers(index: list, asked: dict) -> pa.RecordBatch:
        qid, own, least = (np.array(asked[k], np.int64) for k in ("ids", "labels", "t"))
        vectors = _matrix(asked["vs"])
        found = []
        for ids, labels, part in index:
            row, query, score = part.join(vectors, least)
            fit = (labels[row] == own[query]) == same
            found.append((query[fit], score[fit], ids[row[fit]]))
        query, score, ids = (np.concatenate([f[k] for f in found]) for k in range(3))
        out = []
        tops = asked["tops"]
        for w in range(max((len(t or ()) for t in tops), default=0) if not same else 1):
            if same:
                top, fit = None, np.ones(len(query), bool)
            else:
                top = np.array([t[w] if w < len(t) else -1 for t in tops], np.int64)[query]
                fit = (top >= 0) & (100 * score >= low * top) & (100 * score <= high * top)
            kept = np.flatnonzero(fit)[_first(query[fit], score[fit], ids[fit], count)]
            out.append((qid[query[kept]], np.zeros(len(kept), np.int64) if same else top[kept], ids[kept], score[kept]))
        columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(4)]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["qid", "top", "vec_id", "score"])

    dealt = blocks.repartitionByRange(min(units, 4 * partitions(blocks)), "unit").sortWithinPartitions("unit", "kind")
    return dealt.mapInArrow(run, "qid long, top long, vec_id long, score long")


def _search(rows: DataFrame, units: int, queries: DataFrame, same: bool, count: int, low: int = 0,
            high: int = 0) -> DataFrame:
    """(qid, top, vec_id, score, k): the first `count` rows of every query and window above the query's threshold t."""
    asked = _blocks(queries.withColumnRenamed("qid", "id"), QUERIES, 1).withColumn(
        "unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1))))
    found = _units(rows.unionByName(asked), units, same, count, low, high)
    order = Window.partitionBy("qid", "top").orderBy(F.desc("score"), "vec_id")
    return cut_lineage(found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= count))


def _norm(queries: DataFrame) -> DataFrame:
    """`queries` with the squared norm of v."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = (_matrix(batch.column("v").to_pylist()).astype(float) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms)], [*batch.schema.names, "norm"])

    return queries.select("qid", "label", "v").mapInArrow(run, "qid long, label long, v binary, norm double")


def mine(rows: DataFrame, anchor: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30,
         high: int = 90, vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, vector)."""
    held = cut_lineage(integer_rows(rows, vector))
    copies = Window.partitionBy("v", "label").orderBy("vec_id")
    some = held.withColumn("k", F.row_number().over(copies)).filter(F.col("k") <= max(positives + 1, negatives))
    some = cut_lineage(some.drop("k").withColumn("t", F.lit(None).cast("long"))
                       .withColumn("tops", F.lit(None).cast("array<long>")))
    n = some.count()
    units = max(1, -(-n // UNIT), min(partitions(rows), -(-n // BLOCK)))
    blocks = cut_lineage(_blocks(some.withColumnRenamed("vec_id", "id"), max(1, min(BLOCK, -(-n // units))), 0))
    # blocks are dealt round the units by their number in the written table
    dealt = cut_lineage(blocks.withColumn("__b", F.monotonically_increasing_id()).withColumn(
        "unit", F.pmod(F.col("__b").bitwiseAND((1 << 33) - 1) + F.shiftright("__b", 33) * 31, F.lit(units)).cast("int"))
        .drop("__b"))

    chosen = held.filter(anchor)
    asked = cut_lineage(_norm(chosen.select("v", "label").distinct().withColumn(
        "qid", F.monotonically_increasing_id())))
    anchors = chosen.select(F.col("vec_id").alias("anchor_id"), "v", "label").join(
        asked.select("qid", "v", "label"), ["v", "label"]).select("anchor_id", "qid")
    anchors = cut_lineage(anchors)

    rest, best = asked, None
    none = F.lit(None).cast("array<long>")
    for share in SHARES:
        least = F.lit(_LOW) if share is None else F.least(F.lit(float(1 << 60)), F.floor(F.col("norm") * share)).cast("long")
        found = _search(dealt, units, rest.withColumn("t", least).withColumn("tops", none), True, positives + 1)
        full = found.groupBy("qid").agg(F.count("*").alias("c")).filter(F.col("c") > positives).select("qid")
        done = found if share is None else found.join(full, "qid", "left_semi")
        best = done if best is None else best.unionByName(done)
        if share is not None:
            rest = cut_lineage(rest.join(full, "qid", "left_anti"))
            if not rest.limit(1).count():
                break
    best = cut_lineage(best.select("qid", "vec_id", "score"))
    order = Window.partitionBy("anchor_id", "qid").orderBy(F.desc("score"), "vec_id")
    pairs = cut_lineage(anchors.join(best, "qid").filter("vec_id != anchor_id").withColumn(
        "k", F.row_number().over(order)).filter(F.col("k") <= positives).drop("k"))

    windows = best.filter("score >= 0").groupBy("qid").agg(F.collect_set("score").alias("tops"))  # positives + 1 at most
    rest = cut_lineage(asked.select("qid", "label", "v").join(windows, "qid").withColumn("top", F.array_min("tops")))
    bottom = F.ceil(F.col("top") * low / 100).cast("long")
    hard, share = None, high / 100
    while True:
        share *= FALL
        last = 100 * share <= low
        least = bottom if last else F.greatest(bottom, F.floor(F.col("top") * share).cast("long"))
        found = _search(dealt, units, rest.withColumn("t", least), False, negatives, low, high)
        if last:
            hard = found if hard is None else hard.unionByName(found)
            break
        full = found.groupBy("qid", "top").agg(F.count("*").alias("c")).filter(F.col("c") >= negatives)
        full = full.groupBy("qid").agg(F.count("*").alias("c")).join(rest.select("qid", "tops"), "qid").filter(
            F.col("c") == F.size("tops")).select("qid")
        done = found.join(full, "qid", "left_semi")
        hard = done if hard is None else hard.unionByName(done)
        rest = cut_lineage(rest.join(full, "qid", "left_anti"))
        if not rest.limit(1).count():
            break
    hard = hard.select("qid", F.col("top").alias("positive_score"), F.col("vec_id").alias("negative_id"),
                       F.col("score").alias("negative_score"), F.col("k").cast("int").alias("rank"))
    return pairs.withColumnRenamed("score", "positive_score").withColumnRenamed("vec_id", "positive_id").join(
        hard, ["qid", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(rows: DataFrame) -> DataFrame:
    """The contract's fold: ids divisible by 7 take the next label; anchors are ids divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"))


ORACLE = """
WITH part AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM part a JOIN part r ON a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores
  WHERE label = anchor_label AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM pos p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
