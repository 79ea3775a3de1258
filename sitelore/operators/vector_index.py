"""H5 on stored vectors: an inverted file with product quantisation.

The index is built once and kept as tables: cells (the nearest of some centres), per cell blocks of ids and codes (the
residual to the centre, one byte per subspace), and the unit vectors by cell. A search reads the blocks of each query's
nearest cells, adds up table look-ups of the codes, and compares only the best rows with their full vectors.

Centres and code books are fitted on at most `SAMPLE` rows, chosen by a hash of the id; every row is indexed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sitelore import schemas
from sitelore.functions.chunked import top_per_key
from sitelore.operators.search_vector import cosine

SAMPLE = 20_000
BLOCK_ROWS, BLOCK_QUERIES = 512, 32


def _clusters(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k means of the rows; fewer where there are fewer rows."""
    draw = np.random.default_rng(seed)
    centres = rows[draw.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        sizes = np.bincount(own, minlength=len(centres))
        some = sizes > 0
        centres[some] = sums[some] / sizes[some, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centres.T - (centres ** 2).sum(axis=1) / 2, axis=1)


@dataclass(frozen=True)
class Model:
    """Cell centres, and a code book for every subspace (subspace, code, component)."""

    centres: np.ndarray
    books: np.ndarray

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        width = self.books.shape[2]
        parts = np.pad(residuals, ((0, 0), (0, len(self.books) * width - residuals.shape[1])))
        return np.column_stack([_nearest(parts[:, s * width:(s + 1) * width], book)
                                for s, book in enumerate(self.books)]).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(query, subspace, code) products of the queries with the code books."""
        width = self.books.shape[2]
        parts = np.pad(queries, ((0, 0), (0, len(self.books) * width - queries.shape[1])))
        return np.einsum("qsw,scw->qsc", parts.reshape(len(queries), len(self.books), width), self.books)


def fit_model(vectors: DataFrame, cells: int = 64, subspaces: int = 16, codes: int = 256, seed: int = 0) -> Model:
    """Fitted on at most SAMPLE rows (id, embedding) of unit vectors."""
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()
    if not chosen:
        return Model(np.zeros((1, 1)), np.zeros((1, 1, 1)))
    rows = np.array([r["embedding"] for r in chosen], dtype=np.float64)
    centres = _clusters(rows, cells, seed=seed)
    residuals = rows - centres[_nearest(rows, centres)]
    subspaces = min(subspaces, rows.shape[1])
    width = -(-rows.shape[1] // subspaces)
    residuals = np.pad(residuals, ((0, 0), (0, subspaces * width - rows.shape[1])))
    books = [_clusters(residuals[:, s * width:(s + 1) * width], min(codes, 256), seed=seed + s) for s in range(subspaces)]
    return Model(centres, np.stack(books))


def _units(df: DataFrame, key: str, dims: int | None = None) -> DataFrame:
    """(key, embedding) with unit vectors; rows without a vector, with a null or non-finite component or of another
    length than `dims` are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, v: total + v * v))
    good = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(key, x.alias("embedding")).filter(F.col("embedding").isNotNull() & ~good)
    if dims is not None:
        rows = rows.filter(F.size("embedding") == dims)
    unit = F.when(norm > 0, F.transform("embedding", lambda v: v / norm)).otherwise(F.col("embedding"))
    return rows.select(key, unit.alias("embedding"))


class VectorIndex:
    """The stored index of one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.schema("centres string, books string, rows long, id string").json(f"{self.path}/model").first()
        self.model = Model(np.array(json.loads(row["centres"])), np.array(json.loads(row["books"])))
        self.rows, self.id = row["rows"], row["id"]

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(f"ids array<{self.id}>, codes binary, cell int").parquet(f"{self.path}/blocks")

    def vectors(self) -> DataFrame:
        schema = f"id {self.id}, code binary, embedding array<double>, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")


def build_vector_index(entities: DataFrame, path: str, cells: int = 64, subspaces: int = 16, seed: int = 0) -> VectorIndex:
    """Index every row (id, embedding) in the folder `path`: folders per cell, blocks of at most BLOCK_ROWS rows.

    A cell that holds much of the table is split over tasks by ranges of (cell, hash of the id). Rows whose vector has
    another length than the sample's most frequent one are left out.
    """
    spark = entities.sparkSession
    counts = entities.filter("embedding is not null").groupBy(F.size("embedding").alias("d")).count()
    first = counts.orderBy(F.desc("count"), "d").first()
    units = _units(entities, "id", first["d"] if first else 0)
    model = fit_model(units, cells, subspaces, seed=seed)
    kind = entities.schema["id"].dataType.simpleString()
    coded_schema = f"id {kind}, cell int, code binary, embedding array<double>"
    arrow = to_arrow_schema(schemas.struct(coded_schema))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                own = _nearest(rows, model.centres)
                codes = model.codes(rows - model.centres[own])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                    batch.column(1).cast(arrow.field("embedding").type)], schema=arrow)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = units.mapInArrow(code, coded_schema)
    dealt = coded.repartitionByRange(n, "cell", F.xxhash64("id")).sortWithinPartitions("cell")
    dealt.write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(coded_schema).parquet(f"{path}/vectors")
    block_schema = f"cell int, ids array<{kind}>, codes binary"
    block_arrow = to_arrow_schema(schemas.struct(block_schema))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            ids, codes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            cuts = [(a, min(a + BLOCK_ROWS, int(end))) for start, end in zip(edges[:-1], edges[1:])
                    for a in range(int(start), int(end), BLOCK_ROWS)]
            yield pa.RecordBatch.from_pylist([
                {"cell": int(cell[a]), "ids": ids[a:b], "codes": b"".join(codes[a:b])} for a, b in cuts], block_arrow)

    by_cell = stored.select("cell", "id", "code").repartitionByRange(n, "cell", F.xxhash64("id")).sortWithinPartitions("cell")
    by_cell.mapInArrow(pack, block_schema).write.partitionBy("cell").parquet(f"{path}/blocks")
    total = stored.count()
    spark.createDataFrame([(json.dumps(model.centres.tolist()), json.dumps(model.books.tolist()), total, kind)],
                          "centres string, books string, rows long, id string").coalesce(1).write.json(f"{path}/model")
    return VectorIndex(spark, path)


def indexed_search(index: VectorIndex, queries: DataFrame, k: int = 20, probes: int = 16, rerank: int = 100) -> DataFrame:
    """H5: (query_id, rank, id, similarity, scored, compared) for queries (query_id, embedding).

    `scored` counts the rows whose codes were looked up, `compared` those whose full vectors were read. Blocks meet
    blocks of queries by an equi-join on the cell, and each returns at most `rerank` rows a query; the vectors of the
    best `rerank` are joined by (cell, id). Nothing passes through the driver.
    """
    model = index.model
    blocks, vectors = index.blocks(), index.vectors()
    q_kind, kind = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    asked = _units(queries, "query_id", model.centres.shape[1])
    probe_schema = f"query_id {q_kind}, cell int, base double, embedding array<double>"
    probe_arrow = to_arrow_schema(schemas.struct(probe_schema))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                near = rows @ model.centres.T
                cells = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                which = np.repeat(np.arange(len(rows)), cells.shape[1])
                taken = batch.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([
                    taken.column(0), pa.array(cells.ravel(), pa.int32()), pa.array(near[which, cells.ravel()]),
                    taken.column(1).cast(probe_arrow.field("embedding").type)], schema=probe_arrow)

    probes_of = asked.mapInArrow(probe, probe_schema)
    lots = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("m") / BLOCK_QUERIES))
    sized = probes_of.join(probes_of.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    grouped = sized.groupBy("cell", lots.alias("lot")).agg(
        F.collect_list(F.struct("query_id", "base", "embedding")).alias("asked"))
    found_schema = f"query_id {q_kind}, id {kind}, cell int, estimate double"
    found_arrow = to_arrow_schema(schemas.struct(found_schema))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(len(model.books))
        for batch in batches:
            for cell, ids, codes, lot in zip(*(c.to_pylist() for c in batch.columns)):
                table = model.tables(np.array([a["embedding"] for a in lot]))
                code = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
                rows = []
                for q, one in enumerate(lot):
                    estimate = one["base"] + table[q][places, code].sum(axis=1)
                    best = np.argsort(-estimate, kind="stable")[:rerank]
                    rows += [{"query_id": one["query_id"], "id": ids[i], "cell": cell, "estimate": float(estimate[i])}
                             for i in best]
                yield pa.RecordBatch.from_pylist(rows, found_arrow)

    found = blocks.join(grouped, "cell").select("cell", "ids", "codes", "asked").mapInArrow(look_up, found_schema)
    sizes = blocks.groupBy("cell").agg(F.sum(F.size("ids")).alias("rows"))
    scored = probes_of.join(sizes, "cell").groupBy("query_id").agg(F.sum("rows").alias("scored"))
    best = top_per_key(found, ["query_id"], [F.col("estimate").desc(), F.col("id")], rerank)
    exact = (best.select("query_id", "id", "cell").join(vectors.select("id", "cell", "embedding"), ["cell", "id"])
             .join(asked.withColumnRenamed("embedding", "asked"), "query_id").join(scored, "query_id")
             .withColumn("similarity", F.round(cosine("asked", "embedding"), 12))
             .withColumn("compared", F.count("*").over(Window.partitionBy("query_id"))))
    out = top_per_key(exact, ["query_id"], [F.col("similarity").desc(), F.col("id")], k)
    return out.select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"), "scored", "compared")


def recall_report(exact: DataFrame, approximate: DataFrame, rows: int) -> DataFrame:
    """(query_id, recall, scored_share, compared_share): the share of exact hits found, and of `rows` looked at."""
    seen = approximate.groupBy("query_id").agg(F.max("scored").alias("scored"), F.max("compared").alias("compared"))
    hits = exact.select("query_id", "id").join(approximate.select("query_id", "id", F.lit(1).alias("hit")),
                                               ["query_id", "id"], "left")
    recall = hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
    return recall.join(seen, "query_id", "left").select(
        "query_id", "recall", (F.coalesce("scored", F.lit(0)) / rows).alias("scored_share"),
        (F.coalesce("compared", F.lit(0)) / rows).alias("compared_share"))

