"""H4 and H5: exact and approximate vector search for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sitelore import schemas
from sitelore.functions.chunked import top_per_key
from sitelore.operators.entities import normalise_vector

MAX_BLOCK_QUERIES = 4096  # query vectors shipped to the tasks at a time
RANK_DIGITS = 12  # ranking ignores what the order of summation changes
SLICE_ROWS = 1024  # rows per matrix product, which bounds a task's memory


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return matrix / norms


def _partial_top(query_ids: list, unit_queries: np.ndarray, k: int, digits: int, schema: pa.Schema):
    """Best k rows per query of one task: one matrix product per batch, the running best kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, object]]] = [[] for _ in query_ids]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                ids = part.column(0).to_pylist()
                sims = np.round(unit_queries @ _unit(_matrix(part.column(1))).T, digits)
                for q, row in enumerate(sims):
                    # everything tied with the k-th value stays, so that ties are broken by id
                    bound = -best[q][-1][0] if len(best[q]) == k else -np.inf
                    if len(row) > k:
                        bound = max(bound, np.partition(row, len(row) - k)[len(row) - k])
                    chosen = np.flatnonzero(row >= bound)
                    if len(chosen):
                        best[q] = sorted(best[q] + [(-row[i], ids[i]) for i in chosen])[:k]
        rows = [{"query_id": query_ids[q], "id": i, "similarity": float(-s) + 0.0}
                for q, found in enumerate(best) for s, i in found]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def vector_search(entities: DataFrame, queries: DataFrame, k: int = 20, digits: int = 6) -> DataFrame:
    """H4: the k nearest entities (id, embedding) per query (query_id, embedding) by cosine similarity.

    Ranks go by the similarity itself; only what is returned is rounded to `digits`.

    `entities` is already filtered (H8); null embeddings are not ranked. The query vectors go to the tasks in blocks
    of bounded size (one scan per block), and every task returns at most k rows per query, so the shuffle carries
    k * queries rows per task and never a pair product.
    """
    rows = entities.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    types = {"q": queries.schema["query_id"].dataType.simpleString(), "i": rows.schema["id"].dataType.simpleString()}
    ddl = f"query_id {types['q']}, id {types['i']}, similarity double"
    arrow_schema = to_arrow_schema(schemas.struct(ddl))
    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
    # blocks by hash, half full on average
    n = asked.count() * 2 // MAX_BLOCK_QUERIES + 1
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(n))
    parts = []
    for block in (asked.filter(block_of == i).collect() for i in range(n)):
        if block:
            matrix = _unit(np.array([r["embedding"] for r in block], dtype=np.float64))
            top = _partial_top([r["query_id"] for r in block], matrix, k, RANK_DIGITS, arrow_schema)
            parts.append(rows.mapInArrow(top, ddl))
    if not parts:
        return entities.sparkSession.createDataFrame([], ddl + ", rank int")
    partial = parts[0]
    for part in parts[1:]:
        partial = partial.unionByName(part)
    return top_per_key(partial, ["query_id"], [F.col("similarity").desc(), F.col("id")], k) \
        .select("query_id", "rank", "id", F.round("similarity", digits).alias("similarity"))


def cosine(left: str, right: str) -> Column:
    """Cosine similarity of two vector columns; null where one is missing."""
    def product(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                           lambda acc, x: acc + x)

    norm = F.sqrt(product(left, left) * product(right, right))
    return F.when(norm > 0, product(left, right) / norm).when(norm == 0, F.lit(0.0))


def lsh_search(entities: DataFrame, queries: DataFrame, k: int = 20, tables: int = 8, bucket_length: float = 1.0,
               max_distance: float = 2.0, seed: int = 42) -> DataFrame:
    """H5: approximate form of H4 by random projections (Euclidean order on unit vectors is cosine order).

    Only entities that share a hash bucket with the query in some table are compared; recall grows with `tables` and
    `bucket_length`.
    """
    some = entities.filter(F.col("embedding").isNotNull()).select(F.size("embedding")).first()
    dim = some[0] if some else 1

    def vectors(df: DataFrame, key: str) -> DataFrame:
        # never null, as the planner may hash rows before it drops those without a vector
        unit = F.coalesce(normalise_vector(F.col("embedding")).cast("array<double>"), F.array_repeat(F.lit(0.0), dim))
        return df.filter(F.col("embedding").isNotNull()).select(key, array_to_vector(unit).alias("v"))

    data = vectors(entities, "id")
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=bucket_length,
                                      numHashTables=tables, seed=seed)
    model = lsh.fit(data)
    pairs = model.approxSimilarityJoin(vectors(queries, "query_id"), data, max_distance, distCol="distance")
    near = pairs.select(F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.id").alias("id"),
                        (1 - F.col("distance") * F.col("distance") / 2).alias("similarity"))
    return top_per_key(near, ["query_id"], [F.col("similarity").desc(), F.col("id")], k) \
        .select("query_id", "rank", "id", "similarity")
