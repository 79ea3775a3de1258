r"""Line de-duplication over levelled sorted runs of line hashes.

A run is a table of (key hash, documents that hold the line, largest such doc_id), sorted by hash and unique per hash.
`LineRuns` keeps runs in levels: every batch of documents is aggregated to a run of level 0, and when a level has
`fan` runs they are merged to one run of the next level (counts add, the largest id wins). A lookup merges what is left.
`dedup` feeds all documents in batches, then joins every line once with the merged runs: a line goes if its key is
frequent and a larger doc_id holds it too.

A line's key is the line stripped of `[\x20\x09-\x0D]` at both ends with A-Z in lower case; two 64-bit hashes stand for
it. Only keys of at least `min_chars` code points take part. Lines split at \n alone.

Defined cases: null or empty text is one empty line, kept; a null doc_id counts as the smallest id; rows with the same
doc_id and the same line count once and keep or lose it together; an empty table gives an empty result; further columns
pass through `dedup` unchanged.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sitelore.llm.common import cut_lineage, large
from sitelore.session import ensure_checkpoint_dir

_SPACE = " \t\n\x0b\x0c\r"
RUN_SCHEMA = "h1 long, h2 long, n long, keeper long"
_FIRST = -(1 << 63)


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def line_hash(line: str, min_chars: int) -> bytes | None:
    """16 bytes that stand for the line's key, or None for a line that takes no part."""
    if len(line) < min_chars:
        return None
    key = line.strip(_SPACE)
    if len(key) < min_chars:
        return None
    return hashlib.blake2b(key.encode().lower(), digest_size=16).digest()  # bytes.lower touches A-Z alone


class LineRuns:
    """Levels of sorted runs under `root`, each run one Parquet table named by level and number."""

    def __init__(self, spark: SparkSession, root: str | None = None, fan: int = 4):
        self.spark, self.fan = spark, fan
        self.root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/sitelore/runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, level: int, run: DataFrame) -> None:
        path = f"{self.root}/level-{level}-{self.made}"
        self.made += 1
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        # one scan per run, so the sorted files of a run stay together
        out = self.spark.read.schema(RUN_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], RUN_SCHEMA)
        return out

    @staticmethod
    def _merge(runs: DataFrame) -> DataFrame:
        return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (h1, h2, doc_id), each triple once."""
        self._write(0, lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")))
        level = 0
        while len(self.levels[level]) >= self.fan:
            full, self.levels[level] = self.levels[level], []
            self._write(level + 1, self._merge(self._read(full)))
            level += 1

    def merged(self) -> DataFrame:
        paths = [p for level in self.levels for p in level]
        return self._merge(self._read(paths))


def dedup(docs: DataFrame, row_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5,
          batches: int = 5, runs: LineRuns | None = None) -> DataFrame:
    """`docs` with `text` rebuilt from the lines that stay, plus __n_lines and __n_dropped.

    Give `runs` to continue an earlier corpus; without it a new set of runs is made.
    """
    spark = docs.sparkSession
    runs = runs or LineRuns(spark)
    spaced = F.coalesce(F.col(row_id).cast("long"), F.lit(_FIRST))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large(batches, "text"):
            found = [{h for line in lines_of(t) if (h := line_hash(line, min_chars))}
                     for t in batch.column("text").to_pylist()]
            flat = np.frombuffer(b"".join(h for f in found for h in f), "<i8").reshape(-1, 2)
            ids = np.repeat(np.array(batch.column("doc_id"), np.int64), [len(f) for f in found])
            yield pa.record_batch([pa.array(ids), pa.array(np.ascontiguousarray(flat[:, 0])),
                                   pa.array(np.ascontiguousarray(flat[:, 1]))], ["doc_id", "h1", "h2"])

    held = docs.select(spaced.alias("doc_id"), F.col(text).alias("text"))
    lines = held.mapInArrow(hashes, "doc_id long, h1 long, h2 long").withColumn(
        "batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    lines = cut_lineage(lines, partition_by="batch") if batches > 1 else cut_lineage(lines)
    # repeated rows of one doc_id are in one batch; only they need the distinct
    repeated = held.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0
    for batch in range(batches):
        part = lines.filter(F.col("batch") == batch).select("h1", "h2", "doc_id")
        runs.add(part.distinct() if repeated else part)
    frequent = cut_lineage(runs.merged().filter(F.col("n") >= min_docs).select("h1", "h2", "keeper"))
    gone = (lines.join(frequent, ["h1", "h2"]).filter(F.col("doc_id") < F.col("keeper"))
            .groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("__gone")))
    joined = docs.withColumn("__key", spaced).join(
        gone.select(F.col("doc_id").alias("__key"), F.col("__gone.h1").alias("__g1"), F.col("__gone.h2").alias("__g2")),
        "__key", "left").drop("__key")
    names = docs.columns

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large(batches, text):
            columns = dict(zip(batch.schema.names, batch.columns))
            texts, total, dropped = [], [], []
            for t, g1, g2 in zip(*(columns[c].to_pylist() for c in (text, "__g1", "__g2"))):
                total.append((t or "").count("\n") + 1)
                if g1 is None:
                    texts.append(t)
                    dropped.append(0)
                    continue
                pairs = np.array([g1, g2], "<i8").T.tobytes()
                out = {pairs[k:k + 16] for k in range(0, len(pairs), 16)}
                kept = [line for line in lines_of(t) if line_hash(line, min_chars) not in out]
                texts.append("\n".join(kept))
                dropped.append(total[-1] - len(kept))
            columns[text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*(columns[n] for n in names), pa.array(total, pa.int64()),
                                              pa.array(dropped, pa.int64())], [*names, "__n_lines", "__n_dropped"])

    fields = [StructField(f.name, StringType()) if f.name == text else f for f in docs.schema.fields]
    return joined.mapInArrow(rebuild, StructType([*fields, StructField("__n_lines", LongType()),
                                                  StructField("__n_dropped", LongType())]))


def op4_line_dedup(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.*, f.key IS NOT NULL AND l.doc_id < f.keeper AS gone FROM lines l LEFT JOIN frequent f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
