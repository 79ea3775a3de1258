r"""Target-distribution importance resampling over hashed n-grams.

Texts are lowered in A-Z, and every byte outside `[0-9a-z\x80-\xFF]` (in code points: `[\x00-\x2F\x3A-\x60\x7B-\x7F]`)
is a separator. Runs of separators collapse to one space; then, for each n, an overlapped `finditer` whose lookarounds
hold the match between spaces or ends gives the spans of all runs of n words, and each span goes to its CRC-32 bucket.

1. One scan writes the words, features and buckets of every row to the checkpoint folder.
2. Buckets are counted per task with `bincount`, and at most `buckets` sums per table reach the driver.
3. A second pass over the stored buckets adds up the gains and the row's own Gumbel noise, a hash of seed and doc_id.
4. Eligible rows are ranked by ranges of (score, doc_id): places inside a range plus the rows of the ranges in front. No
   task holds more than a range, and a score or id that many rows share is split by the row's number.

Long texts are scanned in pieces of about `PIECE` bytes that end at a separator; the last n - 1 words go over to the next
piece, so no n-gram is lost.

Defined cases: null and empty texts, and texts without words, have no features and weight 0; a null doc_id is noised as
the empty id and comes after the others of its score; rows with one doc_id are scored and ranked one by one, in an order
that only rows with equal results can exchange; an empty table of either kind counts nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.llm.common import cut_lineage, large, ranked

PIECE = 4 << 20
_WORD = {*range(48, 58), *range(97, 123), *range(128, 256)}
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))


def _patterns(most: int) -> list:
    """One pattern for each n: n words with single spaces, between spaces or ends."""
    return [regex.compile(rb"(?<![^ ])[^ ]++" + rb" [^ ]++" * (n - 1) + rb"(?![^ ])") for n in range(1, most + 1)]


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """The text with spaces for separators, cut at spaces."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            piece = text[start:end].translate(_FOLD)
            while end < len(text) and piece[-1] != 32:  # a word must not be cut
                more = text[end:end + 4096].translate(_FOLD)
                stop = more.find(b" ")
                more = more if stop < 0 else more[:stop + 1]
                piece, end = piece + more, end + len(more)
        else:
            piece = text[start:].translate(_FOLD)
        yield piece
        start = end


def text_features(text: bytes, buckets: int, patterns: list, size: int = PIECE) -> tuple[int, np.ndarray]:
    """(words, buckets of all features) of a UTF-8 text."""
    words, found, rest = 0, [], b""
    for piece in _pieces(text, size):
        own = piece.split()
        if not own:
            continue
        line = b" ".join(own)
        words += len(own)
        for n, pattern in enumerate(patterns, 1):
            held = rest.split(b" ")[1 - n:] if rest and n > 1 else []
            spans = pattern.finditer(b" ".join([*held, line]), overlapped=True)
            found.append(np.fromiter((crc32(m[0]) for m in spans), np.uint32) % np.uint32(buckets))
        keep = len(patterns) - 1
        rest = b" ".join([*rest.split(), *own[-keep:]][-keep:]) if keep else b""
    return words, np.concatenate(found) if found else np.zeros(0, np.uint32)


def features(rows: DataFrame, buckets: int = 10_000, most: int = 2) -> DataFrame:
    """(doc_id, words, n_features, found) for rows (doc_id, text); `found` holds the buckets as 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _patterns(most)
        for batch in large(batches, "text"):
            got = [text_features((t or "").encode(), buckets, patterns) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([
                batch.column("doc_id"), pa.array([w for w, _ in got], pa.int64()),
                pa.array([len(b) for _, b in got], pa.int64()),
                pa.array([b.astype("<u4").tobytes() for _, b in got], pa.binary()),
            ], ["doc_id", "words", "n_features", "found"])

    return rows.mapInArrow(run, "doc_id long, words long, n_features long, found binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall in each bucket; every task sends at most one number a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in large(batches, "found"):
            for found in batch.column("found").to_pylist():
                counts += np.bincount(np.frombuffer(found, "<u4"), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(counts[some])], ["bucket", "n"])

    summed = rows.select("found").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in summed.collect():  # at most `buckets` rows
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(ratio of the smoothed shares)) of each bucket."""
    size = len(raw)
    total, wanted = float(raw.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((t + 1.0) * total / ((s + 1.0) * wanted)))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """1000 times a standard Gumbel variable that the id and the seed decide, rounded down."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def _scored(rows: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large(batches, "found"):
            weights = []
            for found in batch.column("found").to_pylist():
                own = np.frombuffer(found, "<u4")
                weights.append(int(gains[own].sum()) // len(own) if len(own) else 0)
            scores = [w + noise(d, seed) for w, d in zip(weights, batch.column("doc_id").to_pylist())]
            yield pa.record_batch([
                batch.column("doc_id"), batch.column("words"), batch.column("n_features"), pa.array(weights, pa.int64()),
                pa.array(scores, pa.int64())], ["doc_id", "words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, "doc_id long, words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000,
             most: int = 2, seed: int = 7) -> DataFrame:
    """(doc_id, words, n_features, weight, score, rank): `percent` of the rows with `least_words` words or more are
    drawn towards the texts of `target` without replacement; rank is null for the others."""
    raw = cut_lineage(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), buckets, most))
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, most)
    gains = bucket_gains(bucket_counts(raw, buckets), bucket_counts(wanted, buckets))
    scored = cut_lineage(_scored(raw, gains, seed).withColumn("__row", F.monotonically_increasing_id()))
    able = F.col("words") >= least_words
    count = scored.filter(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features"), F.asc("__row")]
    names = ["doc_id", "words", "n_features", "weight", "score"]
    places = ranked(scored.filter(able), order).select(
        *names, F.when(F.col("rank") <= count, F.col("rank")).alias("rank"))
    return places.unionByName(scored.filter(~able).select(*names, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Every row: doc_id, n_features, weight, score, rank (null: not drawn)."""
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
