r"""Document fingerprints by a homomorphic multiset hash.

Every paragraph (a line, split at \n) is hashed to one wide vector, and a document's fingerprint is the sum of the
vectors of its paragraphs, lane by lane modulo powers of two. So the order of paragraphs does not matter, and inserting
or deleting a paragraph adds or subtracts its vector. The vector has two parts:

* 32 lanes modulo 2^32, spread over all values, which decide equality;
* 256 lanes modulo 2^32, read as signed numbers, each the sum of signs of the paragraph's 24-byte windows at word
  starts. No text below 2^31 equal windows can wrap them. The inner product of two such parts estimates how many
  windows the documents share, and their cosine is the likeness (0 to 1, with a standard error of about 0.06).

Defined cases: null and empty texts have the fingerprint of one empty paragraph; equal fingerprints have likeness 1, a
text without windows has likeness 0 to any other; a null doc_id comes last in descending order; rows with equal doc_id
are ordered by their text's hash; a table of one row is its own successor; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelore.llm.common import large, order_chunks, partitions

EQUALITY_LANES, LIKENESS_LANES, WINDOW = 32, 256, 24
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_NULL = -(1 << 63)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C[3]
    h = (h ^ (h >> np.uint64(29))) * _C[0]
    return h ^ (h >> np.uint64(32))


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 32) uint32 and (texts, 256) int32 sums."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(WINDOW), np.uint8)
    size = len(joined) - WINDOW
    ends = np.flatnonzero(joined[:size] == 10)  # paragraph ends
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = np.cumsum([len(t) + 1 for t in texts]) - 1  # document ends are paragraph ends
    first = np.searchsorted(ends, np.concatenate([[0], last[:-1] + 1]))
    owner = np.searchsorted(last, ends)

    at = np.flatnonzero((joined[:size - 1] <= 32) | (joined[1:size] >= 0xE0)) + 1 if size > 1 else np.zeros(0, np.int64)
    at = np.union1d(at, starts)
    at = at[(joined[at] > 32)]
    paragraph = np.searchsorted(ends, at)
    windows = np.lib.stride_tricks.sliding_window_view(joined, WINDOW)[at]
    rest = ends[paragraph] - at
    short = np.flatnonzero(rest < WINDOW)
    windows[short] = np.where(np.arange(WINDOW) < rest[short, None], windows[short], 0)
    words = windows.view(np.uint64)
    h = mix(words[:, 0] * _C[0] + words[:, 1] * _C[1] + words[:, 2] * _C[2])
    lane = (h & np.uint64(LIKENESS_LANES - 1)).astype(np.int64)
    sign = ((h >> np.uint64(20)) & np.uint64(1)).astype(np.int64) * 2 - 1
    likeness = np.bincount(owner[paragraph] * LIKENESS_LANES + lane, sign, len(texts) * LIKENESS_LANES)
    likeness = likeness.astype(np.int64).astype(np.int32).reshape(len(texts), LIKENESS_LANES)

    # one cryptographic hash per paragraph, spread over the lanes
    view = memoryview(joined)
    seeds = np.frombuffer(b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest()
                                    for a, b in zip(starts, ends)]), "<u8").reshape(-1, 2)
    lanes = mix(seeds[:, :1] + seeds[:, 1:] * (2 * np.arange(EQUALITY_LANES, dtype=np.uint64) + np.uint64(1)))
    equality = np.add.reduceat((lanes >> np.uint64(32)).astype(np.uint32), first, axis=0, dtype=np.uint32)
    return equality, likeness


def join_vectors(equality: np.ndarray, likeness: np.ndarray) -> str:
    return equality.astype("<u4").tobytes().hex() + likeness.astype("<i4").tobytes().hex()


def _split(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[:4 * EQUALITY_LANES], "<u4"), np.frombuffer(raw[4 * EQUALITY_LANES:], "<i4")


def fingerprint(text: str | None) -> str:
    equality, likeness = vectors([(text or "").encode()])
    return join_vectors(equality[0], likeness[0])


def add(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of all paragraphs of `a` and those of `b` (sign 1), or of `a` without those of `b` (-1)."""
    (ea, la), (eb, lb) = _split(a), _split(b)
    if sign > 0:
        return join_vectors(ea + eb, la + lb)
    return join_vectors(ea - eb, la - lb)


def likeness_of(ea: np.ndarray, la: np.ndarray, eb: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Row by row; 1 for equal fingerprints."""
    a, b = la.astype(np.float64), lb.astype(np.float64)
    norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    cosine = np.clip((a * b).sum(axis=1) / np.where(norm > 0, norm, 1), 0, 1)
    same = (ea == eb).all(axis=1) & (la == lb).all(axis=1)
    return np.where(same, 1.0, cosine)


def likeness(a: str, b: str) -> float:
    (ea, la), (eb, lb) = _split(a), _split(b)
    return float(likeness_of(ea[None], la[None], eb[None], lb[None])[0])


def in_order(docs: DataFrame) -> DataFrame:
    """(chunk, carry, doc_id, h, text): whole texts dealt into chunks of neighbouring ids, and to each chunk, marked
    carry = 1, a copy of the document that follows its last one in descending order (after the last: the first)."""
    chunks = partitions(docs)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select(order_chunks(docs, "doc_id", chunks).cast("int").alias("chunk"), F.lit(0).alias("carry"), "doc_id",
                       F.xxhash64("text").alias("h"), "text")
    # one row per chunk
    heads = docs.groupBy("chunk").agg(F.max(F.struct("doc_id", "h")).alias("top"))
    heads = heads.select(F.col("chunk").alias("of"), F.coalesce(
        F.lead("chunk").over(Window.orderBy("chunk")), F.min("chunk").over(Window.partitionBy())).alias("chunk"), "top")
    carried = (docs.drop("carry", "chunk").join(F.broadcast(heads), (F.col("doc_id") == F.col("top.doc_id"))
                                                & (F.col("h") == F.col("top.h")))
               .groupBy("chunk").agg(F.min("doc_id").alias("doc_id"), F.min("h").alias("h"),
                                     F.min("text").alias("text"))
               .select("chunk", F.lit(1).alias("carry"), "doc_id", "h", "text"))
    return (docs.unionByName(carried).repartition(chunks, "chunk")
            .sortWithinPartitions("chunk", "carry", F.desc("doc_id"), F.desc("h")))


def op9_document_fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the document whose successor has not come yet, with its vectors
        for batch in large(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            ids, chunk, carry = (batch.column(c).to_pylist() for c in ("doc_id", "chunk", "carry"))
            equality, like = vectors([t.encode() for t in texts])
            rows = list(zip(ids, chunk, carry, texts, equality, like))
            if held is not None:
                rows.insert(0, held)
            held = rows.pop() if not rows[-1][2] else None
            followed = rows[1:] + ([held] if held is not None else [])
            pairs = [(a, b) for a, b in zip(rows, followed) if not a[2]]
            if not pairs:
                continue
            edited = []
            for a, b in pairs:
                k = len(a[3]) // 3
                edited.append((a[3][:len(a[3]) - k] + b[3][:k]).encode())
            ee, le = vectors(edited)
            ea, la = np.stack([a[4] for a, _ in pairs]), np.stack([a[5] for a, _ in pairs])
            eb, lb = np.stack([b[4] for _, b in pairs]), np.stack([b[5] for _, b in pairs])
            yield pa.record_batch([
                pa.array([None if a[0] == _NULL else a[0] for a, _ in pairs], pa.int64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                pa.array([join_vectors(x, y) for x, y in zip(ea, la)]),
                pa.array([join_vectors(x, y) for x, y in zip(ee, le)]),
                pa.array(likeness_of(ea, la, ee, le)), pa.array(likeness_of(ea, la, eb, lb))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                          "edited_fingerprint string, near_edited double, near_next double")
