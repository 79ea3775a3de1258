"""Token-id output in patched frame-of-reference blocks.

A segment is a byte string of little-endian 64-bit words:

    magic | documents n | ids m | blocks b | doc_ids n | lengths n | block starts b | blocks

A block holds 256 ids: a head word (minimum | width << 32 | exceptions << 40), 4 * width words with the ids less the
minimum packed at `width` bits, and one word (place << 32 | value) per id that needs more bits. The width is the least
that fits 98 % of the block. Block starts index the blocks, so `read_block` decodes one block alone. Segments are rows
of a Parquet table (shard, segment, documents, ids, data), which gives them Spark's commit protocol in any store; shards
are ranges of doc_id and segments within a shard ascend too.

Defined cases: a null or empty text is its end id alone; null doc_ids sort first and are kept as nulls; equal doc_ids
follow each other ordered by length and checksum; an empty table writes an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore.llm.common import before, cut_lineage, large, order_chunks, partitions
from sitelore.llm.tokens import default_path, encoder

MAGIC = 0x31524F4650
BLOCK = 256
FIT = 0.98
#: ids after which a segment is closed
SEGMENT_IDS = 1 << 20
_NULL = -(1 << 63)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 256) values below 2 ** width to (blocks, 4 * width) words."""
    v = np.ascontiguousarray(values.astype(np.uint64).reshape(len(values), 4, 64).transpose(2, 0, 1))
    out = np.zeros((width, len(values), 4), np.uint64)
    for k in range(64):
        q, r = divmod(k * width, 64)
        out[q] |= v[k] << np.uint64(r)
        if r + width > 64:
            out[q + 1] |= v[k] >> np.uint64(64 - r)
    return out.transpose(1, 2, 0).reshape(len(values), 4 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = np.ascontiguousarray(words.reshape(len(words), 4, width).transpose(2, 0, 1))
    out = np.empty((64, len(words), 4), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        q, r = divmod(k * width, 64)
        x = w[q] >> np.uint64(r)
        if r + width > 64:
            x = x | (w[q + 1] << np.uint64(64 - r))
        out[k] = x & mask
    return out.transpose(1, 2, 0).reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block starts, words) of ids below 2 ** 32."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    full = np.empty(count * BLOCK, np.uint32)
    full[:len(ids)] = ids
    full[len(ids):] = ids[-1]
    full = full.reshape(count, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    fit = np.partition(rest, int(FIT * BLOCK) - 1, axis=1)[:, int(FIT * BLOCK) - 1]
    width = np.where(fit > 0, np.floor(np.log2(np.maximum(fit, 1))).astype(np.int64) + 1, 0)
    outlier = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    exceptions = outlier.sum(axis=1)
    sizes = 1 + 4 * width + exceptions
    starts = np.concatenate([[0], np.cumsum(sizes)])
    words = np.zeros(int(starts[-1]), np.uint64)
    words[starts[:-1]] = (low.astype(np.uint64) | (width.astype(np.uint64) << np.uint64(32))
                          | (exceptions.astype(np.uint64) << np.uint64(40)))
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            kept = rest[rows].astype(np.uint64) & np.uint64((1 << int(w)) - 1)
            words[(starts[rows] + 1)[:, None] + np.arange(4 * w)] = _pack(kept, int(w))
    row, place = np.nonzero(outlier)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    words[starts[row] + 1 + 4 * width[row] + rank] = (place.astype(np.uint64) << np.uint64(32)) | rest[row, place]
    return starts[:-1].astype(np.uint64), words


def decode_blocks(starts: np.ndarray, words: np.ndarray, count: int) -> np.ndarray:
    starts = starts.astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    head = words[starts]
    low = (head & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    width = ((head >> np.uint64(32)) & np.uint64(0xFF)).astype(np.int64)
    exceptions = (head >> np.uint64(40)).astype(np.int64)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            out[rows] = _unpack(words[(starts[rows] + 1)[:, None] + np.arange(4 * w)], int(w))
    row = np.repeat(np.arange(len(starts)), exceptions)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    patch = words[starts[row] + 1 + 4 * width[row] + rank]
    out[row, (patch >> np.uint64(32)).astype(np.int64)] = (patch & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out += low[:, None]
    return out.reshape(-1)[:count]


def write_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    starts, words = encode_blocks(ids)
    head = np.array([MAGIC, len(doc_ids), len(ids), len(starts)], np.uint64)
    return b"".join(x.astype("<u8").tobytes() for x in (
        head, doc_ids.astype(np.int64).view(np.uint64), lengths.astype(np.uint64), starts, words))


def _parts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    words = np.frombuffer(data, "<u8")
    if len(words) < 4 or words[0] != MAGIC:
        raise ValueError("not a token segment")
    n, m, b = (int(x) for x in words[1:4])
    at = np.cumsum([4, n, n, b])
    return words[4:at[1]].view(np.int64), words[at[1]:at[2]].astype(np.int64), words[at[2]:at[3]], words[at[3]:], m


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids)."""
    doc_ids, lengths, starts, words, m = _parts(data)
    return doc_ids, lengths, decode_blocks(starts, words, m)


def read_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by the index of block starts."""
    _, _, starts, words, m = _parts(data)
    return decode_blocks(starts[block:block + 1], words, min(BLOCK, m - block * BLOCK))


def encode_documents(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(chunk, doc_id, n, crc, ids): ids are compressed for the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in large(batches, "text", 4 << 20, "tokens"):
            found = tokens.encode(batch.column("text").to_pylist(), end)
            wide = [x.astype("<u4").tobytes() for x in found]
            yield pa.record_batch([
                batch.column("chunk"), batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()),
                pa.array([zlib.crc32(x) for x in wide], pa.int64()),
                pa.array([squeeze.compress(x.astype("<u2").tobytes() if x.max() < 65536 else y)
                          for x, y in zip(found, wide)], pa.binary())], ["chunk", "doc_id", "n", "crc", "ids"])

    return docs.mapInArrow(run, "chunk int, doc_id long, n long, crc long, ids binary")


def write_tokens(docs: DataFrame, path: str | None = None, end: int = 2) -> DataFrame:
    """Write the table of segments and return it: (shard, segment, documents, ids, data)."""
    path = path or default_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = partitions(docs)
    chunk = order_chunks(docs, "doc_id", shards)
    coded = encode_documents(docs.withColumn("chunk", chunk.cast("int")), path, end)
    ordered = coded.repartition(shards, "chunk").sortWithinPartitions("chunk", "doc_id", "n", "crc")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        shard, number, held = None, 0, []
        total = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            data = write_segment(np.array([d for d, _ in held], np.int64), np.array([len(x) for _, x in held]), ids)
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([number], pa.int32()),
                                    pa.array([len(held)], pa.int64()), pa.array([len(ids)], pa.int64()),
                                    pa.array([data], pa.large_binary()).cast(pa.binary())],
                                   ["shard", "segment", "documents", "ids", "data"])

        for batch in large(batches, "ids", 4 << 20):
            for c, d, n, ids in zip(*(batch.column(k).to_pylist() for k in ("chunk", "doc_id", "n", "ids"))):
                if held and (c != shard or total >= SEGMENT_IDS):
                    yield close()
                    number, held, total = (number + 1 if c == shard else 0), [], 0
                elif c != shard:
                    number = 0
                shard = c
                raw = expand.decompress(ids)
                held.append((_NULL if d is None else d, np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")))
                total += n
        if held:
            yield close()

    return cut_lineage(ordered.mapInArrow(segments, "shard int, segment int, documents long, ids long, data binary"))


def segment_starts(table: DataFrame) -> DataFrame:
    """(shard, segment, base): ids in front of each segment; sums within shards, then over the shard totals."""
    sizes = table.select("shard", "segment", F.col("ids").alias("n"))
    shards = before(sizes.groupBy("shard").agg(F.sum("n").alias("n")), [], ["shard"], "n", "shard_base")
    inside = before(sizes, ["shard"], ["segment"], "n", "inside")
    return inside.join(shards.select("shard", "shard_base"), "shard").select(
        "shard", "segment", (F.col("shard_base") + F.col("inside")).alias("base"))


def read_tokens(table: DataFrame) -> DataFrame:
    """Per document of the files: (doc_id, start, n_tokens, ids_crc32)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large(batches, "data"):
            for shard, segment, data in zip(*(batch.column(k).to_pylist() for k in ("shard", "segment", "data"))):
                doc_ids, lengths, ids = read_segment(data)
                ends = np.cumsum(lengths)
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(ends - lengths, ends)]
                yield pa.record_batch([
                    pa.array(np.full(len(ends), shard, np.int32)), pa.array(np.full(len(ends), segment, np.int32)),
                    pa.array(doc_ids, mask=doc_ids == _NULL), pa.array(ends - lengths), pa.array(lengths),
                    pa.array(crc, pa.int64())], ["shard", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = table.select("shard", "segment", "data").mapInArrow(
        run, "shard int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(segment_starts(table), ["shard", "segment"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_tokens(write_tokens(docs, path))
