"""Bounded-space online best-fit packing of token sequences.

A packer keeps at most `open_bins` open bins. Bit f of one integer is set when a bin with f free tokens is open, so the
tightest bin that takes a piece is the lowest set bit at or above its length. A piece that fits nowhere opens a bin; if
all are in use, the fullest (the lowest set bit) closes first. Only documents longer than a sequence are cut: all their
pieces but the first are full sequences.

Documents are dealt to packers by their place in the order of a hash of id and checksums, at most `per_packer` documents to
each, however many are equal, so a packer's state and rows are bounded and packers run side by side; rows carry lengths
and checksums, never ids. A packer is fed its longest first pieces first.

Defined cases: a null or empty text is its end id alone, one piece; a null doc_id is a document like any other; equal
rows are packed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.llm.common import cut_lineage, large, ranked, small_batches
from sitelore.llm.tokens import default_path, encoder

CAPACITY = 1024
OPEN_BINS = 65_536
PER_PACKER = 50_000
#: pieces of text whose ids a worker keeps, fewer than by default: the stages before have grown the executor
CACHED = 400_000


class BestFit:
    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.n_open = self.made = 0

    def _take(self, space: int) -> int:
        stack = self.by_space[space]
        number = stack.pop()
        if not stack:
            self.bits ^= 1 << space
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to `capacity` tokens."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.n_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.n_open -= 1
            space, number = self.capacity, self.made
            self.made += 1
            self.n_open += 1
        left = space - length
        if left:
            self.by_space[left].append(number)
            self.bits |= 1 << left
        else:
            self.n_open -= 1
        return number, self.capacity - space


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than a sequence."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, end: int, capacity: int) -> DataFrame:
    """(doc_id, h, n, crcs) per document, crcs with one checksum per piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, CACHED)
        for batch in large(batches, "text", 4 << 20, "tokens"):
            found = [x.astype("<u4") for x in tokens.encode(batch.column("text").to_pylist(), end)]
            yield pa.record_batch([
                batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()),
                pa.array([[zlib.crc32(x[s:s + k].tobytes()) for s, k in cut(len(x), capacity)] for x in found],
                         pa.list_(pa.int64()))], ["doc_id", "n", "crcs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, crcs array<long>")


def pack(docs: DataFrame, path: str | None = None, end: int = 2, capacity: int = CAPACITY,
         open_bins: int = OPEN_BINS, per_packer: int = PER_PACKER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    with small_batches(docs.sparkSession):
        rows = cut_lineage(pieces(docs, path or default_path(), end, capacity).withColumn(
            "h", F.xxhash64("doc_id", "crcs")).withColumn("row", F.monotonically_increasing_id()))
    share = -(-rows.count() // (rows.count() // per_packer + 1)) or 1
    rows = ranked(rows, ["h", "row"], "place").withColumn("packer", F.expr(f"(place - 1) div {share}")).drop("h", "row", "place")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fit = BestFit(capacity, open_bins)
        # long first pieces first: the short ones then fill the gaps; while bins are left open nothing closes early
        frame = frame.assign(r=(frame["n"] - 1) % capacity, c=[int(x[0]) for x in frame["crcs"]])
        frame = frame.sort_values(["r", "n", "c", "doc_id"], ascending=False, kind="stable")
        base = int(frame["packer"].iloc[0]) << 40
        out: list[tuple] = []
        whole = 0
        for doc_id, n, crcs in zip(frame["doc_id"], frame["n"], frame["crcs"]):
            for k, ((start, length), crc) in enumerate(zip(cut(int(n), capacity), crcs)):
                if length == capacity:  # even numbers are full pieces, odd ones packed bins
                    sequence, offset = 2 * whole, 0
                    whole += 1
                else:
                    number, offset = fit.place(length)
                    sequence = 2 * number + 1
                out.append((doc_id, k, start, length, crc, base + sequence, offset))
        columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        result = pd.DataFrame(out, columns=columns)
        result["doc_id"] = result["doc_id"].astype("Int64")
        return result

    return rows.groupBy("packer").applyInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
