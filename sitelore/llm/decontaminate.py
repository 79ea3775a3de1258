r"""Benchmark decontamination by spaced-seed hashing.

Fixed masks of five words with gaps slide over benchmark items and documents; words at ignored places do not count, so a
substituted word breaks few seeds. Where a document's seed hash equals an item's, the two are laid over each other on
that diagonal and the longest stretch in which at least 80 % of the words agree is taken. The document is contaminated
by the item if the stretch has `min_words` agreeing words, or 80 % of an item too short for that.

Words are runs without `[\x20\x09-\x0D]`, in lower case and without ASCII punctuation at their end. Items of five to
eleven words are cut into one part more than words of them may differ, and their parts are the seeds; from twelve words on
the masks meet every pattern that the rule admits. Items of fewer than five words name nothing and are ignored.

The benchmark is split into blocks of about BLOCK_WORDS words by a hash of the item id; each block is one read-only
table that goes to every task, and documents pass the blocks one after the other without a shuffle.

Defined cases: null and empty texts are clean; a null item id or text is ignored; repeated items count once per id; rows
with equal doc_id are judged one by one; an empty table of either kind gives no contamination; further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from sitelore.llm.common import large
from sitelore.llm.words import combine, word_hashes

MASKS = ((0, 1, 3, 6, 7), (0, 2, 3, 4, 8), (0, 1, 2, 5, 9))
BLOCK_WORDS = 1_000_000
HITS = "array<struct<item_id:long,matched:int,words:int,start:int>>"
_SHORT, _LEAST = 12, 5


class Seeds:
    """Seed hashes of a block of items, and the items' word hashes."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = 13, percent: int = 80):
        self.ids = [i for i, _ in items]
        self.min_words, self.percent = min_words, percent
        hashes, offsets = word_hashes([t.lower().encode() for _, t in items], bare=True)
        self.words = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        groups: dict[tuple[int, ...], list[tuple[int, range]]] = {m: [] for m in MASKS}
        for k, w in enumerate(self.words):
            n = len(w)
            if n >= _SHORT:
                for m in MASKS:
                    groups[m].append((k, range(n - m[-1])))
            elif n >= _LEAST:  # one part more than words that may differ: one of them is whole
                parts = n - self._wanted(n) + 1
                for i in range(parts):
                    first, end = i * n // parts, (i + 1) * n // parts
                    groups.setdefault(tuple(range(end - first)), []).append((k, range(first, first + 1)))
        self.tables = [(m, *self._table(m, found)) for m, found in groups.items() if found]

    def _wanted(self, n: int) -> int:
        """Agreeing words that an item of n words asks for."""
        return min(self.min_words, -(-self.percent * n // 100))

    def _table(self, mask: tuple[int, ...], found: list[tuple[int, range]]) -> tuple[np.ndarray, ...]:
        seed = np.concatenate([combine(self.words[k], list(mask))[places.start:places.stop] for k, places in found])
        item = np.repeat([k for k, _ in found], [len(places) for _, places in found])
        place = np.concatenate([np.arange(places.start, places.stop) for _, places in found])
        order = np.argsort(seed, kind="stable")
        bits = max(16, int(len(seed) * 16).bit_length())
        seen = np.zeros(1 << bits, bool)
        seen[seed >> np.uint64(64 - bits)] = True
        return seed[order], item[order], place[order], seen, np.uint64(64 - bits)

    def _overlap(self, doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
        """(agreeing words, words, start in the document) of the longest stretch on the diagonal."""
        low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        same = doc[low + diagonal:high + diagonal] == item[low:high]
        sums = np.r_[0, np.cumsum(np.where(same, 100 - self.percent, -self.percent))]
        agreed = np.r_[0, np.cumsum(same)]
        begin = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
        end = int(np.argmax(agreed - agreed[begin]))
        start = int(begin[end])
        return int(agreed[end] - agreed[start]), end - start, low + diagonal + start

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        hashes, offsets = word_hashes([(t or "").lower().encode() for t in texts], bare=True)
        found = []
        for mask, seeds, item, place, seen, shift in self.tables:
            h = combine(hashes, list(mask))
            at = np.flatnonzero(seen[h >> shift])
            left, right = np.searchsorted(seeds, h[at], "left"), np.searchsorted(seeds, h[at], "right")
            n = right - left
            at, left, n = at[n > 0], left[n > 0], n[n > 0]
            doc = np.searchsorted(offsets, at, "right") - 1
            inside = at + mask[-1] < offsets[doc + 1]  # seeds must not run into the next document
            at, left, n, doc = at[inside], left[inside], n[inside], doc[inside]
            entry = np.repeat(left - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
            found.append(np.column_stack([np.repeat(doc, n), item[entry],
                                          np.repeat(at - offsets[doc], n) - place[entry]]))
        if not found:
            return out
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, diagonal in np.unique(np.vstack(found), axis=0).tolist():
            got = self._overlap(hashes[offsets[d]:offsets[d + 1]], self.words[k], diagonal)
            if got[0] >= self._wanted(len(self.words[k])):
                best[d, k] = max(best.get((d, k), (0, 0, 0)), got)
        for (d, k), (matched, words, start) in sorted(best.items()):
            out[d].append({"item_id": self.ids[k], "matched": matched, "words": words, "start": start})
        return out


def _blocks(benchmark: DataFrame, min_words: int, percent: int, block_words: int) -> Iterator[Seeds]:
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy(
        F.col("item_id").cast("long").alias("item_id"), F.col("text")).agg(F.lit(1).alias("one"))
    words = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    count = words // block_words + 1
    for k in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).orderBy("item_id", "text")
        block = [(r["item_id"], r["text"]) for r in rows.select("item_id", "text").collect()]  # about block_words words
        if block:
            yield Seeds(block, min_words, percent)


def annotate(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, percent: int = 80, text: str = "text",
             block_words: int = BLOCK_WORDS, drop: bool = False) -> DataFrame:
    """`docs` with the column __hits; with `drop`, only the clean documents and their own columns."""
    names = docs.columns
    out = docs
    if not drop:
        out = docs.withColumn("__hits", F.expr(f"cast(array() as {HITS})"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("matched", pa.int32()), ("words", pa.int32()),
                               ("start", pa.int32())]))
    for seeds in _blocks(benchmark, min_words, percent, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in large(batches, text, 2 << 20):
                hits = shared.value.find(batch.column(batch.schema.get_field_index(text)).to_pylist())
                if drop:
                    yield batch.filter(pa.array([not h for h in hits]))
                else:
                    before = batch.column(len(names)).to_pylist()
                    both = pa.array([a + b for a, b in zip(before, hits)], kind)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], both], [*names, "__hits"])

        fields = list(docs.schema.fields)
        if not drop:
            fields.append(StructField("__hits", _parse_datatype_string(HITS)))
        out = out.mapInArrow(run, StructType(fields))
    return out


def op2_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, contaminated, item_ids (ascending), matched (agreeing words of the best item)."""
    rows = annotate(docs.select("doc_id", "text"), benchmark)
    return rows.select("doc_id", (F.size("__hits") > 0).alias("contaminated"),
                       F.array_sort(F.array_distinct(F.col("__hits.item_id"))).alias("item_ids"),
                       F.coalesce(F.array_max(F.col("__hits.matched")), F.lit(0)).alias("matched"))
