"""Removal of repeated 400-byte strings by a distributed sparse suffix sort.

Every string of `LENGTH` bytes belongs to one anchor inside it: the place whose 32-byte window has the smallest hash
(the leftmost of equals), which depends on the string alone. So equal strings meet at equal anchors at the same distance,
and only anchors, about one in 185 bytes, are sorted:

1. Anchor hashes that occur once in the corpus are dropped; hashes are dealt by ranges of (hash, document).
2. The other anchors are sent with the bytes their strings cover: up to 368 to the left and up to 400 to the right.
3. Anchors of one hash are ordered by their right sides with deep-shallow sorting: multikey quicksort to `SHALLOW` bytes,
   then a blind trie for each group with a longer common prefix. Neighbours are merged from the longest common prefix to
   the shortest, and in each merged set the neighbours by left side give every anchor its longest common left side. A
   string at distance d repeats when some other anchor shares d bytes to the left and LENGTH - d to the right.
4. Repeated strings of an anchor cover one interval; intervals are united per document and cut out.

An anchor hash with more than `HOT` places, those of one document with equal surroundings taken as one, is not gathered:
equal surroundings are counted first (partial sums before the shuffle), and the strings of the different ones are
compared by 128-bit hashes, again by counting. A string holds the LENGTH / 2 bytes to the left of its anchor or those
to the right, so surroundings that share neither half with others are left out of that.

Defined cases: null text is empty; texts below LENGTH bytes lose nothing; a repeat within one document counts, also when
it overlaps itself; rows equal in id and text repeat each other and so lose every byte that LENGTH covers; null ids are
ids like any other; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from sitelore.llm.common import cut_lineage, large, partitions, text_bytes
from sitelore.llm.ngram_join import _repeated

LENGTH, GRAM, SHALLOW, HOT = 400, 32, 64, 20_000
_SPAN = LENGTH - GRAM + 1  # anchor places in a string
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_PIECE = 1 << 22
_PLACE_BITS = np.uint64(24)


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place."""
    b = np.concatenate([data, np.zeros(GRAM, np.uint8)])
    v = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << np.uint16(8))
    v = v[:-2].astype(np.uint32) | (v[2:].astype(np.uint32) << np.uint32(16))
    v = v[:-4].astype(np.uint64) | (v[4:].astype(np.uint64) << np.uint64(32))
    n = len(data) - GRAM + 1
    h = v[:n] * _C[0]
    for k in (1, 2, 3):
        h ^= h >> np.uint64(29)
        h += v[8 * k:8 * k + n] * _C[k]
    h *= _C[0]
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): the strings that start from first to last belong to the anchor at place."""
    total = len(data) - LENGTH + 1
    out = []
    for begin in range(0, total, _PIECE):
        n = min(_PIECE, total - begin)
        h = _hashes(data[begin:begin + n + LENGTH - 1])
        key = ((h >> _PLACE_BITS) << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
        # smallest of every _SPAN neighbours from running minima of blocks
        blocks = -(-len(key) // _SPAN)
        full = np.full(blocks * _SPAN, np.uint64(0xFFFFFFFFFFFFFFFF))
        full[:len(key)] = key
        full = full.reshape(blocks, _SPAN)
        ahead = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        behind = np.minimum.accumulate(full, axis=1).reshape(-1)
        least = np.minimum(ahead[:n], behind[_SPAN - 1:_SPAN - 1 + n])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        at = place[cut]
        out.append((h[at], at + begin, cut + begin, np.r_[cut[1:], n] - 1 + begin))
    if not out:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in zip(*out))


def lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return (8 * n - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length()) // 8


class BlindTrie:
    """A compact trie that stores only branching bytes and depths; strings are compared once per insertion."""

    def __init__(self) -> None:
        self.root: list | None = None  # inner node: [depth, {byte: child}], leaf: [strings' numbers]

    @staticmethod
    def _byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, number: int, strings: list[bytes]) -> None:
        s = strings[number]
        if self.root is None:
            self.root = [number]
            return
        node = self.root
        while len(node) == 2 and isinstance(node[1], dict):  # blind descent: any leaf below a missing branch will do
            node = node[1].get(self._byte(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[0]]
        common = lcp(s, other)
        if common == len(s) == len(other):
            node.append(number)
            # a leaf of exactly [number, number] is no inner node: its second item is no dict
            return
        parent, branch, node = None, 0, self.root
        while len(node) == 2 and isinstance(node[1], dict) and node[0] < common:
            parent, branch = node, self._byte(s, node[0])
            node = node[1][branch]
        if len(node) == 2 and isinstance(node[1], dict) and node[0] == common:
            node[1][self._byte(s, common)] = [number]
            return
        split = [common, {self._byte(other, common): node, self._byte(s, common): [number]}]
        if parent is None:
            self.root = split
        else:
            parent[1][branch] = split

    def in_order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if len(node) == 2 and isinstance(node[1], dict):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow_sort(strings: list[bytes]) -> list[int]:
    """Numbers of the strings in order: multikey quicksort on 8 bytes at a time, blind tries from SHALLOW bytes on."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out.append(group[0])
            continue
        if depth >= SHALLOW:
            trie = BlindTrie()
            for k in group:
                trie.insert(k, strings)
            out.extend(trie.in_order())
            continue
        pivot = sorted(strings[group[k]][depth:depth + 8] for k in (0, len(group) // 2, -1))[1]
        low, same, high = [], [], []
        for k in group:
            part = strings[k][depth:depth + 8]
            (low if part < pivot else same if part == pivot else high).append(k)
        if len(pivot) < 8:  # all of these end here
            parts = [(low, depth), (same, SHALLOW), (high, depth)]
        else:
            parts = [(low, depth), (same, depth + 8), (high, depth)]
        stack.extend(p for p in reversed(parts) if p[0])
    return out


def repeated_distances(lefts: list[bytes], rights: list[bytes]) -> list[tuple[int, int] | None]:
    """For each of several different (left, right) surroundings of one anchor hash: the smallest and the largest
    distance d at which left[-d:] + right[:LENGTH - d] is a string of another one too."""
    n = len(lefts)
    low, high = [LENGTH + 1] * n, [-1] * n
    back = [x[::-1] for x in lefts]

    def meet(i: int, j: int, right: int) -> None:
        left = lcp(back[i], back[j])
        for k in (i, j):
            a, b = max(LENGTH - len(rights[k]), LENGTH - right), min(len(lefts[k]), left)
            if a <= b:
                low[k], high[k] = min(low[k], a), max(high[k], b)

    if n <= 4:
        for i in range(n):
            for j in range(i):
                meet(i, j, lcp(rights[i], rights[j]))
    else:
        by_right = deep_shallow_sort(rights)
        by_left = deep_shallow_sort(back)
        rank = [0] * n
        for r, k in enumerate(by_left):
            rank[k] = r
        edges = sorted(((lcp(rights[a], rights[b]), p) for p, (a, b) in enumerate(zip(by_right, by_right[1:]))),
                       reverse=True)
        owner = list(range(n))  # set of each place in by_right
        members = [[rank[k]] for k in by_right]

        def find(x: int) -> int:
            while owner[x] != x:
                owner[x] = owner[owner[x]]
                x = owner[x]
            return x

        for common, p in edges:
            a, b = find(p), find(p + 1)
            if len(members[a]) < len(members[b]):
                a, b = b, a
            big = members[a]
            for r in members[b]:  # the smaller set goes into the larger one
                at = bisect_left(big, r)
                if at:
                    meet(by_left[r], by_left[big[at - 1]], common)
                if at < len(big):
                    meet(by_left[r], by_left[big[at]], common)
                insort(big, r)
            owner[b], members[b] = a, []
    return [(a, b) if b >= 0 else None for a, b in zip(low, high)]


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
    for k in range(batch.num_rows):
        if offsets[k + 1] - offsets[k] >= LENGTH:
            yield k, data[offsets[k]:offsets[k + 1]]


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _anchor_hashes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large(batches, "text", 4 << 20):
            keys = np.array(batch.column("key"), np.int64)
            for k, data in _documents(batch):
                h = anchors(data)[0].view(np.int64)
                yield pa.record_batch([pa.array(h), pa.array(np.full(len(h), keys[k]))], ["hash", "rep"])

    return docs.mapInArrow(_merged(run, ["hash", "rep"]), "hash long, rep long")


def _merged(run, names: list[str], rows: int = 20_000):
    """Joins the small batches of `run`."""
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return merged


_SURROUND = "key long, hash long, place long, first long, last long, lefts binary, rights binary"


def _surroundings(docs: DataFrame) -> DataFrame:
    """Rows of _SURROUND, and rows of hash null for intervals first to last that repeat within their own document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("hash", pa.int64()), ("place", pa.int64()), ("first", pa.int64()),
                            ("last", pa.int64()), ("lefts", pa.binary()), ("rights", pa.binary())])
        for batch in large(batches, "text", 2 << 20):
            keys, wanted = (batch.column(c).to_pylist() for c in ("key", "shared"))
            rows: list[tuple] = []
            for k, data in _documents(batch):
                h, place, first, last = anchors(data)
                chosen = np.flatnonzero(np.isin(h.view(np.int64), np.array(wanted[k], np.int64)))
                raw = data.tobytes()
                seen: dict[tuple[bytes, bytes], int] = {}
                inner: list[tuple[int, int]] = []
                for code, p, a, b in zip(h.view(np.int64)[chosen].tolist(), place[chosen].tolist(),
                                         first[chosen].tolist(), last[chosen].tolist()):
                    pair = raw[a:p], raw[p:b + LENGTH]
                    if pair in seen:  # every string here occurs twice in this document
                        inner += [(a, b + LENGTH), (seen[pair], seen[pair] + b - a + LENGTH)]
                        continue
                    seen[pair] = a
                    rows.append((keys[k], code, p, a, b, *pair))
                rows += [(keys[k], None, None, a, b, None, None) for a, b in _united(inner)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.mapInArrow(run, _SURROUND)


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """(key, first, last) intervals of rows sorted by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        code = None

        def close() -> list[tuple[int, int, int]]:
            same: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
            for key, place, _, _, left, right in held:
                same.setdefault((left, right), []).append((key, place))
            pairs = list(same)
            found = repeated_distances([p[0] for p in pairs], [p[1] for p in pairs]) if len(pairs) > 1 else [None]
            out = []
            for pair, span in zip(pairs, found):
                owners = same[pair]
                if len(owners) > 1:  # every string of equal surroundings repeats
                    span = LENGTH - len(pair[1]), len(pair[0])
                if span is not None:
                    out += [(key, place - span[1], place - span[0] + LENGTH) for key, place in owners]
            return out

        for batch in large(batches, "rights"):
            out: list[tuple[int, int, int]] = []
            columns = (batch.column(c).to_pylist() for c in ("hash", "key", "place", "first", "last", "lefts", "rights"))
            for h, *row in zip(*columns):
                if h != code and held:
                    if len(held) > 1:
                        out += close()
                    held = []
                code = h
                held.append(tuple(row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["key", "first", "last"])
        if len(held) > 1 and (out := close()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["key", "first", "last"])

    return rows.mapInArrow(run, "key long, first long, last long")


def _counted_groups(rows: DataFrame) -> DataFrame:
    """The same intervals by counting alone: first equal surroundings, then the strings of one of each."""
    rows = rows.withColumn("c", F.sha2(F.concat(F.hex("lefts"), F.lit("|"), F.hex("rights")), 256))
    each = rows.groupBy("hash", "c").agg(F.count("*").alias("n"), F.min("lefts").alias("lefts"),
                                         F.min("rights").alias("rights"))
    half = LENGTH // 2

    def code(side: str, part: str) -> Column:  # a side too short for a half gets a code of its own
        return F.when(F.octet_length(side) >= half, F.xxhash64("hash", F.expr(part))).otherwise(F.xxhash64("hash", "c"))

    each = cut_lineage(each.withColumn("l", code("lefts", f"substring(lefts, -{half}, {half})"))
                       .withColumn("r", code("rights", f"substring(rights, 1, {half})")))

    def common(side: str) -> DataFrame:
        return each.groupBy(side).agg(F.sum("n").alias("m")).filter("m > 1").select(side, F.lit(True).alias(f"by_{side}"))

    halves = each.join(common("l"), "l", "left").join(common("r"), "r", "left").filter("by_l or by_r").select(
        "hash", "c", "n", "lefts", "rights", "by_l", "by_r")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large(batches, "rights", 1 << 16):
            out = []
            for h, c, n, left, right, by_left, by_right in zip(*(col.to_pylist() for col in batch.columns)):
                raw = left + right
                least, most = LENGTH - len(right), len(left)
                for d in range(least if by_right else max(least, half), (most if by_left else min(most, half - 1)) + 1):
                    a = len(left) - d
                    out.append((h, c, min(n, 2), d, hashlib.blake2b(raw[a:a + LENGTH], digest_size=16).digest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["hash", "c", "n", "d", "s"])

    single = halves.mapInArrow(strings, "hash long, c string, n long, d long, s binary")
    twice = single.groupBy("s").agg(F.sum("n").alias("m")).filter("m > 1").select("s")
    spans = single.join(twice, "s").groupBy("hash", "c").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    return rows.select("hash", "c", "key", "place").join(spans, ["hash", "c"]).select(
        "key", (F.col("place") - F.col("high")).alias("first"), (F.col("place") - F.col("low") + LENGTH).alias("last"))


def dedup(docs: DataFrame, row_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """`docs` with the binary column __kept (the bytes that stay), and __n_bytes, __n_removed, __n_spans."""
    # one key for rows that are equal in id and text: they repeat each other
    key = F.xxhash64(F.col(row_id), F.octet_length(text), F.col(text), F.lit(5))
    keyed = docs.withColumn("__key", key)
    slim = keyed.select(F.col("__key").alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") >= LENGTH)
    twins = slim.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1")
    hashes = _anchor_hashes(slim)
    ranges = hashes.repartitionByRange(partitions(docs), "hash", "rep").sortWithinPartitions("hash", "rep")
    shared = cut_lineage(_repeated(ranges))
    lists = shared.groupBy(F.col("rep").alias("key")).agg(F.collect_list("hash").alias("shared"))
    sent = slim.dropDuplicates(["key"]) if twins.limit(1).count() else slim
    rows = cut_lineage(_surroundings(sent.join(lists, "key").select("key", "text", "shared")))
    placed = rows.filter("hash is not null")
    # places, not documents: one document can hold a hash at thousands of places
    crowded = cut_lineage(placed.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("hash"))
    counted = crowded.limit(1).count() > 0
    few = placed.join(crowded, "hash", "left_anti") if counted else placed
    found = _sorted_groups(few.repartition(partitions(docs), "hash").sortWithinPartitions("hash", "key", "place"))
    if counted:
        found = found.unionByName(_counted_groups(placed.join(crowded, "hash", "left_semi")))
    found = found.unionByName(rows.filter("hash is null").select("key", "first", "last"))
    spans = found.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("__spans"))
    joined = keyed.join(spans.withColumnRenamed("key", "__key"), "__key", "left").join(
        twins.select(F.col("key").alias("__key"), F.col("copies").alias("__copies")), "__key", "left").drop("__key")
    joined = joined.select("*", F.col("__spans.first").alias("__a"), F.col("__spans.last").alias("__b")).drop("__spans")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large(batches, text, 4 << 20):
            columns = dict(zip(batch.schema.names, batch.columns))
            out = []
            for t, a, b, copies in zip(*(columns[c].to_pylist() for c in (text, "__a", "__b", "__copies"))):
                raw = (t or "").encode()
                spans = [(0, len(raw))] if copies else _united(list(zip(a, b))) if a else []
                kept, at = [], 0
                for x, y in spans:
                    kept.append(raw[at:x])
                    at = y
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((rest, len(raw), len(raw) - len(rest), len(spans)))
            yield pa.RecordBatch.from_arrays(
                [*(columns[n] for n in names), *(pa.array(c, k) for c, k in zip(zip(*out), (
                    pa.binary(), pa.int64(), pa.int64(), pa.int64())))],
                [*names, "__kept", "__n_bytes", "__n_removed", "__n_spans"])

    extra = [StructField(n, LongType()) for n in ("__n_bytes", "__n_removed", "__n_spans")]

    return joined.mapInArrow(cut, StructType([*docs.schema.fields, StructField("__kept", BinaryType()), *extra]))


def op1_suffix_dedup(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"),
        F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))
