r"""Toxicity by a string-subsequence-kernel support vector machine with Nyström landmarks.

Strings are the words of a sentence, lower-cased, with marks for their two ends; runs of single characters are joined
to one string as well. The kernel counts common subsequences of 3 and 4 characters, each weighted by DECAY to the power
of its span (at most SPAN more than contiguous), so gapped and inserted characters lower a match but do not end it, and
is normalised. Strings of fewer than 3 characters take no part. Landmarks are words of both classes; a string's features are its
kernel values with the landmarks times the inverse root of the landmarks' own kernel matrix (Nyström), and a linear SVM
(squared hinge) is fitted on them. Because the kernel is a sum over subsequences, the fitted function collapses to one
weight per subsequence of the landmarks, which is what tasks evaluate.

Only documents are labelled. Sentences of clean documents are clean; in toxic ones the strings whose presence is far
likelier in toxic than in clean documents are taken as the toxic instances, the rest stays unlabelled. ROUNDS rounds of
mining add the strings of clean documents that score highest. A document's score is a
logistic function of its two highest string values, fitted on the same sample.

The fit uses at most SAMPLE labelled documents, chosen by a hash of the id, and only those whose
crc32(doc_id) mod 5 is not 0. Scoring uses the text alone, whole.

Defined cases: null and empty texts get the score of a text without a known string; null labels and null ids are not
used; of several labels for one id any toxic one counts; without labels of both classes every score is 0; repeated rows
are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sitelore.llm.common import cut_lineage, hold, large
from sitelore.llm.fingerprints import mix

DECAY, SPAN = 0.7, 3
#: string values below it count as it
FLOOR = -0.5
LANDMARKS, POSITIVES, NEGATIVES, MINED, ROUNDS = 384, 800, 5000, 1500, 3
#: labelled documents used for fitting
SAMPLE = 4000
#: strings are cut into overlapping pieces of at most this length
LONGEST = 32
_TABLE = 1 << 20
_PATTERNS = [(0, *np.cumsum(steps)) for n in (3, 4)
             for steps in itertools.product(range(1, SPAN + 2), repeat=n - 1) if sum(steps) <= n - 1 + SPAN]
_SINGLES = re.compile(r"(?<!\S)\w(?:\s\w)+(?!\w)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
CACHED = 400_000


def strings_of(text: str) -> set[str]:
    """The distinct strings of a text."""
    low = text.lower()
    words = set(low.split())
    out = {_EDGE.sub("", w) for w in words if not w.isalpha()} | {w for w in words if w.isalpha()}
    if " " in low:
        out.update("".join(m.split()) for m in _SINGLES.findall(low))
    out = {w for w in out if len(w) >= 3}
    long = [w for w in out if len(w) > LONGEST]
    for w in long:
        out.discard(w)
        out.update(w[k:k + LONGEST] for k in range(0, len(w) - LONGEST // 2, LONGEST // 2))
    return out


class Kernel:
    """Subsequence features of a list of strings: (string number, feature code, value) per pattern."""

    def __init__(self, strings: list[str]):
        marked = "".join(f"\x02{s}\x03" for s in strings)
        self.codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.lengths = np.array([len(s) + 2 for s in strings], np.int64)
        self.owner = np.repeat(np.arange(len(strings)), self.lengths)
        self.left = np.repeat(np.cumsum(self.lengths), self.lengths) - np.arange(len(self.codes))
        norm = np.zeros(LONGEST + 8)
        for p in _PATTERNS:
            norm += DECAY ** (2 * (p[-1] + 1)) * np.maximum(np.arange(len(norm)) - p[-1], 0)
        # as if no subsequence occurred twice: at most the norm, and equal for most strings
        self.norm = np.sqrt(np.maximum(norm, 1e-9))[self.lengths]

    def exact(self) -> "Kernel":
        """With the norm of the feature vectors themselves."""
        parts = [(self.owner[at], code, np.full(len(at), value)) for at, code, value in self.features()]
        owner, code, value = (np.concatenate(x) for x in zip(*parts))
        key = owner.astype(np.uint64) * np.uint64(_TABLE) + code
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total = np.add.reduceat(value, first)
        self.norm = np.sqrt(np.bincount((key[first] // np.uint64(_TABLE)).astype(np.int64), total * total,
                                        len(self.lengths)))
        return self

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        n = len(self.codes)
        for p in _PATTERNS:
            at = np.flatnonzero(self.left > p[-1])
            code = np.full(len(at), len(p), np.uint64)
            for d in p:
                code = code * np.uint64(0x100000001B3) ^ self.codes[at + d]
            yield at, mix(code) & np.uint64(_TABLE - 1), DECAY ** (p[-1] + 1)
        assert n == len(self.left)

    def dot(self, table: np.ndarray) -> np.ndarray:
        """Inner product of each string's scaled features with a weight per feature code."""
        out = np.zeros(len(self.lengths))
        for at, code, value in self.features():
            out += np.bincount(self.owner[at], table[code.astype(np.int64)] * value, len(out))
        return out / self.norm

    def table(self, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of the strings' scaled feature vectors."""
        out = np.zeros(_TABLE)
        scaled = weights / self.norm
        for at, code, value in self.features():
            out += np.bincount(code.astype(np.int64), scaled[self.owner[at]] * value, _TABLE)
        return out


def kernel_matrix(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of all strings with all landmarks, over the subsequences that landmarks have."""
    base = Kernel(landmarks).exact()
    parts = [(base.owner[at], code, np.full(len(at), value)) for at, code, value in base.features()]
    owner, code, value = (np.concatenate(x) for x in zip(*parts))
    known, place = np.unique(code, return_inverse=True)
    rows = np.zeros((len(known), len(landmarks)))
    np.add.at(rows, (place, owner), value / base.norm[owner])
    out = np.zeros((len(strings), len(landmarks)))
    for start in range(0, len(strings), 2000):
        own = Kernel(strings[start:start + 2000]).exact()
        for at, code, value in own.features():
            place = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = known[place] == code
            np.add.at(out, start + own.owner[at[hit]], rows[place[hit]] * value)
        out[start:start + 2000] /= own.norm[:, None]
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 100.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, by Newton steps on the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        margin = 1 - y * (x1 @ w)
        active = margin > 0
        a, b = x1[active], weight[active] * c
        new = np.linalg.solve(ridge + (a * b[:, None]).T @ a, (a * b[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-7:
            break
        # halve the step while the objective rises
        def loss(v: np.ndarray) -> float:
            return 0.5 * v @ ridge @ v + 0.5 * c * (weight * np.maximum(0, 1 - y * (x1 @ v)) ** 2).sum()
        step, best = 1.0, loss(w)
        while step > 1e-4 and loss(w + step * (new - w)) > best:
            step /= 2
        w = w + step * (new - w)
    return w[:-1], float(w[-1])


class Model:
    """Landmarks with their weights, bias and the document-level logistic; scores lists of texts."""

    def __init__(self, landmarks: list[str], beta: np.ndarray, bias: float, logistic: np.ndarray):
        self.landmarks, self.beta, self.bias, self.logistic = landmarks, beta, bias, logistic
        self._table: np.ndarray | None = None
        self._cache: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_table": None, "_cache": {}}

    def values(self, strings: list[str]) -> np.ndarray:
        if self._table is None:
            self._table = Kernel(self.landmarks).exact().table(self.beta)
        out = np.empty(len(strings))
        for start in range(0, len(strings), 20_000):
            part = strings[start:start + 20_000]
            out[start:start + len(part)] = Kernel(part).dot(self._table) + self.bias
        # the quick norm can only overrate a string that is above the bias, so low values need no exact one
        high = np.flatnonzero(out > FLOOR)
        for start in range(0, len(high), 2000):
            at = high[start:start + 2000]
            out[at] = Kernel([strings[k] for k in at]).exact().dot(self._table) + self.bias
        return np.clip(out, FLOOR, None)

    def top_two(self, texts: list[str | None]) -> np.ndarray:
        """The two highest string values of each text, FLOOR for those that are missing."""
        sets = [strings_of(t) if t else set() for t in texts]
        cache = self._cache
        missing = sorted({s for found in sets for s in found if s not in cache})
        extra = dict(zip(missing, self.values(missing).tolist())) if missing else {}
        if len(cache) + len(extra) < CACHED:
            cache.update(extra)
        out = np.full((len(sets), 2), FLOOR)
        for k, found in enumerate(sets):
            first = second = FLOOR
            for s in found:
                v = cache[s] if s in cache else extra[s]
                if v > second:
                    if v > first:
                        first, second = v, first
                    else:
                        second = v
            out[k] = first, second
        return np.minimum(out, 1.5)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        top = self.top_two(texts)
        return 1 / (1 + np.exp(-(top @ self.logistic[:2] + self.logistic[2])))


_MODELS: dict[bytes, Model] = {}


def held_out(row_id: str = "doc_id") -> Column:
    return F.crc32(F.col(row_id).cast("string").cast("binary")) % 5 == 0


def _model_of(key: bytes) -> Model:
    import pickle
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = pickle.loads(key)
    hold("toxicity", _MODELS.clear)
    return _MODELS[key]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + 1e-3 * np.eye(x1.shape[1])
        step = np.linalg.solve(hess, x1.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _noisy(strings: list[str], rng: np.random.Generator) -> list[str]:
    """Copies with one inserted character, and with a separator between all characters."""
    marks = "-.*_ "
    out = []
    for s in strings:
        k = int(rng.integers(1, max(2, len(s))))
        out.append(s[:k] + marks[int(rng.integers(0, 4))] + s[k:])
        if len(s) < LONGEST // 2:
            out.append(marks[int(rng.integers(0, 4))].join(s))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labelled rows, or None without both classes."""
    import pickle
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y")))
    # at most SAMPLE ids, with the classes as frequent as among all labelled rows
    chosen = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(SAMPLE)
    sample = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                         .join(F.broadcast(chosen), "doc_id").select("text", "y"))
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large(batches, "text", 2 << 20, "toxicity"):
            found = [sorted(strings_of(t)) if t else [] for t in batch.column("text").to_pylist()]
            y = np.repeat(np.array(batch.column("y").to_pylist(), np.int32), [len(f) for f in found])
            yield pa.record_batch([pa.array([w for f in found for w in f], pa.string()), pa.array(y)], ["w", "y"])

    counts = cut_lineage(sample.mapInArrow(words, "w string, y int").groupBy("w").agg(
        F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")))
    rate = sizes[1] / (sizes[0] + sizes[1])
    n = F.col("t") + F.col("c")
    share = F.col("t") / n
    # how surprising the share of toxic documents is (likelihood ratio)
    lift = F.col("t") * F.log(F.greatest(share, F.lit(1e-9)) / rate) + F.col("c") * F.log(
        F.greatest(1 - share, F.lit(1e-9)) / (1 - rate))
    counts = counts.withColumn("lift", F.when(share > rate, lift).otherwise(-lift)).filter(F.length("w") >= 3)
    # so surprising that not one of all strings is expected to be by chance
    strong = counts.filter((share > 0.75) & (F.col("lift") > float(np.log(max(2, counts.count())))))
    positive = [r["w"] for r in strong.orderBy(F.desc("lift"), "w").limit(POSITIVES).select("w").collect()]
    clean = counts.filter((F.col("c") > 0) & (share <= max(0.5, rate)))
    common = [r["w"] for r in clean.orderBy(F.desc("c"), "w").limit(NEGATIVES // 2).select("w").collect()]
    mixed = [r["w"] for r in clean.orderBy(F.xxhash64("w"), "w").limit(NEGATIVES // 2).select("w").collect()]
    if not positive:
        return None
    negative = sorted(set(common) | set(mixed))
    rng = np.random.default_rng(11)

    def train(pos: list[str], neg: list[str], hard: list[str]) -> Model:
        # landmarks in order of evidence, each unlike the ones before
        def unlike(strings: list[str], most: int) -> list[str]:
            strings = strings[:most * 4]
            close, seen, out = kernel_matrix(strings, strings), np.zeros(len(strings)), []
            for k in range(len(strings)):
                if seen[k] < 0.7 and len(out) < most:
                    out.append(strings[k])
                    seen = np.maximum(seen, close[:, k])
            return out

        z = unlike(pos, LANDMARKS // 3) + (unlike(hard, LANDMARKS // 3) if hard else [])
        neg = sorted(set(neg) | set(hard))
        z += [neg[int(k)] for k in rng.permutation(len(neg))[:LANDMARKS - len(z)]]
        z = list(dict.fromkeys(z))
        inside = kernel_matrix(z, z)
        values, basis = np.linalg.eigh((inside + inside.T) / 2)
        keep = values > values.max() * 1e-6
        root = (basis[:, keep] / np.sqrt(values[keep])) @ basis[:, keep].T
        pos = pos + _noisy(pos, rng)
        x = kernel_matrix(pos + neg, z) @ root
        y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        weight = np.r_[np.full(len(pos), 0.5 / len(pos)), np.full(len(neg), 0.5 / len(neg))] * len(y)
        w, bias = fit_svm(x, y, weight)
        return Model(z, root @ w, bias, np.array([4.0, 0.0, 0.0]))

    def value_of(key: bytes) -> DataFrame:
        def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = _model_of(key).values(batch.column("w").to_pylist())
                yield pa.record_batch([*batch.columns, pa.array(got)], [*batch.schema.names, "v"])

        return clean.select("w").mapInArrow(value, "w string, v double")

    hard: list[str] = []
    model = train(positive, negative, hard)
    for _ in range(ROUNDS):
        found = value_of(pickle.dumps(model)).filter(F.col("v") > FLOOR).orderBy(F.desc("v"), "w").limit(MINED)
        hard = list(dict.fromkeys([r["w"] for r in found.collect()] + hard))
        model = train(positive, negative, hard)
    key2 = pickle.dumps(model)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large(batches, "text", 2 << 20, "toxicity"):
            top = _model_of(key2).top_two(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("y"), pa.array(top[:, 0]), pa.array(top[:, 1])], ["y", "a", "b"])

    # at most SAMPLE rows
    top = sample.mapInArrow(tops, "y int, a double, b double").toPandas()
    model.logistic = _logistic(top[["a", "b"]].to_numpy(), top["y"].to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model | None, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the double column __score."""
    if model is None:
        return docs.withColumn("__score", F.lit(0.0))
    import pickle
    key = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large(batches, text, 2 << 20, "toxicity"):
            got = _model_of(key).scores(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, "__score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__score", DoubleType())]))


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"),
                         F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
