"""H2 and H3 on stored postings: blocks of a token's postings with their greatest contributions, and skipping by bounds.

`build_text_index` writes once:

* `terms`: (token, df, slots, top_tf, top_bm25), the greatest contributions over all its texts
* `slots`: (token, slot, n, top_tf, top_bm25, ids, tfs, lengths), bucketed by (token, slot), for looking up texts. A token
  with df texts has the power of two near df / `SLOT_ROWS` as its number of slots, and a text's slot is the low bits of its
  id's hash, so a text is found in any token's postings by an equality on (token, slot).
* `impacts`: the same postings and columns by (token, level, part) instead, for walking down a token's postings. The level
  rises with the contribution, in finer steps near its limit, so a token's highest levels hold its best texts.
* `stats`: (n, mean), the number of texts and their mean length

A query starts with the impact blocks of its rarest token. The greatest score a block can reach is its own greatest
contribution plus those of the other tokens. The best blocks are read first; the k-th score of their complete matches
bounds what else has to be read, and texts are dropped before the other tokens' postings are read where the greatest
contributions of their slots cannot reach it or a token has no slot there. Results are those of the plain search.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelore.functions.chunked import top_per_key
from sitelore.operators.search_text import build_postings, query_terms
from sitelore.session import cut_lineage, ensure_checkpoint_dir, task_count

SLOT_ROWS, BLOCK_ROWS = 32, 128
#: shares of a common token's postings, and the part of the texts from which a token is common
SALTS, COMMON = 8, 64
#: tasks whose postings are packed together
PACKED_TASKS = 4
STEPS = 8  # impact levels for each halving of what a contribution lacks to its limit
K1, B = 1.2, 0.75
#: postings of the rarest token that the first wave reads, for each result wanted
FIRST_WAVE = 8


def _slot(slots: Column) -> Column:
    return F.xxhash64("id").bitwiseAND(slots - 1)


def _salt(key: str | Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(SALTS - 1)).cast("int")


class TextIndex:
    """The stored postings of one folder. The slots get a name in this session's catalog, so that joins on (token, slot)
    read their buckets as they are."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.schema("n long, mean double, analyzer string, buckets int, id string").json(f"{path}/stats").first()
        self.n, self.mean, self.analyzer, self.buckets, self.id = row
        self._table: str | None = None

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def impacts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/impacts")

    def slots(self) -> DataFrame:
        if self._table is None:
            name = f"slots_{uuid.uuid4().hex}"
            kind = f"token string, slot long, n int, top_tf long, top_bm25 double, ids array<{self.id}>, tfs array<long>, lengths array<long>"
            self.spark.sql(f"CREATE TABLE {name} ({kind}) USING parquet CLUSTERED BY (token, slot) SORTED BY (token, slot) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/slots'")
            self._table = name
        return self.spark.table(self._table)


def _bm25(tf: Column, length: Column, mean: Column) -> Column:
    """The part of a contribution that does not depend on the token's frequency."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _packs(postings: DataFrame) -> DataFrame:
    """(token, salt, ids, tfs, lengths): the postings of a token in one task, packed for the shuffle. Where they are many
    they are cut by salt, the low bits of the id's hash; else the salt is null."""
    rows = postings.select("token", _salt("id").alias("salt"), "id", F.col("tf").cast("int"), F.col("length").cast("int"))
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            token, salt = batch.column("token"), batch.column("salt").to_numpy()
            first = np.append(True, pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False))
            many = (np.diff(np.flatnonzero(first), append=len(salt)) >= 4 * SALTS)[np.cumsum(first) - 1]
            starts = np.flatnonzero(first | (many & np.append(True, salt[1:] != salt[:-1])))
            ends = pa.array(np.append(starts, len(salt)), pa.int32())
            yield pa.record_batch(
                [token.take(pa.array(starts)), pa.array(salt[starts], pa.int32(), mask=~many[starts])]
                + [pa.ListArray.from_arrays(ends, batch.column(name)) for name in ("id", "tf", "length")],
                ["token", "salt", "ids", "tfs", "lengths"])

    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, task_count(postings) // PACKED_TASKS)
    return rows.coalesce(tasks).sortWithinPartitions("token", "salt", "id").mapInArrow(
        pack, f"token string, salt int, ids array<{kind}>, tfs array<int>, lengths array<int>")


def _power(wanted: Column) -> Column:
    """The power of two from `wanted` on."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), wanted)))).cast("long")


def build_text_index(entities: DataFrame, path: str, analyzer: str = "english", id_col: str = "id",
                     text_col: str = "searchable_text", buckets: int | None = None) -> TextIndex:
    """Write the index of all texts to the folder `path`. Texts without tokens are not in it.

    Postings are shuffled in packs of one token. Tokens that many texts hold are dealt by (token, salt), the others by
    token, so the number of broadcast tokens has a limit and no task gets the whole of a common one. Slots and parts are
    finer than the salts, so both are grouped where the packs arrive. The number of tasks follows the input.
    """
    spark = entities.sparkSession
    packs = cut_lineage(_packs(build_postings(entities, id_col, text_col, analyzer)))
    lengths = packs.select(F.inline(F.arrays_zip("ids", "lengths"))).groupBy("ids").agg(F.max("lengths").alias("length"))
    n, mean = lengths.agg(F.count("*"), F.avg("length")).first()
    mean = float(mean or 1.0)
    terms = packs.groupBy("token").agg(
        F.sum(F.size("ids")).alias("df"), F.max(F.array_max("tfs")).cast("long").alias("top_tf"), F.max(_best(mean)).alias("top_bm25"))
    terms = terms.withColumn("slots", _power(F.col("df") / SLOT_ROWS))
    terms.sortWithinPartitions("token").write.option("compression", "zstd").parquet(f"{path}/terms")
    # no more than COMMON times the tokens of an average text
    common = spark.read.parquet(f"{path}/terms").filter(F.col("df") > max(n / COMMON, BLOCK_ROWS * 8 * SALTS))
    dealt = packs.join(F.broadcast(common.select("token", "df")), "token", "left")
    one = F.transform(F.arrays_zip("ids", "tfs", "lengths"), lambda p: F.struct(
        _salt(p["ids"]).alias("salt"), F.array(p["ids"]).alias("ids"), F.array(p["tfs"]).alias("tfs"), F.array(p["lengths"]).alias("lengths")))
    whole = F.array(F.struct(F.when(F.col("df").isNull(), 0).otherwise(F.col("salt")).alias("salt"), "ids", "tfs", "lengths"))
    dealt = dealt.select("token", "df", F.inline(F.when(F.col("df").isNotNull() & F.col("salt").isNull(), one).otherwise(whole)))
    tasks = task_count(packs)
    # all postings of a token that is not common come together
    held = F.sum(F.size("ids")).over(Window.partitionBy("token", "salt"))
    dealt = dealt.repartition(tasks, "token", "salt").withColumn("df", F.coalesce("df", held))
    name = f"packs_{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sitelore/{uuid.uuid4().hex}"
    _bucketed(dealt, ["token", "salt"], tasks, name, folder)  # read twice as it was dealt
    rows = spark.table(name).select("token", "salt", "df", F.inline(F.arrays_zip("ids", "tfs", "lengths"))).withColumnsRenamed(
        {"ids": "id", "tfs": "tf", "lengths": "length"})
    rows = rows.withColumn("bm25", _bm25(F.col("tf"), F.col("length"), F.lit(mean)))
    slots = _packed(rows.withColumn("slot", _slot(_power(F.col("df") / SLOT_ROWS))), ["token", "slot"])
    buckets = buckets or tasks
    slots, table = _topped(slots.repartition(buckets, "token", "slot"), mean), f"slots_{uuid.uuid4().hex}"
    _bucketed(slots, ["token", "slot"], buckets, table, f"{path}/slots")
    spark.sql(f"DROP TABLE {table}")  # the files stay; each session names them anew
    level = F.floor(-STEPS * F.log2(1 - F.col("bm25") / (K1 + 1))).cast("int")
    levelled = rows.withColumn("level", level).withColumn("part", _slot(_power(F.col("df") / (BLOCK_ROWS * 8))))
    impacts = _topped(_packed(levelled, ["token", "level", "part"]), mean)
    impacts.sortWithinPartitions("token", F.desc("level")).write.option("compression", "zstd").parquet(f"{path}/impacts")
    spark.sql(f"DROP TABLE {name}")
    spark.createDataFrame([(n, mean, analyzer, buckets, entities.schema[id_col].dataType.simpleString())],
                          "n long, mean double, analyzer string, buckets int, id string").coalesce(1).write.json(f"{path}/stats")
    return TextIndex(spark, path)


def _bucketed(rows: DataFrame, keys: list[str], buckets: int, name: str, path: str) -> None:
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(name)


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, whose postings share the salt that dealt them."""
    packed = rows.groupBy("salt", *keys).agg(F.array_sort(F.collect_list(F.struct("id", "tf", "length"))).alias("p"))
    return packed.select(*keys, F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths"))


def _best(mean: float) -> Column:
    """The greatest part of a pack's contributions."""
    return F.array_max(F.zip_with("tfs", "lengths", lambda tf, length: _bm25(tf, length, F.lit(mean))))


def _topped(packed: DataFrame, mean: float) -> DataFrame:
    keys = [name for name in packed.columns if name not in ("ids", "tfs", "lengths")]
    return packed.select(*keys, F.size("ids").alias("n"), F.array_max("tfs").cast("long").alias("top_tf"), _best(mean).alias("top_bm25"),
                         "ids", F.col("tfs").cast("array<long>").alias("tfs"), F.col("lengths").cast("array<long>").alias("lengths"))


def _asked(index: TextIndex, queries: DataFrame, score: str) -> DataFrame:
    """(query_id, token, slots, weight, most, rarest) of the queries whose terms all occur. A term contributes its weight times
    the stored part, `most` at most."""
    terms = query_terms(queries, index.analyzer)
    known = terms.join(index.terms(), "token")
    if score == "tf":
        weight, top = F.lit(1.0), F.col("top_tf").cast("double")
    else:
        weight, top = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.col("top_bm25")
    known = cut_lineage(known.withColumn("weight", weight).withColumn("most", weight * top))
    whole = known.groupBy("query_id", "n_terms").agg(
        F.count("*").alias("n_known"), F.min_by("token", F.struct("df", "token")).alias("rarest"),
        F.sum("most").alias("whole")).filter("n_known = n_terms")
    return cut_lineage(known.join(whole.select("query_id", "rarest", "whole"), "query_id").select(
        "query_id", "token", "slots", "df", "weight", "most", "rarest", "whole"))


def _part(score: str, index: TextIndex, at: Column) -> Column:
    tf = F.element_at("tfs", at)
    return tf.cast("double") if score == "tf" else _bm25(tf, F.element_at("lengths", at), F.lit(index.mean))


class _Search:
    """One batch of queries on an index."""

    def __init__(self, index: TextIndex, queries: DataFrame, score: str):
        self.index, self.score = index, score
        self.top = "top_tf" if score == "tf" else "top_bm25"
        self.asked = _asked(index, queries, score)
        heads = index.impacts().select("token", "level", "part", "n", self.top)
        own = F.col("weight") * F.col(self.top)
        self.starts = cut_lineage(self.asked.filter("token = rarest").join(heads, "token").select(
            "query_id", "token", "level", "part", "n", "weight", (F.col("whole") - F.col("most") + own).alias("bound")))
        self.read: list[DataFrame] = []

    def _count(self, slots: DataFrame) -> None:
        self.read.append(slots.select("query_id", "token", "n"))

    def matches(self, starts: DataFrame, least: DataFrame | None = None) -> DataFrame:
        """(query_id, id, tf, total) of the texts in the blocks `starts` that hold all terms; with `least` (query_id, least),
        only those that can reach it."""
        stored = self.index.slots()
        self._count(starts)
        keys = ["token", "level", "part"]
        arrays = starts.join(self.index.impacts().select(*keys, "ids", "tfs", "lengths"), keys)
        rows = arrays.select("query_id", "weight", F.inline(F.arrays_zip("ids", "tfs", "lengths"))).select(
            "query_id", F.col("ids").alias("id"), "tfs", "lengths", "weight")
        part = F.col("tfs").cast("double") if self.score == "tf" else _bm25(F.col("tfs"), F.col("lengths"), F.lit(self.index.mean))
        rows = rows.select("query_id", "id", F.col("tfs").alias("tf"), (F.col("weight") * part).alias("score"))
        others = self.asked.filter("token != rarest").select("query_id", "token", "slots", "weight")
        sizes = self.asked.groupBy("query_id").agg((F.count("*") - 1).alias("others"))
        rows = cut_lineage(rows.join(sizes, "query_id"))
        wanted = rows.filter("others > 0").select("query_id", "id", "score").join(others, "query_id").withColumn(
            "slot", _slot(F.col("slots")))
        heads = wanted.join(stored.select("token", "slot", "n", self.top), ["token", "slot"])
        heads = heads.withColumn("most", F.col("weight") * F.col(self.top))
        able = heads.groupBy("query_id", "id").agg(F.count("*").alias("c"), F.sum("most").alias("most"),
                                                   F.max("score").alias("score"))
        able = able.join(sizes, "query_id").filter("c = others")
        if least is not None:
            able = able.join(least, "query_id", "left").filter("least is null or most + score >= least - 1e-9")
        kept = cut_lineage(wanted.join(able.select("query_id", "id"), ["query_id", "id"]))
        slots = kept.select("query_id", "token", "slot").distinct().join(stored.select("token", "slot", "n"), ["token", "slot"])
        self._count(slots)
        held = kept.join(stored.select("token", "slot", "ids", "tfs", "lengths"), ["token", "slot"])
        held = held.withColumn("at", F.array_position("ids", F.col("id")).cast("int")).filter("at > 0")
        held = held.select("query_id", "id", F.element_at("tfs", F.col("at")).alias("tf"),
                           (F.col("weight") * _part(self.score, self.index, F.col("at"))).alias("score"))
        both = rows.select("query_id", "id", "tf", "score").unionByName(held)
        return (both.groupBy("query_id", "id").agg(F.count("*").alias("c"), F.sum("tf").alias("tf"), F.sum("score").alias("total"))
                .join(sizes, "query_id").filter(F.col("c") == F.col("others") + 1).select("query_id", "id", "tf", "total"))

    def best(self, k: int) -> DataFrame:
        """`matches` of all blocks that can hold one of the first k texts of a query."""
        order = [F.col("bound").desc(), F.col("level").desc(), F.col("part")]
        ahead = F.sum("n").over(_rows_before("query_id", order))
        waves = cut_lineage(self.starts.withColumn("wave", F.coalesce(ahead, F.lit(0)) >= FIRST_WAVE * k))
        found = cut_lineage(self.matches(waves.filter("not wave").drop("wave")))
        # the k-th score, rounded as ranks are; ties with it stay
        kth = top_per_key(found, ["query_id"], [F.col("total").desc(), F.col("id")], k).filter(F.col("rank") == k).select(
            "query_id", (F.round("total", 12) - 1e-9).alias("least"))
        kth = cut_lineage(kth)
        rest = waves.filter("wave").drop("wave").join(kth, "query_id", "left").filter(
            "least is null or bound >= least").drop("least")
        rest = cut_lineage(rest)
        if not rest.limit(1).count():
            return found
        return found.unionByName(self.matches(rest, kth))

    def rows_read(self) -> DataFrame:
        """(query_id, stored, read): postings of the query's terms, and how many of them were in blocks that were read."""
        read = self.read[0]
        for one in self.read[1:]:
            read = read.unionByName(one)
        read = read.groupBy("query_id").agg(F.sum("n").alias("read"))
        return self.asked.groupBy("query_id").agg(F.sum("df").alias("stored")).join(read, "query_id", "left").select(
            "query_id", "stored", F.coalesce("read", F.lit(0).cast("long")).alias("read"))


def _rows_before(key: str, order: list[Column]):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def indexed_match(index: TextIndex, queries: DataFrame) -> DataFrame:
    """H2: (query_id, id, tf) for the texts that hold every term of the query."""
    search = _Search(index, queries, "tf")
    return search.matches(search.starts).select("query_id", "id", "tf")


def indexed_scores(index: TextIndex, queries: DataFrame, k: int | None, score: str = "bm25") -> tuple[DataFrame, DataFrame]:
    """((query_id, id, text_rank), rows read). With k, at least the texts of the k greatest scores and those tied with
    them; without, all matches."""
    search = _Search(index, queries, score)
    found = search.best(k) if k else search.matches(search.starts)
    return found.select("query_id", "id", F.col("total").alias("text_rank")), search.rows_read()


def indexed_text_search(entities: DataFrame, index: TextIndex, queries: DataFrame, k: int = 20,
                        score: str = "bm25", filtered: bool = True) -> DataFrame:
    """H3 on stored postings: the k best of `entities` per query, by lexical rank and then entity score.

    `filtered` says that `entities` may lack indexed texts (H8). Then the k best texts of the index need not be among
    them, and all matches are scored.
    """
    found, _ = indexed_scores(index, queries, None if filtered else k, score)
    found = found.withColumn("text_rank", F.round("text_rank", 12))
    joined = found.join(entities.select("id", "aieo_score"), "id")
    order = [F.col("text_rank").desc(), F.col("aieo_score").desc_nulls_last(), F.col("id")]
    return top_per_key(joined, ["query_id"], order, k).select("query_id", "rank", "id", "text_rank", "aieo_score")
