"""Postings, term matching, lexical ranks and trigram similarity."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelore.functions.chunked import top_per_key
from sitelore.functions.text import STOP_WORDS, stem_column, tokens, trigrams, words
from sitelore.session import cut_lineage, spread, task_count

SIZE_STEP = 1.02  # sizes of one class differ by less
MARKS = 4  # words of 64 bits that sum up a text's grams


def _analysed(text: Column, analyzer: str, positions: bool = False) -> Column:
    """Tokens of a text, as (pos, token) when positions are wanted. `english` drops stop words, which still count as
    positions; `plain` keeps every ASCII run."""
    runs = words(text) if analyzer == "english" else tokens(text)
    if positions:
        runs = F.transform(runs, lambda w, i: F.struct(i.alias("pos"), w.alias("token")))
    if analyzer != "english":
        return runs
    stop = sorted(STOP_WORDS)
    return F.filter(runs, lambda x: ~(x["token"] if positions else x).isin(*stop))


def build_postings(entities: DataFrame, id_col: str = "id", text_col: str = "searchable_text",
                   analyzer: str = "english", positions: bool = False) -> DataFrame:
    """H1: (token, id, tf, length[, positions]); `length` is the text's number of tokens.

    Texts are hashed by their id, which is less to move than their postings would be; counting (id, token) then needs
    no further shuffle. The number of tasks follows the input, so that a task's counts do not grow with it. Stems are taken after counting, once per distinct token of a batch, by one Arrow function.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = entities.select(F.col(id_col).alias("id"), text.alias("text"))
    docs = docs.repartition(task_count(docs), "id")
    docs = docs.select("id", _analysed(F.col("text"), analyzer, positions).alias("tokens"))
    flat = F.inline("tokens") if positions else F.explode("tokens").alias("token")
    terms = docs.select("id", F.size("tokens").cast("bigint").alias("length"), flat)
    aggregates = [F.count("*").alias("tf")]
    if positions:
        aggregates.append(F.array_sort(F.collect_list("pos")).alias("positions"))
    out = terms.groupBy("id", "length", "token").agg(*aggregates)
    columns = ["token", "id", "tf", "length", *(["positions"] if positions else [])]
    if analyzer != "english":
        return out.select(*columns)
    merged = [F.sum("tf").alias("tf")]
    if positions:
        merged.append(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return (out.withColumn("token", stem_column("token")).groupBy("id", "length", "token").agg(*merged)
            .select(*columns))


def doc_stats(postings: DataFrame) -> DataFrame:
    """H1: length of every indexed text in tokens."""
    return postings.groupBy("id").agg(F.max("length").alias("length"))


def query_terms(queries: DataFrame, analyzer: str = "english") -> DataFrame:
    """Distinct (query_id, token) with the query's number of distinct terms."""
    found = _analysed(F.coalesce("query", F.lit("")), analyzer)
    terms = queries.select("query_id", F.explode(found).alias("token")).distinct()
    if analyzer == "english":
        terms = terms.withColumn("token", stem_column("token")).distinct()
    sizes = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    return terms.join(sizes, "query_id")


def _matches(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, token, tf, length, df) of the texts that hold every term of a query.

    Candidates are the texts of each query's rarest term, and only they are checked for the other terms, so common
    terms never multiply texts by queries. The postings of the asked tokens are written once and read for the three
    steps; on postings built on the fly Spark moves that semi-join below the counting.
    """
    needed = cut_lineage(postings.select("token", "id", "tf", "length")
                         .join(terms.select("token").distinct(), "token", "left_semi"))
    frequency = needed.groupBy("token").agg(F.count("*").alias("df"))
    known = terms.join(frequency, "token")
    rarest = known.groupBy("query_id", "n_terms").agg(
        F.count("*").alias("n_known"), F.min_by("token", F.struct("df", "token")).alias("token"))
    rarest = rarest.filter(F.col("n_known") == F.col("n_terms")).select("query_id", "token")
    candidates = needed.select("token", "id").join(rarest, "token").select("query_id", "id")
    wanted = candidates.join(known, "query_id").select("query_id", "n_terms", "id", "token", "df")
    return wanted.join(needed, ["id", "token"])


def _complete(matches: DataFrame, *aggregates: Column) -> DataFrame:
    return (matches.groupBy("query_id", "n_terms", "id").agg(F.count("*").alias("hit"), *aggregates)
            .filter(F.col("hit") == F.col("n_terms")).drop("n_terms", "hit"))


def text_match(postings: DataFrame, queries: DataFrame, analyzer: str = "english") -> DataFrame:
    """H2: (query_id, id, tf) for the texts that hold every term of the query. A query without terms matches nothing."""
    return _complete(_matches(postings, query_terms(queries, analyzer)), F.sum("tf").alias("tf"))


def score_matches(postings: DataFrame, queries: DataFrame, analyzer: str = "english", score: str = "bm25",
                  k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, text_rank) of the matching texts.

    `bm25` (Robertson and Zaragoza 2009) stands in for the database's own rank: the matched set is the same, the order
    follows the published formula. `tf` sums term frequencies.
    """
    if score == "tf":
        return text_match(postings, queries, analyzer).select("query_id", "id", F.col("tf").cast("double").alias("text_rank"))
    matches = _matches(postings, query_terms(queries, analyzer))
    stats = doc_stats(postings).agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("mean"))).scalar()
    idf = F.log(1 + (stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / stats["mean"]))
    return _complete(matches, F.sum(weight).alias("text_rank"))


def text_search(entities: DataFrame, postings: DataFrame, queries: DataFrame, k: int = 20, analyzer: str = "english",
                score: str = "bm25") -> DataFrame:
    """H3: the k best matching entities per query, by lexical rank and then entity score.

    `entities` is already filtered (H8); only its id and score are shuffled.
    """
    matches = score_matches(postings, queries, analyzer, score)
    matches = matches.withColumn("text_rank", F.round("text_rank", 12))
    joined = matches.join(entities.select("id", "aieo_score"), "id")
    order = [F.col("text_rank").desc(), F.col("aieo_score").desc_nulls_last(), F.col("id")]
    return top_per_key(joined, ["query_id"], order, k).select("query_id", "rank", "id", "text_rank", "aieo_score")


def _grams(df: DataFrame, key: str, text: Column, size: str) -> DataFrame:
    found = df.select(key, trigrams(F.coalesce(text, F.lit(""))).alias("g"))
    return found.select(key, F.size("g").alias(size), F.explode("g").alias("gram"))


def _prefixes(grams: DataFrame, keys: DataFrame, key: str, size: str, threshold: float) -> DataFrame:
    """(key, size, pos, gram, known, marks): the n - ceil(t n) + 1 first grams of each text by (rarity, gram). Grams that only one side
    has come first; they take places and need not be looked up."""
    order = Window.partitionBy(key).orderBy("rarity", "gram")
    # many rows in few bytes: the planner would put them into one task
    known = grams.join(keys, "gram").repartition(task_count(grams), key)
    whole = Window.partitionBy(key)
    marks = [F.coalesce(F.bit_or(F.expr(f"CASE WHEN pmod(xxhash64(gram), {MARKS}) = {i} THEN shiftleft(1L, CAST(pmod(hash(gram), 64) AS INT)) END"))
                        .over(whole), F.lit(0)) for i in range(MARKS)]
    placed = known.withColumn("k", F.row_number().over(order)).withColumn(
        "known", F.count("*").over(whole)).withColumn("marks", F.array(*marks))
    at = F.col(size) - F.col("known") + F.col("k")
    last = F.col(size) - F.ceil(F.col(size) * threshold - 1e-9) + 1
    return placed.withColumn("pos", at).filter(F.col("pos") <= last).select(key, size, "pos", "gram", "known", "marks")


def trigram_candidates(docs: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """(query_id, id) of the pairs that prefix, size and position leave of rows (id, n_doc, gram), (query_id, n_query, gram).

    Texts of similarity t share one of their n - ceil(t n) + 1 rarest grams, their sizes differ by no more than t, and
    from the first shared gram on enough grams are left on both sides. Texts meet by (gram, class of n_doc): a query's gram
    goes only to the classes it can reach from its place, which are a bounded number.
    """
    frequency = docs.groupBy("gram").agg(F.count("*").alias("df"))
    keys = cut_lineage(asked.groupBy("gram").agg(F.count("*").alias("qf")).join(frequency, "gram").select(
        "gram", (F.col("qf") * F.col("df")).alias("rarity")))
    a, b = F.col("n_doc"), F.col("n_query")
    left = cut_lineage(_prefixes(docs, keys, "id", "n_doc", threshold).withColumn(
        "class", F.floor(F.log(a) / log(SIZE_STEP))))
    right = _prefixes(asked, keys, "query_id", "n_query", threshold).withColumnsRenamed({"pos": "at", "known": "sought", "marks": "others"})
    # a text may be as long as this, times the threshold, and have enough grams from here on
    reach = F.col("n_doc") - (F.col("pos") - 1) * (1 + threshold)
    sizes = left.groupBy("gram", "class").agg(F.min("n_doc").alias("shortest"), F.max(reach).alias("reach"))
    right = right.join(sizes, "gram").filter(
        (F.col("shortest") * threshold <= b - (F.col("at") - 1) * (1 + threshold) + 1e-6)
        & (b * threshold <= F.col("reach") + 1e-6)).drop("shortest", "reach")
    size = (F.least(a, b) >= F.greatest(a, b) * threshold - 1e-9)
    need = F.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9)
    place = 1 + F.least(a - F.col("pos"), b - F.col("at")) >= need
    # a bit that only one side has is a gram that only one side has
    apart = sum((F.bit_count(F.element_at("marks", i + 1).bitwiseXOR(F.element_at("others", i + 1))) for i in range(MARKS)), F.lit(0))
    near = apart <= F.col("known") + F.col("sought") - 2 * need
    return left.join(right, ["gram", "class"]).filter(size & place & near).select("query_id", "id", "n_query", "n_doc").distinct()


def trigram_search(df: DataFrame, queries: DataFrame, threshold: float = 0.3, k: int | None = None,
                   id_col: str = "id", text_col: str = "data") -> DataFrame:
    """(query_id, id, similarity) of texts whose trigram Jaccard similarity reaches `threshold`.

    Candidates come from the rarest grams only (see `trigram_candidates`); the shared grams of a candidate are counted
    by joining both texts' grams that occur on the other side at all.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    docs = _grams(spread(texts, "id"), "id", F.col("__text"), "n_doc")
    asked = cut_lineage(_grams(spread(queries, "query_id"), "query_id", F.col("query"), "n_query"))
    docs = cut_lineage(docs.join(asked.select("gram").distinct(), "gram", "left_semi"))
    pairs = cut_lineage(trigram_candidates(docs, asked, threshold))
    texts = docs.join(pairs.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.collect_list("gram").alias("g"))
    sought = asked.groupBy("query_id").agg(F.collect_list("gram").alias("h"))
    n = F.size(F.array_intersect("g", "h"))
    shared = pairs.join(texts, "id").join(sought, "query_id").withColumn("n", n)
    similarity: Column = F.col("n") / (F.col("n_doc") + F.col("n_query") - F.col("n"))
    out = shared.select("query_id", "id", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
    if k is None:
        return out
    return top_per_key(out, ["query_id"], [F.col("similarity").desc(), F.col("id")], k)
