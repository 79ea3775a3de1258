"""Text, vector and hybrid search over the document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelore.operators import search, search_text, search_vector, text_index, vector_index
from sitelore.operators.entities import mean_pool
from sitelore.operators.search import Filters
from sitelore.plans.page_jobs import CENTROIDS
from sitelore.plans.registry import Data, query

# --- oracle parts -----------------------------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_POSTINGS = f"""
post AS (SELECT id, token, count(*) AS tf FROM (
  SELECT id, unnest({_TOKENS.format('searchable_text')}) AS token FROM etext) GROUP BY id, token),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format('text')}) AS token FROM benchmark),
qn AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY query_id),
hits AS (SELECT query_id, id, count(*) AS hit, sum(tf) AS tf FROM post JOIN qt USING (token) GROUP BY query_id, id),
matched AS (SELECT query_id, id, CAST(tf AS BIGINT) AS tf FROM hits JOIN qn USING (query_id) WHERE hit = n_terms)"""

_VECTORS = f"""
{CENTROIDS},
unit AS (SELECT m.label, dim, x / norm AS x FROM means m JOIN norms n ON n.label = m.label),
evec AS (SELECT id, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM {{source}}
         WHERE embedding IS NOT NULL),
enorm AS (SELECT id, sqrt(sum(x * x)) AS norm FROM evec GROUP BY id),
dots AS (SELECT u.label, e.id, sum(u.x * e.x) AS dot FROM evec e JOIN unit u USING (dim) GROUP BY u.label, e.id),
sims AS (SELECT label, d.id, round(dot / norm, 12) + 0.0 AS similarity FROM dots d JOIN enorm n ON n.id = d.id)"""


def _centroids(d: Data):
    """One query vector per label: the mean of its vectors."""
    pooled = mean_pool(d.table("embeddings"), "label", "embedding")
    return pooled.select(F.col("label").alias("query_id"), "embedding")


def _texts(d: Data):
    return d.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _queries(d: Data):
    """Benchmark passages as texts, each with the centroid of label item_id % 10 as its vector."""
    label = (F.col("query_id") % 10).cast("int")
    vectors = _centroids(d).withColumnRenamed("query_id", "label")
    return _texts(d).withColumn("label", label).join(vectors, "label", "left").drop("label")


def stored_postings(d: Data, analyzer: str = "plain"):
    """The stored postings of the corpus."""
    path = d.stored(f"text_{analyzer}", lambda folder: text_index.build_text_index(d.view("etext"), folder, analyzer))
    return text_index.TextIndex(d.spark, path)


# --- text -------------------------------------------------------------------------------------------------

@query("h1_postings", "etext", f", {_POSTINGS} SELECT token, id, tf, CAST(sum(tf) OVER (PARTITION BY id) AS BIGINT) AS length FROM post")
def h1(d: Data):
    return search_text.build_postings(d.view("etext"), analyzer="plain")


@query("h1_doc_stats", "etext", f", {_POSTINGS} SELECT id, CAST(sum(tf) AS BIGINT) AS length FROM post GROUP BY id")
def h1_stats(d: Data):
    return search_text.doc_stats(search_text.build_postings(d.view("etext"), analyzer="plain"))


@query("h1_postings_english")
def h1_english(d: Data):
    return search_text.build_postings(d.view("etext"), analyzer="english")


@query("h2_text_match", "etext", f", {_POSTINGS} SELECT query_id, id, tf FROM matched")
def h2(d: Data):
    return text_index.indexed_match(stored_postings(d), _texts(d))


@query("h3_text_search_tf", "etext", f""", {_POSTINGS}
SELECT query_id, CAST(rank AS INT) AS rank, id, text_rank, aieo_score FROM (
  SELECT query_id, m.id, m.tf::DOUBLE AS text_rank, e.aieo_score, row_number() OVER (
    PARTITION BY query_id ORDER BY m.tf DESC, e.aieo_score DESC, m.id) AS rank FROM matched m JOIN etext e ON e.id = m.id)
WHERE rank <= 20""")
def h3_tf(d: Data):
    return text_index.indexed_text_search(d.view("etext"), stored_postings(d), _texts(d), 20, "tf", filtered=False)


@query("h3_text_search_bm25", "etext", f""", {_POSTINGS},
len AS (SELECT id, sum(tf) AS length FROM post GROUP BY id),
tot AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
scored AS (SELECT query_id, id, count(*) AS hit,
    sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
        / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS s
  FROM post JOIN qt USING (token) JOIN df USING (token) JOIN len USING (id), tot GROUP BY query_id, id),
r AS (SELECT query_id, s.id, round(s, 12) AS text_rank, e.aieo_score FROM scored s JOIN qn USING (query_id)
      JOIN etext e ON e.id = s.id WHERE hit = n_terms)
SELECT query_id, CAST(rank AS INT) AS rank, id, round(text_rank, 6) AS text_rank, aieo_score FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY text_rank DESC, aieo_score DESC, id) AS rank FROM r) WHERE rank <= 20""")
def h3(d: Data):
    out = text_index.indexed_text_search(d.view("etext"), stored_postings(d), _texts(d), 20, filtered=False)
    return out.withColumn("text_rank", F.round("text_rank", 6))


_COMMON = "SELECT item_id AS query_id, regexp_extract(lower(text), '[a-z0-9]+', 0) AS query FROM {t}benchmark"


@query("h3_rows_read", "etext", f""", {_POSTINGS}, one AS ({_COMMON.format(t='')}),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token)
SELECT query_id, df AS stored, false AS read_too_much FROM one JOIN df ON token = query""")
def h3_rows_read(d: Data):
    """Postings stored for one-word queries, and whether the 20 best of a common word took a tenth of them or more."""
    words = d.sql(_COMMON.format(t="@"))
    _, read = text_index.indexed_scores(stored_postings(d), words, 20)
    return read.select("query_id", "stored", ((F.col("stored") > 1000) & (F.col("read") * 10 > F.col("stored"))).alias(
        "read_too_much"))


@query("h3_text_search_english")
def h3_english(d: Data):
    return text_index.indexed_text_search(d.view("etext"), stored_postings(d, "english"), _texts(d), 20, filtered=False)


# --- vectors ----------------------------------------------------------------------------------------------

def _ranked(k: int) -> str:
    return f"""SELECT query_id, CAST(rank AS INT) AS rank, id, round(similarity, 6) + 0.0 AS similarity FROM (SELECT label AS query_id, id, similarity,
  row_number() OVER (PARTITION BY label ORDER BY similarity DESC, id) AS rank FROM sims) WHERE rank <= {k}"""


@query("h4_vector_search", "etext", f", {_VECTORS.format(source='etext')} {_ranked(20)}")
def h4(d: Data):
    return search_vector.vector_search(d.view("etext"), _centroids(d), 20)


@query("h4_vector_search_filtered", "etext", f""",
kept AS (SELECT * FROM etext WHERE category = 'product' AND confidence >= 0.3), {_VECTORS.format(source='kept')} {_ranked(10)}""")
def h4_filtered(d: Data):
    kept = Filters(category="product", min_confidence=0.3).apply(d.view("etext"))
    return search_vector.vector_search(kept, _centroids(d), 10)


@query("h5_lsh_search")
def h5(d: Data):
    return search_vector.lsh_search(d.view("etext"), _centroids(d), 20)


def stored_vectors(d: Data):
    path = d.stored("vectors", lambda folder: vector_index.build_vector_index(d.view("etext"), folder))
    return vector_index.VectorIndex(d.spark, path)


def _near(d: Data):
    """20 hits per centroid: three quarters of the cells are looked up, as the vectors hardly cluster, and a twentieth of
    the rows is compared; of small tables 40 rows, as long as that is at most a tenth, but never fewer than the hits."""
    index = stored_vectors(d)
    return index, vector_index.indexed_search(index, _centroids(d), 20, 48, max(20, min(40, index.rows // 10), index.rows // 20))


@query("h5_ivf_search")
def h5_ivf(d: Data):
    return _near(d)[1]


@query("h5_ivf_recall", oracle="SELECT count(DISTINCT label) AS queries, true AS recall_reached, true AS compared_kept FROM embeddings")
def h5_recall(d: Data):
    """Recall at 20 of 0.9 against the exact search, with at most a tenth of the rows compared in full."""
    index, near = _near(d)
    report = vector_index.recall_report(search_vector.vector_search(d.view("etext"), _centroids(d), 20), near, index.rows)
    return report.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("recall_reached"),
                      (F.max("compared_share") <= 0.1).alias("compared_kept"))


# --- fusion and entry point -------------------------------------------------------------------------------

_FUSED = f""", {_POSTINGS}, {_VECTORS.format(source='etext')},
vr AS (SELECT item_id AS query_id, id, similarity, rank AS vector_rank FROM benchmark JOIN (
  SELECT label, id, similarity, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, id) AS rank FROM sims) v
  ON v.label = item_id % 10 WHERE rank <= 60),
tr AS (SELECT query_id, id, rank AS lexical_rank FROM (SELECT query_id, m.id, row_number() OVER (
  PARTITION BY query_id ORDER BY m.tf DESC, e.aieo_score DESC, m.id) AS rank FROM matched m JOIN etext e ON e.id = m.id) WHERE rank <= 60),
fused AS (SELECT coalesce(vr.query_id, tr.query_id) AS query_id, coalesce(vr.id, tr.id) AS id, vector_rank, lexical_rank, similarity,
  coalesce(1::DOUBLE / (60 + vector_rank), 0) + coalesce(1::DOUBLE / (60 + lexical_rank), 0) AS rrf
  FROM vr FULL JOIN tr ON vr.query_id = tr.query_id AND vr.id = tr.id)"""


@query("h6_hybrid_search", "etext", f"""{_FUSED}
SELECT query_id, CAST(rank AS INT) AS rank, f.id, round(rrf, 9) AS rrf_score, CAST(vector_rank AS INT) AS vector_rank,
       CAST(lexical_rank AS INT) AS lexical_rank, round(sims.similarity, 6) + 0.0 AS vector_similarity
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM fused) f
LEFT JOIN sims ON sims.label = f.query_id % 10 AND sims.id = f.id WHERE rank <= 20""")
def h6(d: Data):
    out = search.hybrid_search(d.view("etext"), _queries(d), stored_postings(d), k=20, analyzer="plain", score="tf")
    return out.withColumn("rrf_score", F.round("rrf_score", 9))


@query("h7_browse", "ent", """
SELECT * FROM ent WHERE category = 'product' AND confidence >= 0.5 ORDER BY aieo_score DESC, confidence DESC, id LIMIT 20""")
def h7(d: Data):
    return search.browse(d.view("ent"), Filters(category="product", min_confidence=0.5), 0)


@query("h9_search_text", "etext", f""", {_POSTINGS},
r AS (SELECT query_id, m.id, row_number() OVER (PARTITION BY query_id ORDER BY m.tf DESC, e.aieo_score DESC, m.id) AS rank
      FROM matched m JOIN etext e ON e.id = m.id WHERE e.confidence >= 0.2)
SELECT query_id, CAST(rank AS INT) AS rank, e.id, e.category, e.domain, e.confidence, e.aieo_score,
       CAST(NULL AS DOUBLE) AS vector_similarity FROM r JOIN etext e ON e.id = r.id WHERE rank <= 10""")
def h9(d: Data):
    return search.search(d.view("etext"), _texts(d), "text", Filters(min_confidence=0.2), 10, stored_postings(d), analyzer="plain", score="tf")


@query("h9_search_vector", "etext", f", {_VECTORS.format(source='etext')}, " + f"""
r AS ({_ranked(5)}) SELECT query_id, rank, e.id, category, domain, confidence, aieo_score, similarity AS vector_similarity
FROM r JOIN etext e ON e.id = r.id""")
def h9_vector(d: Data):
    return search.search(d.view("etext"), _centroids(d), "vector", k=5)


@query("h9_search_hybrid", "etext", f"""{_FUSED}, best AS (SELECT f.query_id, CAST(rank AS INT) AS rank, f.id, round(sims.similarity, 6) + 0.0 AS vector_similarity
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM fused) f
  LEFT JOIN sims ON sims.label = f.query_id % 10 AND sims.id = f.id WHERE rank <= 20)
SELECT query_id, rank, e.id, category, domain, confidence, aieo_score, vector_similarity FROM best JOIN etext e ON e.id = best.id""")
def h9_hybrid(d: Data):
    return search.search(d.view("etext"), _queries(d), "hybrid", k=20, postings=stored_postings(d), analyzer="plain", score="tf")


@query("h9_search_browse", "ent", """
SELECT id, category, data, domain, confidence, aieo_score, CAST(NULL AS DOUBLE) AS vector_similarity FROM ent
WHERE category = 'action' ORDER BY aieo_score DESC, confidence DESC, id LIMIT 20""")
def h9_browse(d: Data):
    return search.search(d.view("ent"), mode="browse", filters=Filters(category="action"))


_GRAMS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def _grams(table: str, key: str, text: str) -> str:
    return f"""SELECT DISTINCT {key}, substr('  ' || w || ' ', i, 3) AS gram FROM (
  SELECT {key}, w, unnest(generate_series(1, length(w) + 1)) AS i FROM (
    SELECT {key}, unnest({_GRAMS.format(text)}) AS w FROM {table}))"""


# what a user types who looks for a payload: the beginning of a product's
_PAYLOADS = """SELECT DISTINCT '{"name":"' || p_name || '","provider":"' || p_brand || '","productType":"' || p_type || '"' AS query"""


def _payload_queries(d: Data):
    return d.sql(f"{_PAYLOADS} FROM @part").withColumn("query_id", F.col("query"))


@query("h10_trigram_search", "ent", f"""
, q AS ({_PAYLOADS} FROM part), dg AS ({_grams('ent', 'id', 'data')}), qg AS ({_grams('q', 'query', 'query')}),
dn AS (SELECT id, count(*) AS n FROM dg GROUP BY id), qn AS (SELECT query, count(*) AS n FROM qg GROUP BY query),
s AS (SELECT query AS query_id, id, count(*) AS c FROM dg JOIN qg USING (gram) GROUP BY query, id)
SELECT query_id, s.id, round(c / (dn.n + qn.n - c), 9) AS similarity FROM s JOIN dn ON dn.id = s.id JOIN qn ON qn.query = query_id
WHERE c / (dn.n + qn.n - c) >= 0.45""")
def h10(d: Data):
    out = search_text.trigram_search(d.view("ent"), _payload_queries(d), 0.45)
    return out.withColumn("similarity", F.round("similarity", 9))


@query("h11_query_gaps", oracle="""
WITH s AS (SELECT 'find  K' || user_id % 50 AS query, CAST(floor(value) AS BIGINT) AS results FROM events)
SELECT trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) AS query, count(*) AS searches,
       count(*) FILTER (WHERE results < 5) AS low_result_searches, count(*) FILTER (WHERE results = 0) AS zero_result_searches,
       round(avg(results), 6) AS avg_results FROM s GROUP BY 1 HAVING count(*) FILTER (WHERE results < 5) > 0""")
def h11(d: Data):
    log = d.sql("""SELECT 'find  K' || CAST(user_id % 50 AS STRING) AS query, CAST(floor(value) AS BIGINT) AS results FROM @events""")
    return search.query_gaps(log).withColumn("avg_results", F.round("avg_results", 6))
