"""Evaluation reports and training pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelore.operators import evaluate, training
from sitelore.plans.registry import Data, query

_TRUTH = "SELECT 'u' || CAST(p_partkey % 97 AS STRING) AS url, p_name AS name FROM {t}part"
_CANDIDATES = """SELECT 'u' || CAST(l_partkey % 97 AS STRING) AS url, upper(p_name) AS name FROM {t}lineitem JOIN {t}part
  ON p_partkey = l_suppkey"""


@query("n1_accuracy", oracle=f"""
WITH t AS ({_TRUTH.format(t='')}), c AS ({_CANDIDATES.format(t='')}),
u AS (SELECT url FROM t UNION SELECT url FROM c),
tn AS (SELECT url, count(*) AS n FROM t GROUP BY url), cn AS (SELECT url, count(*) AS n FROM c GROUP BY url),
m AS (SELECT url, count(*) AS n FROM (SELECT url, lower(name) FROM t INTERSECT SELECT url, lower(name) FROM c) GROUP BY url),
p AS (SELECT u.url, coalesce(cn.n, 0) AS n_candidate, coalesce(tn.n, 0) AS n_truth, coalesce(m.n, 0) AS matches
  FROM u LEFT JOIN tn ON tn.url = u.url LEFT JOIN cn ON cn.url = u.url LEFT JOIN m ON m.url = u.url),
a AS (SELECT * FROM p UNION ALL SELECT NULL, sum(n_candidate), sum(n_truth), sum(matches) FROM p)
SELECT url, CAST(n_candidate AS BIGINT) AS n_candidate, CAST(n_truth AS BIGINT) AS n_truth, CAST(matches AS BIGINT) AS matches,
  CASE WHEN n_candidate > 0 THEN matches::DOUBLE / n_candidate ELSE 0 END AS precision,
  CASE WHEN n_truth > 0 THEN matches::DOUBLE / n_truth ELSE 0 END AS recall FROM a""")
def n1(d: Data):
    return evaluate.accuracy(d.sql(_CANDIDATES.format(t="@")), d.sql(_TRUTH.format(t="@")))


_PREDICTED = """SELECT l.doc_id, CAST(quality AS STRING) AS actual, CASE WHEN n_chars > 500 THEN '1' ELSE '0' END AS predicted
  FROM {t}labels l JOIN {t}documents d ON d.doc_id = l.doc_id"""


@query("n2_confusion", oracle=f"SELECT actual, predicted, count(*) AS n FROM ({_PREDICTED.format(t='')}) GROUP BY 1, 2")
def n2(d: Data):
    return evaluate.confusion(d.sql(_PREDICTED.format(t="@")))


@query("n2_accuracy", oracle=f"""
SELECT count(*) AS tested, count(*) FILTER (WHERE actual = predicted) AS correct,
       round(100.0 * count(*) FILTER (WHERE actual = predicted) / count(*), 1) AS accuracy FROM ({_PREDICTED.format(t='')})""")
def n2_accuracy(d: Data):
    return evaluate.classification_accuracy(d.sql(_PREDICTED.format(t="@")))


@query("n2_top_confusions", oracle=f"""
SELECT actual, predicted, count(*) AS n FROM ({_PREDICTED.format(t='')}) WHERE actual <> predicted GROUP BY 1, 2
ORDER BY 3 DESC, 1, 2 LIMIT 5""")
def n2_top(d: Data):
    return evaluate.top_confusions(d.sql(_PREDICTED.format(t="@")))


@query("n3_prf", oracle=f"""
WITH r AS ({_PREDICTED.format(t='')}),
c AS (SELECT actual AS category FROM r UNION SELECT predicted FROM r),
n AS (SELECT category, (SELECT count(*) FROM r WHERE predicted = category) AS n_predicted,
      (SELECT count(*) FROM r WHERE actual = category) AS n_truth,
      (SELECT count(*) FROM r WHERE actual = category AND predicted = category) AS hits FROM c)
SELECT category, n_predicted, n_truth, hits, CASE WHEN n_predicted > 0 THEN hits::DOUBLE / n_predicted ELSE 0 END AS precision,
  CASE WHEN n_truth > 0 THEN hits::DOUBLE / n_truth ELSE 0 END AS recall,
  CASE WHEN n_predicted + n_truth > 0 THEN 2.0::DOUBLE * hits / (n_predicted + n_truth) ELSE 0 END AS f1 FROM n""")
def n3(d: Data):
    rows = d.sql(_PREDICTED.format(t="@"))
    return evaluate.prf_by_category(rows.select(F.col("doc_id").alias("key"), F.col("predicted").alias("category")),
                                    rows.select(F.col("doc_id").alias("key"), F.col("actual").alias("category")))


_DOCS = "SELECT doc_id AS page_id, 'https://' || source || '.example.com' AS url, text AS cleaned_dom FROM {t}documents"
_ANSWERS = """SELECT doc_id AS page_id, CASE doc_id % 4 WHEN 0 THEN 'classify' WHEN 1 THEN 'contacts' WHEN 2 THEN 'products'
  ELSE 'other' END AS prompt_type, '{"quality":' || CAST(quality AS STRING) || '}' AS response FROM @labels"""
_PAIRS = f"""WITH p AS (SELECT p.page_id, 'URL: ' || url || chr(10) || chr(10) || 'Page content:' || chr(10) || cleaned_dom AS input,
  prompt_type, response AS output FROM ({_DOCS.format(t='')}) p JOIN ({_ANSWERS.replace('@', '')}) a ON a.page_id = p.page_id
  WHERE prompt_type <> 'other')"""


def _pairs(d: Data):
    return training.training_pairs(d.sql(_DOCS.format(t="@")), d.sql(_ANSWERS), max_chars=None)


@query("n4_training_pairs", oracle=_PAIRS + " SELECT page_id, input, output, prompt_type FROM p")
def n4(d: Data):
    return _pairs(d)


@query("n5_instructions", oracle=_PAIRS + """ SELECT 'Extract structured entities from the web page content. Extractor: '
  || prompt_type || '.' AS instruction, input, output FROM p""")
def n5(d: Data):
    return training.to_instructions(_pairs(d))


@query("n6_chat_pairs", oracle=_PAIRS + """ SELECT page_id,
  'system:You extract entities from web pages. Task: ' || prompt_type AS first_message, input AS user_message, output AS assistant_message FROM p""")
def n6(d: Data):
    chat = training.to_chat(_pairs(d))

    def part(path: str):
        return F.get_json_object("value", f"$.messages{path}")

    return chat.select("page_id", F.concat(part("[0].role"), F.lit(":"), part("[0].content")).alias("first_message"),
                       part("[1].content").alias("user_message"), part("[2].content").alias("assistant_message"))


@query("n6_conversations", oracle="""
SELECT conv_id, CAST(0 AS BIGINT) AS part, CAST(json_object('messages',
  list(json_object('role', role, 'content', text) ORDER BY turn, role, text)) AS VARCHAR) AS value FROM conversations GROUP BY 1, 2""")
def n6_conversations(d: Data):
    return training.turns_to_chat(d.table("conversations"))


@query("n7_escalations", "pg", """
, l AS (SELECT CASE WHEN page_type_confidence < 0.7 THEN 'low confidence' WHEN cms_detected IS NULL THEN 'unusual structure'
  ELSE 'parse failure' END AS reason FROM pg)
SELECT reason, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM l GROUP BY reason""")
def n7(d: Data):
    reason = (F.when(F.col("page_type_confidence") < 0.7, "low confidence")
              .when(F.col("cms_detected").isNull(), "unusual structure").otherwise("parse failure"))
    return evaluate.escalation_share(d.view("pg").select(reason.alias("reason")))
