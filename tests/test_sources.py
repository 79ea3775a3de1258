"""Sources, sinks and response lists."""

from pyspark.sql import functions as F

from sitelore.operators import evaluate, extract
from sitelore.sources import pages


def test_seed_file(spark, tmp_path):
    path = tmp_path / "seeds.txt"
    path.write_text("# list\n\n  https://www.a.com/x \nftp://b\nhttp://c.com\n#http://d.com\n")
    got = {tuple(r) for r in pages.read_seeds(spark, str(path), "discovered").collect()}
    assert got == {("https://www.a.com/x", "a.com", 6, "discovered"), ("http://c.com", "c.com", 6, "discovered")}


def test_bulk_submit_rejects_requests_that_are_too_large(spark):
    url = F.concat(F.lit("https://x.com/"), F.col("id").cast("string"))
    df = spark.range(700).select(F.when(F.col("id") < 501, "big").when(F.col("id") < 600, "small").alias("request_id"), url.alias("url"))
    out = pages.bulk_submit(df, priority=0)
    got = {(r["request_id"], r["accepted"], r["reason"]): r["count"] for r in out.groupBy("request_id", "accepted", "reason").count().collect()}
    assert got == {("big", False, "more than 500 urls (501)"): 501, ("small", True, None): 99, (None, True, None): 100}
    assert out.filter("url = 'https://x.com/499'").first().priority == 2


def test_pairs_and_records_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("in\nput", "{}", "classify")], "input string, output string, prompt_type string")
    pages.write_pairs(pairs, str(tmp_path / "pairs"))
    pages.write_pairs(pairs, str(tmp_path / "pairs"))
    assert [tuple(r) for r in pages.read_pairs(spark, str(tmp_path / "pairs")).collect()] == [("in\nput", "{}", "classify")] * 2
    html = "<h1>T</h1><a href='/x'>x</a>"
    spark.createDataFrame([(1, "https://a.com", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    records = extract.extract_pages(pages.read_pages(spark, str(tmp_path / "p")))
    pages.write_page_records(records, str(tmp_path / "records"))
    back = spark.read.json(str(tmp_path / "records")).first()
    assert back.meta.h1 == "T" and back.links[0].href == "https://a.com/x"


def test_entity_lists_of_responses(spark):
    df = spark.createDataFrame([('ok [{"name":"A"},\n{"name":"B"}] end',), ("none",), ("[broken",), ("[]",)], "raw string")
    assert [r[0] for r in df.select(evaluate.parse_entity_list(F.col("raw"))).collect()] == [["A", "B"], None, None, []]
