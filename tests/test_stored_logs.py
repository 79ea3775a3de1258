"""Logs by day, and latency sketches."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from sitelore.sources.logs import LogStore
from sitelore.streaming import windows

from .test_plans import explain

SCHEMA = "id long, ts timestamp_ntz, level string"


def log(spark, days, level="info", first=datetime(2024, 1, 1)):
    rows = [(100 * d + k, first + timedelta(days=d, hours=k), level) for d in days for k in range(24)]
    return spark.createDataFrame(rows + [(-1, None, level)], SCHEMA)


def test_days_are_replaced_alone_and_removed(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    assert store.days("ops") == [] and store.read("ops", SCHEMA).count() == 0 and store.retain("ops", 1, datetime(2024, 1, 1)) == []
    store.write("ops", log(spark, range(10)))
    store.write("ops", log(spark, [3], "again").filter("ts is not null"))
    rows = store.read("ops", SCHEMA)
    assert rows.count() == 241 and rows.filter("level = 'again'").select(F.to_date("ts")).distinct().collect()[0][0] == date(2024, 1, 4)
    part = store.read("ops", SCHEMA, datetime(2024, 1, 3, 12), datetime(2024, 1, 5, 6))
    assert part.count() == 12 + 24 + 6
    plan = explain(part)
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    gone = store.retain("ops", 30, datetime(2024, 2, 5, 12))
    assert gone == [date(2024, 1, d) for d in range(1, 6)] and store.days("ops")[0] == date(2024, 1, 6)
    assert store.read("ops", SCHEMA).filter("ts is null").count() == 1  # rows without a time are not removed
    left = store.read("ops", SCHEMA, since=datetime(2024, 1, 6, 12))
    assert left.count() == 12 + 4 * 24


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    rows = spark.range(200_000).select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id % 86400)").alias("ts"),
                                       F.lit("info").alias("level"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write("hot", rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(f"{tmp_path}/hot").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 4 and max(r["count"] for r in files) < 100_000


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(4)
    values = [(k % 7, k % 5, rng.lognormvariate(5, 1.5)) for k in range(20_000)] + [(0, 0, 0.0), (0, 0, -3.0), (0, 0, None)]
    rows = spark.createDataFrame(values, "day int, host int, ms double")
    for error in (0.01, 0.05):
        whole = windows.latency_sketch(rows, "ms", [F.col("host")], error)
        parts = windows.latency_sketch(rows, "ms", [F.col("host"), F.col("day")], error)
        for share in (0.5, 0.95, 1.0):
            got = {r.host: (r.n, r.value) for r in windows.sketch_quantile(parts, share, ["host"], error).collect()}
            assert got == {r.host: (r.n, r.value) for r in windows.sketch_quantile(whole, share, ["host"], error).collect()}
            for host, (n, value) in got.items():
                own = sorted(v for _, h, v in values if h == host and v is not None)
                exact = own[-(-int(share * 1000) * n // 1000) - 1]
                assert n == len(own) and abs(value - exact) <= error * 1.000001 * max(exact, 0)
    assert windows.sketch_quantile(windows.latency_sketch(rows.limit(0), "ms", []), 0.95, []).count() == 0
