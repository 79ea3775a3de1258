"""J4 and J5 as stateful stream operators: politeness gate and breaker.

Rows are buffered per key until the watermark has passed them and are then replayed in event-time order, so the result
does not depend on how the log is split into micro-batches. State per key: two numbers and the rows still inside the
watermark delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sitelore.functions.gates import OPEN, gate_steps


class GateProcessor(StatefulProcessor):
    def __init__(self, columns: list[str], failures: int):
        self.columns, self.failures = columns, failures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gate = handle.getValueState("gate", "failure_count long, until long")
        # rows waiting for the watermark, by time and tie
        self.waiting = handle.getMapState("waiting", "us long, tie long", "failed boolean, hold long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for us, tie, failed, hold in zip(pdf["us"], pdf["tie_key"], pdf["is_failed"], pdf["hold_us"], strict=True):
                self.waiting.updateValue((int(us), int(tie)), (bool(failed), int(hold)))
                self.handle.registerTimer(int(us) // 1000 + 1)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due_ms = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((us, tie, failed, hold) for (us, tie), (failed, hold) in self.waiting.iterator()
                       if us // 1000 + 1 <= due_ms)
        if not ready:
            yield pd.DataFrame(columns=self.columns)
            return
        count, until = self.gate.get() if self.gate.exists() else (0, OPEN)
        out = []
        steps = gate_steps(((us, failed, hold) for us, _, failed, hold in ready), count, until, self.failures)
        for (us, tie, _, _), (attempted, count, until) in zip(ready, steps, strict=True):
            out.append((key[0], tie, us, attempted, count, None if until == OPEN else until))
            self.waiting.removeKey((us, tie))
        self.gate.update((int(count), int(until)))
        pdf = pd.DataFrame(out, columns=self.columns)
        pdf[self.columns[-1]] = pd.array([row[-1] for row in out], dtype="Int64")
        yield pdf

    def close(self) -> None:
        pass


def _gate(stream: DataFrame, key: str, ts: str, tie: str, watermark: str, failed: Column, hold_us: Column,
          failures: int) -> DataFrame:
    schema = T.StructType([
        T.StructField(key, stream.schema[key].dataType), T.StructField(tie, T.LongType()),
        T.StructField("us", T.LongType()), T.StructField("attempted", T.BooleanType()),
        T.StructField("failure_count", T.LongType()), T.StructField("blocked_until_us", T.LongType())])
    rows = (stream.withWatermark(ts, watermark)
            .withColumn("us", F.expr(f"unix_micros({ts})")).withColumn("tie_key", F.col(tie).cast("bigint"))
            .withColumn("is_failed", failed).withColumn("hold_us", hold_us.cast("bigint")))
    return (rows.select(key, ts, "us", "tie_key", "is_failed", "hold_us").groupBy(key)
            .transformWithStateInPandas(GateProcessor(schema.names, failures), schema, "Append", "EventTime"))


def politeness_gate_stream(requests: DataFrame, default_ms: int = 1000, max_ms: int = 3_600_000, ts: str = "ts",
                           tie: str = "id", watermark: str = "1 minute") -> DataFrame:
    """`frontier.politeness_gate` on a stream (domain, ts timestamp, id bigint[, delay_ms])."""
    own = F.col("delay_ms") if "delay_ms" in requests.columns else F.lit(None)
    delay = F.least(F.coalesce(own, F.lit(default_ms)), F.lit(max_ms))
    return (_gate(requests, "domain", ts, tie, watermark, F.lit(True), delay * 1000, 1)
            .withColumnRenamed("attempted", "allowed").drop("failure_count", "blocked_until_us"))


def breaker_stream(log: DataFrame, failures: int = 3, cooldown_seconds: int = 300, provider: str = "provider",
                   ts: str = "ts", tie: str = "id", watermark: str = "1 minute") -> DataFrame:
    """`frontier.breaker` on a stream (provider, ts timestamp, id bigint, ok)."""
    return _gate(log, provider, ts, tie, watermark, ~F.coalesce("ok", F.lit(False)),
                 F.lit(cooldown_seconds * 1_000_000), failures)
