"""Points in time as parameters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(now: datetime) -> Column:
    """`now` as a zone-less literal. Compared with a TIMESTAMP it is read in the session zone."""
    return F.lit(now.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def days_before(now: datetime, days: int) -> Column:
    return at(now) - F.make_dt_interval(F.lit(int(days)))
