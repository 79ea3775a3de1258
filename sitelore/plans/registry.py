"""Registered queries: name, Spark plan and, where SQL can state it, the oracle text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelore import fixtures
from sitelore.session import ensure_checkpoint_dir

Plan = Callable[["Data"], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


class Data:
    """The given tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def view(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        return fixtures.sql(self.spark, self.sf_dir, text)

    def stored(self, name: str, build: Callable[[str], object]) -> str:
        """The folder of an index over these tables. `build(folder)` writes it in the first call of an application;
        later calls find it, unless the checkpoint folder has been emptied."""
        context = self.spark.sparkContext
        known = context.__dict__.setdefault("_sitelore_stored", {})
        path = known.get((self.sf_dir, name))
        if path is not None:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            if folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
                return path
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/sitelore/{uuid.uuid4().hex}"
        build(path)
        known[(self.sf_dir, name)] = path
        return path


def query(name: str, views: str = "", oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan. `oracle` is DuckDB SQL; `views` are the fixture CTEs placed in front of it."""
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if oracle is not None:
            ORACLES[name] = fixtures.oracle(views, oracle) if views else oracle
        return plan

    return register
