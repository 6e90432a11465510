"""Registry of queries, each with the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.checks.model import Model, oracle_text

BUILDERS: dict[str, Callable[[Model], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query over the model views; ``sql`` is its oracle, if SQL can say it."""

    def add(build):
        if name in BUILDERS:
            raise ValueError(f"registered twice: {name}")
        BUILDERS[name] = build
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return build

    return add


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    out = BUILDERS[name](Model(spark, folder))
    zoned = [f.name for f in out.schema.fields if f.dataType.simpleString() == "timestamp"]
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})
