"""Registry of the checked queries: a name, a Spark function and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmetrics.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 4):
    """Register ``fn(spark, sf_dir)``; doubles of its result are rounded, timestamps shown as text."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shown(fn(configure(spark), sf_dir), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def shown(df: DataFrame, digits: int = 4) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        c = F.col("`" + field.name + "`")
        if isinstance(field.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DayTimeIntervalType):
            c = F.round(F.unix_micros((F.lit("1970-01-01").cast("timestamp") + c)) / F.lit(1e6), digits) + F.lit(0.0)
        columns.append(c.alias(field.name))
    return df.select(*columns)
