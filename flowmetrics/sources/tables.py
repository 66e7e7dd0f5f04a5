"""Named sources, the classification sheet and the report sink."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmetrics.operators.lifecycle import join_key


class Sources(dict):
    """Opened sources by name; ``errors`` tells why a source could not be opened (it is an empty table then)."""

    def __init__(self):
        super().__init__()
        self.errors: dict[str, str] = {}


def read_sources(
    mapping: Mapping[str, str | Callable[[], DataFrame]], reader: Callable[[str], DataFrame] | None = None, schema: str = ""
) -> Sources:
    """Open many named sources; each value is a function that gives a DataFrame, or a path for ``reader``.

    A source that cannot be opened does not stop the others: it becomes an empty table of ``schema``.
    """
    opened = Sources()
    for name, source in mapping.items():
        try:
            opened[name] = source() if callable(source) else reader(source)
        except Exception as problem:  # noqa: BLE001 - reported in the status
            opened[name] = SparkSession.active().createDataFrame([], schema or T.StructType())
            opened.errors[name] = f"{type(problem).__name__}: {problem}".splitlines()[0]
    return opened


def load_status(sources: Mapping[str, DataFrame]) -> DataFrame:
    """``(fuente, n_registros, estado, aviso)`` per source; no rows means ``ERROR``, ``aviso`` tells of a failed opening."""
    errors = getattr(sources, "errors", {})
    counts = [
        df.agg(F.count("*").alias("n_registros")).select(F.lit(name).alias("fuente"), "n_registros", F.lit(errors.get(name)).cast("string").alias("aviso"))
        for name, df in sources.items()
    ]
    if not counts:
        return SparkSession.active().createDataFrame([], "fuente string, n_registros bigint, estado string, aviso string")
    state = F.when(F.col("n_registros") > 0, "OK").otherwise("ERROR")
    return reduce(DataFrame.unionByName, counts).select("fuente", "n_registros", state.alias("estado"), "aviso")


def normalise_classification(sheet: DataFrame) -> DataFrame:
    return sheet.select(
        join_key(F.col("Cliente")).alias("_join_cliente"),
        join_key(F.col("Campaña")).alias("_join_campana"),
        "tradicional",
    )


def read_classification(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """The classification sheet, saved as CSV (with header) or Parquet, with normalised keys."""
    if format == "csv":
        schema = "Cliente string, `Campaña` string, tradicional int"
        sheet = spark.read.csv(path, header=True, schema=schema, enforceSchema=False,
                               ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        sheet = spark.read.format(format).load(path)
    return normalise_classification(sheet)


def write_report_tables(campaigns: DataFrame, clients: DataFrame, out: str, format: str = "parquet") -> None:
    """Write both display tables below ``out``, one folder per sheet, campaigns newest first.

    The rows are range partitioned by sheet and date, so a sheet with very many campaigns is written by
    several tasks and its files follow each other in order.
    """
    ordered = campaigns.orderBy("hoja", F.desc_nulls_last("orden_fecha"), "Campaña")
    for name, table in (("clientes", clients), ("campanas", ordered)):
        writer = table.write.mode("overwrite").partitionBy("hoja").format(format)
        if format == "csv":
            writer = writer.option("header", True)
        writer.save(f"{out}/{name}")


def write_outliers(outliers: DataFrame, out: str, format: str = "parquet") -> None:
    """Write the rejected transitions, for tracing what was left out of the dead times."""
    writer = outliers.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(out)
