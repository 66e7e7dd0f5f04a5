"""Quality report over several tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmetrics.operators.nested import is_nested
from flowmetrics.schemas import quoted


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def _comparable(name: str, kind: T.DataType) -> Column:
    """The value itself, so that equal means equal to the microsecond; maps as sorted entries, deeper maps as text."""
    if isinstance(kind, T.MapType) and not _has_map(kind.keyType) and not _has_map(kind.valueType):
        return F.array_sort(F.map_entries(quoted(name)))
    return F.to_json(quoted(name)) if _has_map(kind) else quoted(name)


def _copies(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``d``: rows that repeat an earlier one in ``columns``."""
    keys = [_comparable(c, df.schema[c].dataType).alias(f"_{i}") for i, c in enumerate(columns)]
    rows = df.select(*keys)
    groups = rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies"))
    return groups.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("d"))


def _missing(name: str, kind: T.DataType) -> Column:
    value = quoted(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def table_quality(name: str, df: DataFrame) -> DataFrame:
    """Quality rows of one table, see :func:`quality_report`."""
    flat = [f for f in df.schema.fields if not is_nested(f.dataType)]
    nested = [f.name for f in df.schema.fields if is_nested(f.dataType)]

    # the counts come from one pass without any shuffle of size; the duplicates from grouping by the values
    shares = [F.avg(F.when(_missing(f.name, f.dataType), 100.0).otherwise(0.0)).alias(f"s{i}") for i, f in enumerate(flat)]
    counts = df.agg(F.count("*").alias("n"), *shares)
    copies = _copies(df, df.columns)

    entry = lambda metric, column, value: F.struct(
        F.lit(name).alias("tabla"),
        F.lit(metric).alias("metrica"),
        F.lit(column).cast("string").alias("columna"),
        value.cast("double").alias("valor"),
    )
    nulls = [entry("pct_nulos", f.name, F.bround(f"s{i}", 1)) for i, f in enumerate(flat)]
    first = counts.select(F.inline(F.array(
        entry("filas", None, F.col("n")),
        entry("columnas", None, F.lit(len(df.columns))),
        *nulls,
        *[entry("anidada", c, F.lit(1)) for c in nested],
    ))).where((F.col("metrica") != "pct_nulos") | (F.col("valor") > 0))
    parts = [first, copies.select(F.inline(F.array(entry("duplicados_fila", None, F.col("d")))))]
    if "id" in df.columns:
        parts.append(_copies(df, ["id"]).select(F.inline(F.array(entry("duplicados_id", None, F.col("d"))))))
    return reduce(DataFrame.unionByName, parts)


def quality_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Long table ``(tabla, metrica, columna, valor)`` over all tables.

    Metrics: ``filas``, ``columnas``, ``pct_nulos`` of each flat column that has any, ``duplicados_fila``
    and, where there is an ``id``, ``duplicados_id`` (the first copy is not counted), and ``anidada`` for
    each nested column, which is not opened.
    """
    return reduce(DataFrame.unionByName, [table_quality(name, df) for name, df in tables.items()])


def sorted_report(report: DataFrame) -> DataFrame:
    """The report by table and metric, highest share of missing values first."""
    return report.orderBy("tabla", "metrica", F.desc("valor"), "columna")
