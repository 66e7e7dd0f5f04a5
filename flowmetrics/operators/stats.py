"""Descriptive statistics, outlier bounds and scores relative to a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmetrics.functions.labels import category_rank, ratio, zscore_category
from flowmetrics.operators.order_stats import quantiles, row_positions
from flowmetrics.schemas import quoted, require_columns

# Group columns with a closed vocabulary (the eight station types and ``Otro``): a table with one row per
# group is tiny whatever the data, so it may be broadcast. Any other group table is left to the run-time
# join choice, which broadcasts by measured size and splits skewed keys.
CLOSED_VOCABULARY = frozenset({"tipo_estacion", "tipo_estacion_origen"})


def attach_group(df: DataFrame, per_group: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table with one row per group to the rows of the group."""
    if set(by) <= CLOSED_VOCABULARY:
        per_group = F.broadcast(per_group)
    return df.join(per_group, list(by), how)


def known_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any of the group columns."""
    return df.where(F.expr(" and ".join(f"`{c}` is not null" for c in by))) if by else df


def iqr_bounds(df: DataFrame, col: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Per group ``limite_inferior`` = Q1 - k*IQR and ``limite_superior`` = Q3 + k*IQR."""
    q = quantiles(df, by, {"_q1": (col, 0.25), "_q3": (col, 0.75)})
    spread = F.lit(float(k)) * (F.col("_q3") - F.col("_q1"))
    return q.select(
        *[quoted(c) for c in by],
        (F.col("_q1") - spread).alias("limite_inferior"),
        (F.col("_q3") + spread).alias("limite_superior"),
    )


def iqr_filter(
    df: DataFrame, col: str = "tiempo_total_seg", group_col: str = "tipo_estacion", k: float = 1.5
) -> DataFrame:
    """Keep rows whose ``col`` lies within the IQR bounds of their own group, bounds included."""
    bounds = iqr_bounds(known_keys(df, [group_col]), col, [group_col], k)
    inside = quoted(col).between(F.col("limite_inferior"), F.col("limite_superior"))
    return attach_group(df, bounds, [group_col], "inner").where(inside).select(*[quoted(c) for c in df.columns])


def bounded_metric(df: DataFrame, col: str, upper: float, lower: float = 0.0) -> DataFrame:
    return df.where(quoted(col).between(lower, upper))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a missing value in any of ``cols``."""
    return df.na.drop(subset=list(cols))


def group_zscore(df: DataFrame, by: Sequence[str], col: str, out: str, n_min: int = 2) -> DataFrame:
    """Add ``(x - group median) / group sample deviation``, NULL in groups with fewer than ``n_min`` values."""
    known = known_keys(df, by)
    spread = known.groupBy(*[quoted(c) for c in by]).agg(
        F.count(quoted(col)).alias("_count"), F.stddev_samp(quoted(col)).alias("_std")
    )
    middle = quantiles(known, by, {"_median": (col, 0.5)})
    scored = attach_group(df, spread.join(middle, list(by), "left"), by)
    z = F.when(F.col("_count") >= n_min, ratio(quoted(col) - F.col("_median"), F.col("_std")))
    return scored.withColumn(out, z).select(*[quoted(c) for c in df.columns], out)


def contextual_zscore(
    df: DataFrame,
    context: Sequence[str] = ("cliente", "tipo_estacion"),
    col: str = "mediana_tpp",
    n_min: int = 2,
) -> DataFrame:
    """Add ``z_score``, ``categoria`` and ``categoria_orden`` relative to the rows of the same context."""
    scored = group_zscore(df, list(context), col, "z_score", n_min)
    return scored.withColumn("categoria", zscore_category(F.col("z_score"))).withColumn(
        "categoria_orden", category_rank(F.col("categoria"))
    )


def residual_zscore(df: DataFrame, by: Sequence[str], col: str, out: str, n_min: int = 2) -> DataFrame:
    """``group_zscore`` of model residuals."""
    return group_zscore(df, by, col, out, n_min)


def rank_quartile(df: DataFrame, col: str, ties: Sequence[str], out: str = "cuartil") -> DataFrame:
    """Add ``Q1`` to ``Q4``: four bins of equal width over the row position ordered by ``col``."""
    placed = row_positions(df, col, ties, "_position")
    rows = F.col("_rows")
    number = F.greatest(F.lit(1), F.ceil((F.col("_position") - 1) * 4 / F.nullif(rows - 1, F.lit(0))))
    return placed.withColumn(
        out, F.when(F.col("_position").isNotNull() & (rows > 1), F.concat(F.lit("Q"), number.cast("string")))
    ).drop("_position", "_rows")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _long_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str], stats: Mapping[str, callable]) -> DataFrame:
    """One row per group and column with the given aggregates, from one aggregation over the rows."""
    aggregates = []
    for i, c in enumerate(cols):
        value = quoted(c).cast("double")
        value = F.when(~F.isnan(value), value)
        aggregates += [make(value).alias(f"{name}_{i}") for name, make in stats.items()]
    wide = df.groupBy(*[quoted(c) for c in by]).agg(*aggregates)
    rows = F.array(*[
        F.struct(F.lit(c).alias("columna"), *[F.col(f"{name}_{i}").alias(name) for name in stats])
        for i, c in enumerate(cols)
    ])
    return wide.select(*[quoted(c) for c in by], F.inline(rows))


def _long_quantiles(df: DataFrame, cols: Sequence[str], by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    wanted = {f"{name}_{i}": (c, p) for i, c in enumerate(cols) for name, p in probs.items()}
    wide = quantiles(df, by, wanted)
    rows = F.array(*[
        F.struct(F.lit(c).alias("columna"), *[F.col(f"{name}_{i}").alias(name) for name in probs])
        for i, c in enumerate(cols)
    ])
    return wide.select(*[quoted(c).alias(f"_by{i}") for i, c in enumerate(by)], F.inline(rows))


def _stats_and_quantiles(df, cols, by, stats, probs) -> DataFrame:
    q = _long_quantiles(df, cols, by, probs).withColumnRenamed("columna", "_columna")
    on = F.col("columna") == F.col("_columna")
    for i, c in enumerate(by):
        on = on & quoted(c).eqNullSafe(F.col(f"_by{i}"))
    return _long_stats(df, cols, by, stats).join(q, on, "left").drop("_columna", *[f"_by{i}" for i in range(len(by))])


def _bias_corrected_skew(n: Column, raw: Column, std: Column) -> Column:
    n = n.cast("double")
    corrected = raw * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n > 2, F.when(std == 0, F.lit(0.0)).otherwise(corrected))


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: count, mean, std, min, Q1, median, Q3, max, skew and ``zeros_%`` of all rows."""
    cols = list(cols or numeric_columns(df))
    stats = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "_raw_skew": F.skewness,
        "_zeros": lambda v: F.avg(F.when(v == 0, 1.0).otherwise(0.0)) * 100,
    }
    probs = {"Q1": 0.25, "median": 0.5, "Q3": 0.75}
    if not cols:
        names = ["count", "mean", "std", "min", "Q1", "median", "Q3", "max", "skew", "zeros_%"]
        return df.sparkSession.createDataFrame([], "columna string, " + ", ".join(f"`{n}` double" for n in names))
    table = _stats_and_quantiles(df, cols, [], stats, probs)
    skew = _bias_corrected_skew(F.col("count"), F.col("_raw_skew"), F.col("std"))
    return table.select(
        "columna",
        "count",
        *[F.bround(c, 2).alias(c) for c in ("mean", "std", "min", "Q1", "median", "Q3", "max")],
        F.bround(skew, 2).alias("skew"),
        F.bround("_zeros", 1).alias("zeros_%"),
    )


EFFICIENCY_METRICS = ("tiempo_por_pick", "tiempo_total_seg", "picks", "picks_por_min")


def efficiency_summary(
    df: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] = EFFICIENCY_METRICS
) -> DataFrame:
    """Per group and metric: mean, median, std, CV, Q1, Q3, IQR, p90, p95, n and two labels.

    ``sesgo`` is ``asimetrico`` when the mean exceeds the median by more than 15 %; ``variabilidad`` is
    ``alta`` above a CV of 70, ``moderada`` above 40, else ``baja``.
    """
    require_columns(df, metrics)
    table = _stats_and_quantiles(
        df,
        list(metrics),
        list(by),
        {"media": F.avg, "std": F.stddev_samp, "n": F.count},
        {"mediana": 0.5, "q1": 0.25, "q3": 0.75, "p90": 0.90, "p95": 0.95},
    ).where(F.col("n") > 0)
    cv = ratio(F.col("std"), F.col("media")) * 100
    return table.select(
        *[quoted(c) for c in by],
        F.col("columna").alias("metrica"),
        "media",
        "mediana",
        "std",
        cv.alias("cv"),
        "q1",
        "q3",
        (F.col("q3") - F.col("q1")).alias("iqr"),
        "p90",
        "p95",
        "n",
        F.when(F.col("media") > F.col("mediana") * 1.15, "asimetrico").otherwise("simetrico").alias("sesgo"),
        F.when(cv > 70, "alta").when(cv > 40, "moderada").otherwise("baja").alias("variabilidad"),
    )


def efficiency_text(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One short sentence per group and metric, from :func:`efficiency_summary`."""
    text = F.format_string(
        "%s: n=%d, mediana %.1f, media %.1f (%s), IQR %.1f a %.1f, p90 %.1f, p95 %.1f, CV %.0f%% (variabilidad %s)",
        F.col("metrica"), F.col("n"), F.col("mediana"), F.col("media"), F.col("sesgo"),
        F.col("q1"), F.col("q3"), F.col("p90"), F.col("p95"), F.coalesce(F.col("cv"), F.lit(0.0)), F.col("variabilidad"),
    )
    return summary.select(*[quoted(c) for c in by], "metrica", text.alias("texto"))
