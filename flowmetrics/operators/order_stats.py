"""Exact order statistics that stay distributed inside a group.

One group may hold a large part of all rows, so no operator here sorts or collects a whole group in one task. Values are
counted per group first, which collapses repeats before any shuffle of size. Positions are then found by radix selection
on :func:`ordered_bits`, the order-preserving 64-bit image of a double: values are counted by the top 16 bits of their
image, only cells that hold a wanted position go on, and cells of more than ``SORTED_VALUES`` distinct values are cut by the
next 16 bits. After four rounds a cell is a single value, so the result and the largest sort do not depend on how close the
values of a group lie together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmetrics.schemas import quoted
from flowmetrics.session import settle, settle_and_measure

DIGIT_BITS, DIGITS = 16, 4
#: Distinct values that one task may sort.
SORTED_VALUES = 50_000
HOT_GROUP_ROWS = 1_000_000
LAST_SPAN = 2**62


def ordered_bits(value: Column) -> Column:
    """A long that orders as the double does: its IEEE 754 bits, negated for negative numbers; 0 for NULL.

    Built from exact operations, as SQL has no cast to bits: the exponent is corrected where the logarithm rounds across a
    power of two, and the division by that power is exact.
    """
    size = F.abs(value)
    exponent = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.coalesce(F.log2(size), F.lit(-1022.0))))
    near = F.floor(exponent).cast("int")
    first = size / F.pow(F.lit(2.0), near.cast("double"))
    power = F.when((first >= 2) & (near < 1023), near + 1).when((first < 1) & (near > -1022), near - 1).otherwise(near)
    fraction = size / F.pow(F.lit(2.0), power.cast("double"))
    whole = F.lit(2.0**52)
    bits = (power + 1022).cast("long") * F.lit(2**52) + F.when(size < float("inf"), fraction * whole).otherwise(2 * whole).cast("long")
    return F.when(value < 0, -bits).when(value >= 0, bits).otherwise(F.lit(0).cast("long"))


def present(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number(name: str) -> str:
    """A column as a double; -0.0 becomes 0.0 and NaN becomes NULL."""
    value = f"cast({_sql_name(name)} as double)"
    return f"nullif({value} + 0.0D, double('NaN'))"


def _key(by: Sequence[str], metric: str = "0") -> str:
    """All group columns as one struct, so that NULL keys join with each other."""
    parts = [f"'k{i}', {_sql_name(c)}" for i, c in enumerate(by)]
    return f"named_struct({', '.join([*parts, f"'m', {metric}"])}) as _k"


def _unpack(by: Sequence[str]) -> list[str]:
    return [f"_k.k{i} as {_sql_name(c)}" for i, c in enumerate(by)]


def value_counts(df: DataFrame, by: Sequence[str], cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """Rows ``(_k, _v, _n, _i)``, settled: weight and bits of each value per group and metric; ``_k.m`` is the metric number.

    Missing values become one row of weight 0, so a group without any value is still known.
    """
    w = "1L" if weight is None else f"coalesce({_sql_name(weight)}, 0)"
    if len(cols) == 1:
        long = df.selectExpr(_key(by), f"{_number(cols[0])} as _v", f"{w} as _w")
    else:
        pairs = ", ".join(f"named_struct('_m', {i}, '_v', {_number(c)})" for i, c in enumerate(cols))
        keys = [_sql_name(c) for c in by]
        long = df.selectExpr(*keys, f"{w} as _w", f"inline(array({pairs}))").selectExpr(_key(by, "_m"), "_v", "_w")
    counted = long.groupBy("_k", "_v").agg(F.expr("sum(if(_v is null, 0, _w)) as _n"))
    return settle(counted.withColumn("_i", ordered_bits(F.col("_v"))))


def _digit(number: int) -> Column:
    """The image without the bits behind digit ``number``; smaller images have smaller or equal ones."""
    return F.shiftright("_i", (DIGITS - 1 - number) * DIGIT_BITS)


def positions(counts: DataFrame, wanted: str = "true") -> DataFrame:
    """Value counts in cells where ``wanted`` holds, with ``_before`` (weight of smaller values in the group) and ``_total``.

    ``wanted`` sees a cell's ``_size`` (weight), ``_off`` (weight of the group's earlier cells) and ``_total``. A group has at
    most 65,536 cells per cell of the round before, each round's cells are settled, and most groups need one round.
    """
    placed, parents = [], None
    for number in range(DIGITS):
        rows = counts.withColumn("_c", _digit(number))
        sizes = [F.sum("_n").alias("_size"), F.count("*").alias("_values")]
        if parents is None:
            cells = rows.groupBy("_k", "_c").agg(*sizes)
            group, start, total = "_k", "0", "sum(_size) over (partition by _k)"
        else:
            above = parents.selectExpr("_k", "_c as _p", "_off as _start", "_total")
            cells = rows.withColumn("_p", _digit(number - 1)).join(above, ["_k", "_p"]).groupBy("_k", "_p", "_c", "_start", "_total").agg(*sizes)
            group, start, total = "_k, _p", "_start", "_total"
        earlier = f"sum(_size) over (partition by {group} order by _c rows between unbounded preceding and 1 preceding)"
        cells = cells.selectExpr("_k", "_c", "_size", "_values", f"{start} + coalesce({earlier}, 0) as _off", f"{total} as _total")
        cells, most = settle_and_measure(cells.where(wanted), F.max("_values"))
        most = most or 0
        last = most <= SORTED_VALUES or number == DIGITS - 1
        fit = (cells if last else cells.where(F.col("_values") <= SORTED_VALUES)).select("_k", "_c", "_off", "_total")
        placed.append(rows.join(fit, ["_k", "_c"]).withColumn("_d", F.lit(number)))
        if last:
            break
        parents = cells.where(F.col("_values") > SORTED_VALUES)
    inside = "sum(_n) over (partition by _k, _d, _c order by _v rows between unbounded preceding and current row)"
    return reduce(DataFrame.unionByName, placed).selectExpr("_k", "_v", "_n", f"_off + {inside} - _n as _before", "_total")


def quantiles(df: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[str, float]], weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group; a row counts ``weight`` (a whole number) times.

    ``wanted`` maps output names to ``(column, p)``. NULL and NaN are skipped, NULL group keys form a
    group, and a group with no value at all has NULL quantiles.
    """
    cols = list(dict.fromkeys(c for c, _ in wanted.values()))
    probs = sorted({p for _, p in wanted.values()})
    counts = value_counts(df, by, cols, weight)

    # 0-based positions around p*(n-1); only the cells that hold one of them go on
    at = {p: f"({p!r}D * (_total - 1))" for p in probs}
    ends = [f"{side}({at[p]})" for p in probs for side in ("floor", "ceil")]
    hits = " or ".join(["_total = 0", *[f"({e} >= _off and {e} < _off + _size)" for e in ends]])
    placed = positions(counts, hits)

    picked = []
    for i, p in enumerate(probs):
        for side in ("floor", "ceil"):
            e = f"{side}({at[p]})"
            picked.append(F.expr(f"max(if({e} >= _before and {e} < _before + _n, _v, null)) as {side}{i}"))
        picked.append(F.expr(f"max({at[p]} - floor({at[p]})) as fraction{i}"))
    per_metric = placed.groupBy("_k").agg(*picked)
    value = {p: f"floor{i} + (ceil{i} - floor{i}) * fraction{i}" for i, p in enumerate(probs)}
    if len(cols) == 1:
        return per_metric.selectExpr(*_unpack(by), *[f"{value[p]} as {_sql_name(n)}" for n, (_, p) in wanted.items()])
    wide = [
        F.expr(f"max(if(_k.m = {cols.index(c)}, {value[p]}, null)) as {_sql_name(n)}") for n, (c, p) in wanted.items()
    ]
    return per_metric.groupBy(*[F.expr(e) for e in _unpack(by)]).agg(*wide)


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Smallest value whose share of the cumulated weight reaches one half."""
    counts = value_counts(df, by, [value], weight)
    placed = positions(counts, "(_off + _size) * 2 >= _total and (_off * 2 < _total or _total = 0)")
    reached = placed.where("(_before + _n) * 2 >= _total")
    return reached.groupBy("_k").agg(F.min("_v").alias(out)).selectExpr(*_unpack(by), _sql_name(out))


def average_rank(df: DataFrame, by: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """Add tie-averaged ranks within the group; ``cols`` maps value columns to rank columns."""
    ranked = df
    for value, out in cols.items():
        counts = value_counts(df, by, [value])
        ranks = positions(counts).selectExpr(
            "_k", "_v", f"_before + (_n + 1) / 2.0D as {_sql_name(out)}"
        )
        keyed = ranked.selectExpr("*", _key(by), f"{_number(value)} as _v")
        ranked = keyed.join(ranks, ["_k", "_v"], "left").drop("_k", "_v")
    return ranked


def row_positions(df: DataFrame, value: str, ties: Sequence[str], out: str) -> DataFrame:
    """Add the 1-based position of each row ordered by ``value``, and the number of rows as ``_rows``.

    Equal values are ordered by the MD5 text of the ``ties`` columns, which spreads a large run of equal
    values evenly over 4096 slices; each slice is numbered on its own. Rows without a value get NULL.
    """
    counts = value_counts(df, [], [value])
    starts = positions(counts).select(
        F.col("_v"), F.col("_before"), F.col("_total").alias("_rows")
    )
    digest = F.md5(F.concat_ws("\u0001", *[F.coalesce(quoted(c).cast("string"), F.lit("\u0000")) for c in ties]))
    rows = df.withColumns({"_v": F.expr(_number(value)), "_h": digest}).withColumn(
        "_s", F.substring("_h", 1, 3)
    )
    slices = rows.where(present(F.col("_v"))).groupBy("_v", "_s").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy("_v").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        slices.withColumn("_off", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .join(starts, "_v")
        .select("_v", "_s", (F.col("_before") + F.col("_off")).alias("_start"), "_rows")
    )
    inside = Window.partitionBy("_v", "_s").orderBy("_h", *[quoted(c) for c in ties])
    return (
        rows.withColumn("_in", F.row_number().over(inside))
        .join(slices, ["_v", "_s"], "left")
        .withColumn(out, F.col("_start") + F.col("_in"))
        .drop("_v", "_h", "_s", "_in", "_start")
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    carry: Sequence[str],
    span: Column,
    out: str,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Add ``out``: the ``carry`` columns of the row before this one in its group, as a struct.

    Missing values come last in ``order``. The first row of a group, and rows with a NULL key, get NULL.

    A group of more than ``hot_rows`` rows is cut by ``span``, a whole number that must not decrease along
    ``order`` (an hour, a block of numbers; NULL comes last). Each span is sorted on its own, and its
    first row takes the last row of the span before it from a table with one row per span. There are fewer
    hot groups than rows / ``hot_rows``, so their keys may be broadcast.
    """
    names = [quoted(k) for k in keys]
    usable = reduce(and_, [k.isNotNull() for k in names])
    hot = (
        df.where(usable).groupBy(*names).agg(F.count("*").alias("_rows_in_group"))
        .where(F.col("_rows_in_group") > hot_rows)
        .select(*[k.alias(f"_h{i}") for i, k in enumerate(names)], F.lit(True).alias("_hot"))
    )
    is_hot = reduce(and_, [k == F.col(f"_h{i}") for i, k in enumerate(names)])
    marked = df.join(F.broadcast(hot), is_hot, "left").withColumn(
        "_span", F.when(F.col("_hot"), F.coalesce(span.cast("long"), F.lit(LAST_SPAN))).otherwise(F.lit(0))
    )
    carried = F.struct(*[quoted(c) for c in carry])
    inside = Window.partitionBy(*names, F.col("_span")).orderBy(*[c.asc_nulls_last() for c in order])
    lagged = marked.withColumn("_lag", F.lag(carried).over(inside))

    position = F.struct(*[part for c in order for part in (c.isNull(), c)])
    last = marked.where(F.col("_hot")).groupBy(*names, F.col("_span")).agg(F.max_by(carried, position).alias("_last"))
    along = Window.partitionBy(*names).orderBy("_span")
    edges = last.select(
        *[k.alias(f"_e{i}") for i, k in enumerate(names)],
        F.col("_span").alias("_espan"),
        F.lag("_last").over(along).alias("_carried"),
    ).where(F.col("_carried").isNotNull())
    on = reduce(and_, [k == F.col(f"_e{i}") for i, k in enumerate(names)]) & (F.col("_span") == F.col("_espan"))
    joined = lagged.join(edges, on, "left")
    before = F.when(usable, F.coalesce(F.col("_lag"), F.col("_carried")))
    return joined.select(*[quoted(c) for c in df.columns], before.alias(out))
