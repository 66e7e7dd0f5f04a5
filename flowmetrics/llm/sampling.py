"""A few rows of each class, spread by hash: for choosing landmarks, not for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_class(rows: DataFrame, key: list[str], label: str, most: int) -> tuple[DataFrame, dict]:
    """At most ``most`` rows of each class, in the order of a hash of the key; and the row count of every class.

    A share of each class a little above ``most`` is cut out by hash first, so only those few rows meet in the ranking.
    """
    counts = {r[label]: r["count"] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0), counts
    order = F.xxhash64(*key, F.lit("sample"))
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, 1.5 * most / n + 50 / n))])
    thinned = rows.where(F.pmod(order, F.lit(1 << 20)) < F.element_at(share, F.col(label)) * (1 << 20))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order, *key))
    return thinned.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank"), counts
