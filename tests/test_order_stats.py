import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowmetrics.operators import order_stats
from flowmetrics.operators.order_stats import average_rank, ordered_bits, positions, previous_row, quantiles, value_counts, weighted_median
from flowmetrics.operators.stats import contextual_zscore, describe_numeric, iqr_filter, rank_quartile


@pytest.fixture(scope="module")
def skewed():
    """One group holds a third of all rows, and a third of those share one value."""
    rng = np.random.default_rng(11)
    n = 6000
    group = np.where(rng.random(n) < 1 / 3, "hot", rng.integers(0, 40, n).astype(str))
    value = np.round(np.where(rng.random(n) < 1 / 3, 7.5, rng.lognormal(3, 2, n) - 20), 3)
    pdf = pd.DataFrame({"g": group, "v": value, "w": rng.integers(0, 9, n), "u": rng.integers(-5, 5, n).astype(float)})
    pdf.loc[rng.random(n) < 0.05, "v"] = np.nan
    pdf.loc[rng.random(n) < 0.05, "g"] = None
    return pdf


@pytest.fixture(scope="module")
def frame(spark, skewed):
    rows = [tuple(None if pd.isna(x) else (int(x) if i == 2 else x) for i, x in enumerate(r)) for r in skewed.itertuples(index=False)]
    rows = [(g, None if v is None else float(v), w, float(u)) for g, v, w, u in rows]
    return spark.createDataFrame(rows, "g string, v double, w bigint, u double").repartition(6)


def test_quantiles_equal_pandas(frame, skewed):
    wanted = {"a": ("v", 0.05), "b": ("v", 0.5), "c": ("v", 0.9), "d": ("u", 0.5)}
    got = quantiles(frame, ["g"], wanted).toPandas().set_index("g")
    expected = skewed.groupby("g", dropna=False)
    for name, (col, p) in wanted.items():
        want = expected[col].quantile(p)
        assert len(got) == len(want)
        for g, x in want.items():
            key = got.index.isna() if pd.isna(g) else got.index == g
            assert got[name][key].iloc[0] == pytest.approx(x, rel=1e-12)


def test_quantiles_of_whole_table_and_of_empty_groups(spark, frame, skewed):
    assert quantiles(frame, [], {"m": ("v", 0.5)}).first()["m"] == pytest.approx(skewed.v.median())
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", -0.0), ("b", 0.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in quantiles(df, ["g"], {"m": ("v", 0.5)}).collect()}
    assert got == {"a": None, "b": 0.0}


def numpy_weighted_median(values, weights):
    order = np.argsort(values, kind="stable")
    share = np.cumsum(weights[order]) / weights.sum()
    return values[order][min(np.searchsorted(share, 0.5), len(values) - 1)]


def test_weighted_median_equals_numpy(frame, skewed):
    got = {r["g"]: r["m"] for r in weighted_median(frame, ["g"], "v", "w", "m").collect()}
    for g, part in skewed.dropna().groupby("g"):
        assert got[g] == numpy_weighted_median(part.v.to_numpy(), part.w.to_numpy())


def test_average_rank_equals_pandas(frame, skewed):
    got = average_rank(frame.where("g is not null"), ["g"], {"v": "r"}).toPandas()
    want = skewed.dropna(subset=["g"])
    want = want.assign(r=want.groupby("g").v.rank(method="average"))
    order = ["g", "v", "w", "u", "r"]
    a = got[order].sort_values(order).reset_index(drop=True)
    b = want[order].sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 10, 11, 23, 500])
def test_rank_quartile_equals_qcut(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("k"), (F.col("id") * 7 % 5).cast("double").alias("v"))
    got = rank_quartile(df, "v", ["k"]).groupBy("cuartil").count().toPandas()
    if n == 1:
        assert got.cuartil.isna().all()
        return
    want = pd.qcut(pd.Series(range(1, n + 1)), 4, labels=["Q1", "Q2", "Q3", "Q4"]).value_counts()
    assert dict(zip(got.cuartil, got["count"])) == {k: v for k, v in want.items() if v}
    # a higher quartile never holds a smaller value
    limits = rank_quartile(df, "v", ["k"]).groupBy("cuartil").agg(F.min("v"), F.max("v")).orderBy("cuartil").collect()
    assert all(a[2] <= b[1] for a, b in zip(limits, limits[1:]))


def test_iqr_filter_drops_missing_and_keeps_bounds(frame, skewed):
    got = iqr_filter(frame, "v", "g", 1.5).count()
    q1, q3 = skewed.groupby("g").v.quantile(0.25), skewed.groupby("g").v.quantile(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    known = skewed.dropna(subset=["g", "v"])
    assert got == int(known.v.between(known.g.map(lo), known.g.map(hi)).sum())


@pytest.mark.parametrize("hot_rows", [10**6, 500, 1])
def test_previous_row_is_the_same_however_groups_are_split(spark, hot_rows):
    rng = np.random.default_rng(5)
    n = 3000
    rows = []
    for i in range(n):
        key = None if i % 97 == 0 else ("hot" if rng.random() < 0.4 else str(int(rng.integers(0, 300))))
        at = None if rng.random() < 0.02 else int(rng.integers(0, 100_000))
        rows.append((i, key, at))
    df = spark.createDataFrame(rows, "i bigint, k string, t bigint").repartition(5)
    out = previous_row(df, ["k"], [F.col("t"), F.col("i")], ["i"], F.floor(F.col("t") / 1000), "p", hot_rows)
    got = {r["i"]: (r["p"]["i"] if r["p"] else None) for r in out.collect()}
    assert len(got) == n
    last = {}
    want = {}
    for i, k, t in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        want[i] = last.get(k) if k is not None else None
        last[k] = i
    assert got == want


def test_contextual_zscore_small_and_constant_groups(spark):
    rows = [("a", "x", 1.0), ("a", "x", 3.0), ("a", "x", 8.0), ("b", "x", 5.0), ("c", "x", 2.0), ("c", "x", 2.0), (None, "x", 1.0)]
    df = spark.createDataFrame(rows, "cliente string, tipo_estacion string, mediana_tpp double")
    got = {(r.cliente, r.mediana_tpp): (r.z_score, r.categoria) for r in contextual_zscore(df).collect()}
    std = np.std([1, 3, 8], ddof=1)
    assert got[("a", 8.0)] == (pytest.approx(5 / std), "critico")
    assert got[("b", 5.0)] == got[("c", 2.0)] == got[(None, 1.0)] == (None, "sin_referencia")


def test_describe_numeric_equals_pandas(spark, frame, skewed):
    got = describe_numeric(frame.select("v", "u", "w")).toPandas().set_index("columna")
    num = skewed[["v", "u", "w"]]
    assert got["count"].to_dict() == num.count().to_dict()
    for name, want in (("mean", num.mean()), ("std", num.std()), ("Q1", num.quantile(0.25)), ("median", num.median()),
                       ("Q3", num.quantile(0.75)), ("max", num.max()), ("skew", num.skew())):
        for c in num:
            assert got[name][c] == pytest.approx(want[c], abs=0.0051)
    assert got["zeros_%"]["u"] == pytest.approx((num.u == 0).mean() * 100, abs=0.051)
    flat = describe_numeric(spark.createDataFrame([(2.0,), (2.0,), (2.0,)], "x double")).first()
    assert flat["skew"] == 0.0 and flat["std"] == 0.0
    assert describe_numeric(spark.createDataFrame([("a",)], "x string")).count() == 0


def test_ordered_bits_are_those_of_ieee(spark):
    import struct

    rng = np.random.default_rng(2)
    some = [0.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), 1.0, 0.1, *(2.0**k for k in range(-1074, 1024, 7))]
    some += [np.nextafter(2.0**k, way) for k in range(-1000, 1000, 13) for way in (0.0, np.inf)]
    some += np.frombuffer(rng.bytes(8 * 4000), np.float64).tolist()
    some = [float(x) for x in some if np.isfinite(x) or x == float("inf")]
    some += [-x for x in some]
    got = {r.v: r.b for r in spark.createDataFrame([(x,) for x in some], "v double").select("v", ordered_bits(F.col("v")).alias("b")).collect()}
    for x, b in got.items():
        bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert b == (-bits if x < 0 else bits), x


def test_close_values_are_spread_over_tasks(spark):
    """A million distinct values within 0.1 %, beside a wide group: exact, and no task sorts much more than others."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(F.lit("tight").alias("g"), (1000 + F.col("id") * F.lit(1e-6)).alias("v"))
    df = df.unionByName(spark.range(1000).select(F.lit("wide").alias("g"), F.exp(F.col("id").cast("double") / 10).alias("v")))
    got = {r.g: r for r in quantiles(df, ["g"], {"a": ("v", 0.25), "b": ("v", 0.999)}).collect()}
    assert got["tight"].a == pytest.approx(1000 + 0.25 * (n - 1) * 1e-6, rel=1e-13) and got["tight"].b == pytest.approx(1000 + 0.999 * (n - 1) * 1e-6, rel=1e-13)
    assert got["wide"].a == pytest.approx(np.quantile(np.exp(np.arange(1000) / 10), 0.25))
    placed = positions(value_counts(df, ["g"], ["v"]))
    sizes = [r["count"] for r in placed.where("_k.k0 = 'tight'").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    assert sum(sizes) == n and len(sizes) >= 4 and max(sizes) <= 2 * np.median(sizes)
    assert placed.where("_k.k0 = 'tight'").agg(F.max(F.abs(F.col("_before") - F.round((F.col("_v") - 1000) * 1e6)))).first()[0] == 0


def test_every_depth_of_the_selection_gives_the_same(frame, skewed, monkeypatch):
    want = {r.g: (r.a, r.b) for r in quantiles(frame, ["g"], {"a": ("v", 0.3), "b": ("v", 0.95)}).collect()}
    ranks = sorted(average_rank(frame.where("g is not null"), ["g"], {"v": "r"}).select("g", "v", "r").toPandas().fillna(-1).itertuples(index=False, name=None))
    monkeypatch.setattr(order_stats, "SORTED_VALUES", 1)
    assert {r.g: (r.a, r.b) for r in quantiles(frame, ["g"], {"a": ("v", 0.3), "b": ("v", 0.95)}).collect()} == want
    assert sorted(average_rank(frame.where("g is not null"), ["g"], {"v": "r"}).select("g", "v", "r").toPandas().fillna(-1).itertuples(index=False, name=None)) == ranks
