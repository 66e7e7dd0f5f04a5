"""Histogram boosting against a plain booster over all rows."""

import numpy as np
import pandas as pd
import pytest

from flowmetrics.operators import boosting
from flowmetrics.operators.adjust import encoding_weight


def plain_bins(values, weights=None):
    """Share of weight below each value, in steps of 1/255."""
    weights = np.ones(len(values)) if weights is None else weights
    below = np.array([weights[values < v].sum() for v in values])
    return np.minimum(254, np.floor(below * 255 / weights.sum())).astype(int)


def plain_boost(bins, y, rounds, leaves, least, rate):
    """Best-first trees by trying every split of every leaf on its rows; a function from bins to predictions."""
    trees, now = [], np.full(len(y), y.mean())
    for _ in range(rounds):
        residual = y - now
        parts = [(np.arange(len(y)), [])]
        while len(parts) < leaves:
            best = None
            for p, (rows, _) in enumerate(parts):
                for f in range(bins.shape[1]):
                    for b in np.unique(bins[rows, f]):
                        left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                        if min(len(left), len(right)) < least:
                            continue
                        r = residual
                        gain = r[left].sum() ** 2 / len(left) + r[right].sum() ** 2 / len(right) - r[rows].sum() ** 2 / len(rows)
                        if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                            best = gain, p, f, b, left, right
            if best is None:
                break
            _, p, f, b, left, right = best
            path = parts.pop(p)[1]
            parts += [(left, [*path, (f, b, True)]), (right, [*path, (f, b, False)])]
        if len(parts) == 1:
            break
        tree = [(path, rate * residual[rows].mean()) for rows, path in parts]
        trees.append(tree)
        now = now + apply_tree(tree, bins)
    return lambda x: y.mean() + sum((apply_tree(t, x) for t in trees), np.zeros(len(x)))


def apply_tree(tree, bins):
    out = np.zeros(len(bins))
    for path, value in tree:
        inside = np.ones(len(bins), bool)
        for f, b, left in path:
            inside &= (bins[:, f] <= b) == left
        out[inside] = value
    return out


def data(n, seed):
    rng = np.random.default_rng(seed)
    x0, x1 = rng.normal(0, 1, n), rng.integers(0, 6, n).astype(float)
    client = np.where(rng.random(n) < 1 / 3, "hot", rng.integers(0, 9, n).astype(str))
    y = 3 * np.sin(2 * x0) + x1 * (x0 > 0) + 2.0 * (client == "hot") + rng.normal(0, 0.1, n)
    return pd.DataFrame({"campana": [f"c{i}" for i in range(n)], "cliente": client, "x0": x0, "x1": x1, "y": y})


@pytest.mark.parametrize("task_cells", [0, 10_000])
def test_boost_equals_the_plain_booster(spark, task_cells):
    pdf = data(300, 1)
    bins = np.column_stack([plain_bins(pdf.x0.to_numpy()), plain_bins(pdf.x1.to_numpy())])
    rows = [(m, bins[i].tolist(), 1.0, float(pdf.y[i] * (1 + m))) for m in (0, 1) for i in range(300)]
    cells = spark.createDataFrame(rows, "model long, bins array<int>, n double, s double")
    models = boosting.boost(cells, 2, rounds=13, leaves=8, least=10, rate=0.1, task_cells=task_cells)
    for m in (0, 1):
        want = plain_boost(bins, pdf.y.to_numpy() * (1 + m), 13, 8, 10, 0.1)(bins)
        np.testing.assert_allclose(models[m].base + models[m].add_up(bins), want, rtol=1e-9)
    assert max(len(t.leaves()) for t, _ in models[0].trees) == 8
    assert all(len(t.split) == 7 for t, _ in models[0].trees)


def test_cells_stand_for_their_rows(spark):
    """Rows with equal bins count as one cell; the trees are those of the rows."""
    rng = np.random.default_rng(3)
    bins, y = rng.integers(0, 4, (400, 2)), rng.normal(0, 1, 400)
    y += bins[:, 0] * 2
    pdf = pd.DataFrame({"a": bins[:, 0], "b": bins[:, 1], "y": y}).groupby(["a", "b"]).y.agg(["size", "sum"]).reset_index()
    rows = [(0, [int(r.a), int(r.b)], float(r["size"]), float(r["sum"])) for _, r in pdf.iterrows()]
    models = boosting.boost(spark.createDataFrame(rows, "model long, bins array<int>, n double, s double"), 2, rounds=5)
    np.testing.assert_allclose(models[0].base + models[0].add_up(bins), plain_boost(bins, y, 5, 8, 10, 0.1)(bins), rtol=1e-9)


def test_cross_boosted_equals_a_fit_per_fold(spark):
    from pyspark.sql import functions as F

    pdf = data(240, 5)
    df = spark.createDataFrame(pdf).repartition(3)
    folds, rounds = 3, 6
    got = boosting.cross_boosted(df, ["x0", "x1"], ["cliente"], "y", folds, rounds, "campana", encoding_weight, "p")
    got = got.toPandas().set_index("campana").p
    fold = df.select("campana", F.pmod(F.xxhash64("campana"), F.lit(folds)).alias("f")).toPandas().set_index("campana").f[pdf.campana].to_numpy()
    for k in range(folds):
        train = pdf[fold != k]
        s = train.groupby("cliente").y.agg(["count", "mean"])
        w = 1 / (1 + np.exp(-(s["count"] - 20) / 10))
        encoded = pdf.cliente.map(w * s["mean"] + (1 - w) * train.y.mean()).fillna(train.y.mean()).to_numpy()
        bins = np.column_stack([plain_bins(pdf.x0.to_numpy()), plain_bins(pdf.x1.to_numpy()), plain_bins(encoded)])
        predict = plain_boost(bins[fold != k], train.y.to_numpy(), rounds, 8, 10, 0.1)
        np.testing.assert_allclose(got[pdf.campana[fold == k]], predict(bins[fold == k]), rtol=1e-9)


def test_jobs_for_all_folds_are_at_most_rounds_times_levels(spark, monkeypatch):
    calls = []
    old = boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda *a: calls.append(len(a[4])) or old(*a))
    boosting.cross_boosted(spark.createDataFrame(data(200, 6)), ["x0"], ["cliente"], "y", 4, 5, "campana", encoding_weight, "p", task_cells=0).count()
    assert len(calls) <= 5 * 8 and max(calls) == 4


def test_few_rows_and_constant_targets(spark):
    cells = spark.createDataFrame([(0, [1], 5.0, 10.0), (0, [2], 5.0, 30.0)], "model long, bins array<int>, n double, s double")
    models = boosting.boost(cells, 1, rounds=3)
    assert models[0].trees == [] and models[0].base == 4.0
    flat = spark.createDataFrame([(0, [b], 20.0, 40.0) for b in range(4)], "model long, bins array<int>, n double, s double")
    assert boosting.boost(flat, 1, rounds=3)[0].trees == []
    assert boosting.boost(cells.limit(0), 1) == {}
    one = spark.createDataFrame(data(1, 1))
    assert [r.p for r in boosting.cross_boosted(one, ["x0"], ["cliente"], "y", 2, 2, "campana", encoding_weight, "p").collect()] == [None]


def test_best_split_of_ties_is_the_first():
    counts, gradients = np.zeros((2, 255)), np.zeros((2, 255))
    for f in range(2):
        counts[f, [3, 9]], gradients[f, [3, 9]] = 12, [5.0, -5.0]
    assert boosting.best_split(counts, gradients, 10)[1:] == (0, 3)
    assert boosting.best_split(counts, gradients, 13) is None


@pytest.mark.parametrize("n", [1, 255, 256, 1000])
def test_bins(spark, n):
    values = np.random.default_rng(n).integers(0, max(1, n // 2), n).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    got = {r._v: r.bin for r in boosting.binned(df, [], "x").collect()}
    assert got.pop(None) == 0 and got == dict(zip(values, plain_bins(values)))
