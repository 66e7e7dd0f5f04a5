"""Scores adjusted for difficulty: a model predicts the time, and the residual is scored.

Target encoding of a category with n rows and target mean m: ``w*m + (1-w)*prior`` with
``w = 1/(1+exp(-(n-20)/10))`` and the mean of all training rows as prior; an unseen category gets the prior.

Ridge is evaluated by exact leave-one-out. Means, scales, encodings and the Gram matrix of a fold that
leaves out row i are the sums over all rows, corrected for row i and for its own categories, so each row
needs only its categories' sums (a join) and one small linear system. The tree models are evaluated by
k folds over a hash of the campaign.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmetrics.operators.boosting import cross_boosted
from flowmetrics.operators.features import ENCODING_LEAF, ENCODING_SMOOTHING, FeatureEncoder, encoding_weight
from flowmetrics.operators.picking import line_stations_only
from flowmetrics.operators.stats import complete_cases, rank_quartile, residual_zscore
from flowmetrics.schemas import quoted
from flowmetrics.session import settle

CAMPAIGN_FEATURES = ("entropia_sku", "skus_por_caja_mediana", "n_categorias_distintas")
CAMPAIGN_CATEGORIES = ("cliente",)
STATION_FEATURES = ("n_categorias_mediana", "n_filas_mediana")
STATION_CATEGORIES = ("cliente", "tipo_estacion")
MODELS = ("Ridge", "RandomForest", "GradientBoosting")
PREDICTION = "y_pred"


def feature_frame(
    train: DataFrame, rows: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], target: str
) -> DataFrame:
    """Add model inputs to ``rows``, fitted on ``train`` by :class:`FeatureEncoder`."""
    return FeatureEncoder(numCols=num_cols, catCols=cat_cols, target=target).fit(train).transform(rows)


# ---------------------------------------------------------------- ridge, exact leave-one-out

def _category_sums(rows: DataFrame, cat: str, q: int, d: int) -> DataFrame:
    """Per category: rows, target sum, feature sums, and the two parts of its encoding a + b*prior."""
    sums = rows.groupBy(quoted(cat).alias(f"key{q}")).agg(
        F.count("*").cast("double").alias(f"n{q}"),
        F.sum("_y").alias(f"S{q}"),
        *[F.sum(f"_x{j}").alias(f"X{q}_{j}") for j in range(d)],
    )
    w = encoding_weight(F.col(f"n{q}"))
    return sums.withColumns({f"a{q}": w * F.col(f"S{q}") / F.col(f"n{q}"), f"b{q}": 1 - w})


def ridge_leave_one_out(
    df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], target: str, alpha: float = 1.0
) -> DataFrame:
    """Add ``y_pred``: the prediction for each row of the ridge model fitted on all other rows.

    Inputs are ``num_cols`` standardised and one or two ``cat_cols`` target encoded, both per fold, with a
    free intercept. Rows must have no missing input.
    """
    d, q = len(num_cols), len(cat_cols)
    # centring first keeps the sums of squares accurate
    ends = [f(quoted(c).cast("double")).alias(f"{name}{j}") for j, c in enumerate(num_cols) for name, f in (("lo", F.min), ("hi", F.max))]
    centre = df.agg(F.avg(target).alias("y"), *[F.avg(quoted(c)).alias(f"x{j}") for j, c in enumerate(num_cols)], *ends).first()
    if centre["y"] is None:
        return df.withColumn(PREDICTION, F.lit(None).cast("double"))
    rows = df.withColumns({
        "_y": quoted(target).cast("double") - F.lit(centre["y"]),
        **{f"_x{j}": quoted(c).cast("double") - F.lit(centre[f"x{j}"]) for j, c in enumerate(num_cols)},
    })
    cats = [_category_sums(rows, c, k, d) for k, c in enumerate(cat_cols)]

    x = [F.col(f"_x{j}") for j in range(d)]
    moments = rows.agg(
        F.count("*").cast("double").alias("n"),
        F.sum("_y").alias("y"),
        *[F.sum(x[j]).alias(f"x{j}") for j in range(d)],
        *[F.sum(x[j] * F.col("_y")).alias(f"xy{j}") for j in range(d)],
        *[F.sum(x[i] * x[j]).alias(f"xx{i}_{j}") for i in range(d) for j in range(i, d)],
        *[F.sum((x[j] == centre[f"{end}{j}"] - centre[f"x{j}"]).cast("double")).alias(f"n_{end}{j}") for j in range(d) for end in ("lo", "hi")],
    ).first().asDict()
    for k, table in enumerate(cats):
        n, s, a, b = (F.col(f"{name}{k}") for name in ("n", "S", "a", "b"))
        moments |= table.agg(
            F.sum(n * a).alias(f"A{k}"), F.sum(n * b).alias(f"B{k}"),
            F.sum(s * a).alias(f"Ay{k}"), F.sum(s * b).alias(f"By{k}"),
            F.sum(n * a * a).alias(f"AA{k}"), F.sum(n * a * b).alias(f"AB{k}"), F.sum(n * b * b).alias(f"BB{k}"),
            *[F.sum(F.col(f"X{k}_{j}") * a).alias(f"Ax{k}_{j}") for j in range(d)],
            *[F.sum(F.col(f"X{k}_{j}") * b).alias(f"Bx{k}_{j}") for j in range(d)],
        ).first().asDict()
    if q == 2:
        pairs = rows.groupBy(quoted(cat_cols[0]).alias("key0"), quoted(cat_cols[1]).alias("key1")).agg(
            F.count("*").cast("double").alias("n01")
        )
        known = pairs.join(cats[0].select("key0", "a0", "b0"), "key0").join(cats[1].select("key1", "a1", "b1"), "key1")
        n = F.col("n01")
        moments |= known.agg(
            F.sum(n * F.col("a0") * F.col("a1")).alias("P0"),
            F.sum(n * (F.col("a0") * F.col("b1") + F.col("b0") * F.col("a1"))).alias("P1"),
            F.sum(n * F.col("b0") * F.col("b1")).alias("P2"),
        ).first().asDict()
        partner0 = known.groupBy("key0").agg(F.sum(n * F.col("a1")).alias("Ta0"), F.sum(n * F.col("b1")).alias("Tb0"))
        partner1 = known.groupBy("key1").agg(F.sum(n * F.col("a0")).alias("Ta1"), F.sum(n * F.col("b0")).alias("Tb1"))
        cats = [cats[0].join(partner0, "key0"), cats[1].join(partner1, "key1")]

    joined = rows
    for k, c in enumerate(cat_cols):
        joined = joined.join(cats[k], quoted(c) == F.col(f"key{k}"))
    if q == 2:
        pairs = pairs.withColumnsRenamed({"key0": "pk0", "key1": "pk1"})
        joined = joined.join(pairs, (F.col("key0") == F.col("pk0")) & (F.col("key1") == F.col("pk1"))).drop("pk0", "pk1")

    leaf, smoothing, y_mean = ENCODING_LEAF, ENCODING_SMOOTHING, float(centre["y"])
    total = {name: float(value) for name, value in moments.items()}
    ends = [{centre[f"{end}{j}"] - centre[f"x{j}"]: total[f"n_{end}{j}"] for end in ("lo", "hi")} for j in range(d)]
    kept = list(df.columns)
    size = d + q

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            y = rows["_y"].to_numpy()
            xs = [rows[f"_x{j}"].to_numpy() for j in range(d)]
            m = total["n"] - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                prior = (total["y"] - y) / m
            # fold sums of each input f, of f*f' and of f*y
            sums, own = np.zeros((len(rows), size)), np.zeros((len(rows), size))
            gram, with_y = np.zeros((len(rows), size, size)), np.zeros((len(rows), size))
            for j in range(d):
                own[:, j] = xs[j]
                sums[:, j] = total[f"x{j}"] - xs[j]
                with_y[:, j] = total[f"xy{j}"] - xs[j] * y
                for i in range(j + 1):
                    gram[:, i, j] = gram[:, j, i] = total[f"xx{i}_{j}"] - xs[i] * xs[j]
            full, fold, partner = [], [], []
            for k in range(q):
                n, s = rows[f"n{k}"].to_numpy(), rows[f"S{k}"].to_numpy()
                e = rows[f"a{k}"].to_numpy() + rows[f"b{k}"].to_numpy() * prior
                n1, s1 = n - 1, s - y
                w = 1 / (1 + np.exp(-(n1 - leaf) / smoothing))
                e1 = np.where(n1 > 0, w * s1 / np.maximum(n1, 1) + (1 - w) * prior, prior)
                at = d + k
                own[:, at] = e1
                sums[:, at] = total[f"A{k}"] + total[f"B{k}"] * prior - n * e + n1 * e1
                with_y[:, at] = total[f"Ay{k}"] + total[f"By{k}"] * prior - s * e + s1 * e1
                gram[:, at, at] = (
                    total[f"AA{k}"] + 2 * total[f"AB{k}"] * prior + total[f"BB{k}"] * prior**2 - n * e**2 + n1 * e1**2
                )
                for j in range(d):
                    xc = rows[f"X{k}_{j}"].to_numpy()
                    cross = total[f"Ax{k}_{j}"] + total[f"Bx{k}_{j}"] * prior - xc * e + (xc - xs[j]) * e1
                    gram[:, at, j] = gram[:, j, at] = cross
                full.append(e)
                fold.append(e1)
                if q == 2:
                    partner.append(rows[f"Ta{k}"].to_numpy() + rows[f"Tb{k}"].to_numpy() * prior)
            if q == 2:
                n = rows["n01"].to_numpy()
                cross = (
                    total["P0"] + total["P1"] * prior + total["P2"] * prior**2
                    - full[0] * partner[0] - full[1] * partner[1] + n * full[0] * full[1]
                    + fold[0] * (partner[0] - n * full[1]) + fold[1] * (partner[1] - n * full[0])
                    + (n - 1) * fold[0] * fold[1]
                )
                gram[:, d, d + 1] = gram[:, d + 1, d] = cross
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = sums / m
            centred = gram - m * mean[:, :, None] * mean[:, None, :]
            target_part = with_y - m * mean * prior[:, None]
            scale = np.ones((len(rows), size))
            for j in range(d):
                # an input with one value in the fold tells nothing: its sums are rounding errors, which no scale may blow up
                if sum(ends[j].values()) >= total["n"]:
                    alone = [value for value, count in ends[j].items() if count == 1]
                    flat = np.isin(xs[j], alone) | (len(ends[j]) == 1)
                    centred[flat, j, :] = centred[flat, :, j] = target_part[flat, j] = 0
                deviation = np.sqrt(np.maximum(centred[:, j, j], 0) / max(m, 1))
                scale[:, j] = np.where(deviation > 1e-12, 1 / np.where(deviation > 1e-12, deviation, 1), 1)
            system = centred * scale[:, :, None] * scale[:, None, :] + alpha * np.eye(size)
            if m > 0:
                weights = np.linalg.solve(system, (target_part * scale)[:, :, None])[:, :, 0]
                predicted = prior + np.sum(weights * scale * (own - mean), axis=1) + y_mean
            else:
                predicted = np.full(len(rows), np.nan)
            yield rows[kept].assign(y_pred=predicted)

    schema = T.StructType([*df.schema.fields, T.StructField(PREDICTION, T.DoubleType())])
    return joined.mapInPandas(solve, schema)


# ---------------------------------------------------------------- trees, k folds

def tree_cross_predict(
    df: DataFrame,
    name: str,
    num_cols: Sequence[str],
    cat_cols: Sequence[str],
    target: str,
    folds: int = 5,
    rounds: int = 100,
    fold_key: str = "campana",
) -> DataFrame:
    """Add out-of-fold predictions of a tree model; all rows of a campaign share a fold.

    ``df`` should be a settled table: it is read several times per fold. Boosting has trees of 8 leaves with at least 10 rows
    each and fits all folds at once; forests have depth 3 and at least 5 rows, and their fits run side by side.
    """
    if name == "GradientBoosting":
        return cross_boosted(df, num_cols, cat_cols, target, folds, rounds, fold_key, encoding_weight, PREDICTION)
    inputs = [f"num_{i}" for i in range(len(num_cols))] + [f"cat_{i}" for i in range(len(cat_cols))]
    assembler = VectorAssembler(inputCols=inputs, outputCol="_features")
    folded = df.withColumn("_fold", F.pmod(F.xxhash64(fold_key), F.lit(folds)))

    def one(k: int) -> DataFrame:
        train, test = folded.where(F.col("_fold") != k), folded.where(F.col("_fold") == k)
        encoder = FeatureEncoder(numCols=num_cols, catCols=cat_cols, target=target).fit(train)
        if encoder.encodings is None:
            return test.select(*[quoted(c) for c in df.columns], F.lit(None).cast("double").alias(PREDICTION))
        # written once per fold: the fit reads it again for every round
        ready = settle(encoder.transform(train).select(*inputs, quoted(target).cast("double").alias("_label")))
        labelled = assembler.transform(ready).select("_features", "_label")
        forest = RandomForestRegressor(numTrees=rounds, maxDepth=3, minInstancesPerNode=5, seed=42, predictionCol=PREDICTION)
        model = forest.setFeaturesCol("_features").setLabelCol("_label").fit(labelled)
        return model.transform(assembler.transform(encoder.transform(test))).select(*[quoted(c) for c in df.columns], PREDICTION)

    with ThreadPoolExecutor(max_workers=folds) as pool:
        parts = list(pool.map(one, range(folds)))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- evaluation

def fit_quality(predicted: DataFrame, target: str) -> DataFrame:
    """One row: R² = 1 - SSres/SStot (NULL for a constant target) and mean absolute error, 3 decimals."""
    error = quoted(target) - F.col(PREDICTION)
    total = F.var_pop(quoted(target)) * F.count(quoted(target))
    r2 = F.when(total > 0, 1 - F.sum(error * error) / total)
    return predicted.agg(F.bround(r2, 3).alias("r2"), F.bround(F.avg(F.abs(error)), 3).alias("mae"))


def cross_evaluate(
    df: DataFrame,
    num_cols: Sequence[str],
    cat_cols: Sequence[str],
    target: str,
    models: Sequence[str] = MODELS,
    folds: int = 5,
    rounds: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions of the best model, and the table of all models.

    The table has ``modelo, r2, mae, cv_scheme, ganador, features_usados``; the winner has the highest rounded R², the
    first listed among equals.
    """
    settled = settle(df)

    def evaluate(name: str) -> tuple[DataFrame, object]:
        if name == "Ridge":
            predicted = ridge_leave_one_out(settled, num_cols, cat_cols, target)
        else:
            predicted = tree_cross_predict(settled, name, num_cols, cat_cols, target, folds, rounds)
        predicted = settle(predicted)
        return predicted, fit_quality(predicted, target).first()

    with ThreadPoolExecutor(max_workers=len(models)) as pool:
        results = dict(zip(models, pool.map(evaluate, models)))
    best = max(models, key=lambda m: (results[m][1]["r2"] is not None, results[m][1]["r2"] or 0.0))
    table = [
        (m, results[m][1]["r2"], results[m][1]["mae"], "leave-one-out" if m == "Ridge" else f"{folds}-fold", m == best, ", ".join([*num_cols, *cat_cols]))
        for m in models
    ]
    schema = "modelo string, r2 double, mae double, cv_scheme string, ganador boolean, features_usados string"
    return results[best][0], df.sparkSession.createDataFrame(table, schema)


def adjusted_zscore_campaign(
    complexity: DataFrame,
    summary: DataFrame,
    target_col: str = "mediana_seg_pick",
    features_extra: Sequence[str] = (),
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Score of each campaign's time after what its complexity and client predict, and the model table.

    ``summary`` has ``campana``, ``cliente``, the target and optionally ``z_score``, from which
    ``delta_z`` is taken. ``options`` go to :func:`cross_evaluate`.
    """
    features = [*CAMPAIGN_FEATURES, *features_extra]
    extra = ["z_score"] if "z_score" in summary.columns else []
    kept = [*features, "campana", "cliente", target_col, *extra]
    joined = complexity.join(summary.select("campana", "cliente", target_col, *extra), "campana").select(*kept)
    best, table = cross_evaluate(complete_cases(joined, kept), features, CAMPAIGN_CATEGORIES, target_col, **options)
    scored = residual_zscore(
        best.withColumn("residuo", quoted(target_col) - F.col(PREDICTION)).drop(PREDICTION),
        ["cliente"], "residuo", "z_score_ajustado",
    )
    if extra:
        scored = scored.withColumn("delta_z", F.bround(F.col("z_score_ajustado") - F.col("z_score"), 3))
    return scored, table


def lost_rows(features: DataFrame, reference: DataFrame) -> DataFrame:
    """Line-station rows of ``reference`` without features: campaign, client and station."""
    return line_stations_only(reference).join(features, ["campana", "tipo_estacion"], "left_anti").select(
        "campana", "cliente", "tipo_estacion"
    )


def join_coverage(features: DataFrame, reference: DataFrame, target_col: str = "mediana_tpp") -> DataFrame:
    """Row counts before the join with the features, after it, and after dropping incomplete rows."""
    lines = line_stations_only(reference)
    extra = ["z_score"] if "z_score" in reference.columns else []
    joined = features.join(lines, ["campana", "tipo_estacion"])
    used = [*STATION_FEATURES, *STATION_CATEGORIES, "campana", target_col, *extra]
    count = lambda step, df: df.agg(F.count("*").alias("filas")).select(F.lit(step).alias("paso"), "filas")
    return (
        count("universo", lines)
        .unionByName(count("tras_join", joined))
        .unionByName(count("tras_dropna", complete_cases(joined, used)))
    )


def adjusted_zscore_station(
    features: DataFrame, reference: DataFrame, target_col: str = "mediana_tpp", **options
) -> tuple[DataFrame, DataFrame]:
    """As :func:`adjusted_zscore_campaign`, per campaign and line station.

    ``z_score_ajustado_estn_cliente_lineas`` compares residuals within client and station,
    ``z_score_ajustado_dificultad`` within quartile of difficulty and station.
    """
    extra = ["z_score"] if "z_score" in reference.columns else []
    lines = line_stations_only(reference).select("campana", "cliente", "tipo_estacion", target_col, *extra)
    kept = [*STATION_FEATURES, *STATION_CATEGORIES, "campana", target_col, *extra]
    joined = features.join(lines, ["campana", "tipo_estacion"]).select(*kept)
    best, table = cross_evaluate(complete_cases(joined, kept), STATION_FEATURES, STATION_CATEGORIES, target_col, **options)
    scored = best.withColumn("residuo_loo", F.bround(quoted(target_col) - F.col(PREDICTION), 4)).drop(PREDICTION)
    by_client, by_difficulty = "z_score_ajustado_estn_cliente_lineas", "z_score_ajustado_dificultad"
    scored = residual_zscore(scored, ["cliente", "tipo_estacion"], "residuo_loo", by_client)
    scored = rank_quartile(scored, "n_categorias_mediana", ["campana", "cliente", "tipo_estacion"], "_cuartil")
    scored = residual_zscore(scored, ["_cuartil", "tipo_estacion"], "residuo_loo", by_difficulty).drop("_cuartil")
    if extra:
        delta = lambda c: F.bround(F.col(c) - F.col("z_score"), 3)
        scored = scored.withColumns({
            "delta_z_estn_cliente_lineas": delta(by_client), "delta_z_dificultad": delta(by_difficulty)
        })
    return scored, table
