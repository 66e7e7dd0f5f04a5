import numpy as np
import pandas as pd
import pytest

from flowmetrics.operators import adjust
from flowmetrics.session import checkpoint_dir

SCHEMA = "campana string, cliente string, tipo_estacion string, x0 double, x1 double, y double"


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(1)
    n = 90
    client = np.where(rng.random(n) < 1 / 3, "hot", rng.integers(0, 6, n).astype(str))
    client[0] = "única"
    station = rng.choice(["Azul", "Rojo", "Verde"], n)
    x0, x1 = rng.normal(100, 5, n), rng.integers(1, 4, n).astype(float)
    y = 300 + 2 * x0 + 9 * x1 + 30 * (client == "hot") + rng.normal(0, 4, n)
    return pd.DataFrame({"campana": [f"c{i}" for i in range(n)], "cliente": client, "tipo_estacion": station, "x0": x0, "x1": x1, "y": y})


@pytest.fixture(scope="module")
def frame(spark, pdf):
    return spark.createDataFrame([tuple(r) for r in pdf.astype(object).itertuples(index=False)], SCHEMA).repartition(3)


def encode(train, rows, col):
    s = train.groupby(col).y.agg(["count", "mean"])
    w = 1 / (1 + np.exp(-(s["count"] - 20) / 10))
    return rows[col].map(w * s["mean"] + (1 - w) * train.y.mean()).fillna(train.y.mean())


def refit(pdf, num, cat, alpha=1.0):
    """Leave-one-out by fitting a new model for every row."""
    out = []
    for i in range(len(pdf)):
        train, test = pdf.drop(index=i), pdf.iloc[[i]]
        mean, std = train[num].mean(), train[num].std(ddof=0).replace(0, 1)
        shape = lambda rows: np.column_stack([*((rows[c] - mean[c]) / std[c] for c in num), *(encode(train, rows, c) for c in cat)]).astype(float)
        a, b = shape(train), shape(test)
        centre = a.mean(0)
        w = np.linalg.solve((a - centre).T @ (a - centre) + alpha * np.eye(a.shape[1]), (a - centre).T @ (train.y - train.y.mean()))
        out.append(train.y.mean() + float(((b - centre) @ w)[0]))
    return out


@pytest.mark.parametrize("cat", [["cliente"], ["cliente", "tipo_estacion"]])
def test_ridge_leave_one_out_equals_refits(frame, pdf, cat):
    got = adjust.ridge_leave_one_out(frame, ["x0", "x1"], cat, "y").toPandas().set_index("campana").y_pred
    want = pd.Series(refit(pdf, ["x0", "x1"], cat), index=pdf.campana)
    np.testing.assert_allclose(got[want.index], want, rtol=1e-10)


@pytest.mark.parametrize("n, odd", [(40, 20.0), (30, 0.1), (12, 0.1)])
def test_ridge_fold_in_which_an_input_has_one_value(spark, n, odd):
    """Without the one row that differs an input is constant: it tells nothing there, whatever rounding leaves of its variance."""
    rng = np.random.default_rng(1)
    table = pd.DataFrame({"campana": [f"c{i}" for i in range(n)], "cliente": rng.choice(["a", "b"], n), "x0": rng.normal(8, 1, n), "k": 23.0, "y": rng.normal(100, 10, n)})
    table.loc[0, "k"] = odd
    rows = spark.createDataFrame([tuple(r) for r in table.astype(object).itertuples(index=False)], "campana string, cliente string, x0 double, k double, y double").coalesce(1)
    got = adjust.ridge_leave_one_out(rows, ["x0", "k"], ["cliente"], "y").toPandas().set_index("campana").y_pred
    np.testing.assert_allclose(got[table.campana], refit(table, ["x0", "k"], ["cliente"]), rtol=1e-9)


def test_ridge_on_very_few_rows(spark, frame):
    assert adjust.ridge_leave_one_out(frame.where("campana = 'c5'"), ["x0"], ["cliente"], "y").first().y_pred is None
    assert adjust.ridge_leave_one_out(frame.where("campana in ('c5', 'c6')"), ["x0"], ["cliente"], "y").count() == 2
    assert adjust.ridge_leave_one_out(frame.where("false"), ["x0"], ["cliente"], "y").count() == 0
    constant = adjust.ridge_leave_one_out(frame.selectExpr("*", "1.0D as k"), ["k"], ["cliente"], "y").toPandas()
    assert constant.y_pred.notna().all()


def test_feature_frame(frame, pdf):
    got = adjust.feature_frame(frame, frame, ["x0"], ["cliente"], "y").toPandas().set_index("campana").loc[pdf.campana]
    np.testing.assert_allclose(got.num_0, (pdf.x0 - pdf.x0.mean()) / pdf.x0.std(ddof=0))
    np.testing.assert_allclose(got.cat_0, encode(pdf, pdf, "cliente"))


def test_feature_frame_imputes_and_handles_unseen(spark, frame, pdf):
    rows = spark.createDataFrame([("n", "nuevo", "Azul", None, 1.0, 1.0)], SCHEMA)
    got = adjust.feature_frame(frame, rows, ["x0"], ["cliente"], "y").first()
    assert got.num_0 == pytest.approx((pdf.x0.median() - pdf.x0.mean()) / pdf.x0.std(ddof=0))
    assert got.cat_0 == pytest.approx(pdf.y.mean())


def test_cross_evaluate_covers_every_row_once(frame, pdf):
    best, table = adjust.cross_evaluate(frame, ["x0", "x1"], ["cliente"], "y", folds=2, rounds=3)
    assert sorted(r.campana for r in best.collect()) == sorted(pdf.campana)
    rows = {r.modelo: r for r in table.collect()}
    assert set(rows) == set(adjust.MODELS) and sum(r.ganador for r in rows.values()) == 1
    assert rows["Ridge"].features_usados == "x0, x1, cliente"
    assert rows["Ridge"].cv_scheme == "leave-one-out" and rows["RandomForest"].cv_scheme == "2-fold"
    pred = np.array(refit(pdf, ["x0", "x1"], ["cliente"]))
    assert rows["Ridge"].r2 == pytest.approx(1 - ((pdf.y - pred) ** 2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum(), abs=0.0006)
    assert rows["Ridge"].mae == pytest.approx(np.abs(pdf.y - pred).mean(), abs=0.0006)


def test_one_campaign_keeps_its_rows_without_a_prediction(frame):
    one = frame.where("campana = 'c1'")
    for name in ("RandomForest", "GradientBoosting"):
        got = adjust.tree_cross_predict(one, name, ["x0"], ["cliente"], "y", folds=2, rounds=2).collect()
        assert len(got) == one.count() and all(r.y_pred is None for r in got)


def test_adjusted_scores(spark, frame):
    complexity = frame.selectExpr("campana", "x0 as entropia_sku", "x1 as skus_por_caja_mediana", "x1 as n_categorias_distintas")
    summary = frame.selectExpr("campana", "cliente", "y as mediana_seg_pick", "0.5D as z_score")
    scored, _ = adjust.adjusted_zscore_campaign(complexity, summary, models=("Ridge",))
    got = scored.toPandas()
    for _, part in got.groupby("cliente"):
        if len(part) > 1:
            want = (part.residuo - part.residuo.median()) / part.residuo.std()
            np.testing.assert_allclose(part.z_score_ajustado.astype(float), want.astype(float))
        else:
            assert part.z_score_ajustado.isna().all()
    known = got[got.z_score_ajustado.notna()]
    np.testing.assert_allclose(known.delta_z.astype(float), known.z_score_ajustado.astype(float) - 0.5, atol=0.00051)


def test_adjusted_station_scores_and_coverage(frame):
    features = frame.selectExpr("campana", "tipo_estacion", "x0 as n_categorias_mediana", "x1 as n_filas_mediana").where("campana <> 'c1'")
    reference = frame.selectExpr("campana", "cliente", "if(campana = 'c2', 'Calidad', tipo_estacion) as tipo_estacion", "if(campana = 'c3', null, y) as mediana_tpp")
    scored, table = adjust.adjusted_zscore_station(features, reference, models=("Ridge",))
    assert scored.count() == 87 and "z_score_ajustado_dificultad" in scored.columns and "_cuartil" not in scored.columns
    steps = {r.paso: r.filas for r in adjust.join_coverage(features, reference).collect()}
    assert steps == {"universo": 89, "tras_join": 88, "tras_dropna": 87}
    assert [r.campana for r in adjust.lost_rows(features, reference).collect()] == ["c1"]


def test_checkpoint_folder_of_the_cluster_is_used(spark):
    assert spark.sparkContext.getCheckpointDir() is not None and checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_encoder_is_saved_loaded_and_applied_to_unseen_rows(spark, frame, pdf, tmp_path):
    from flowmetrics.operators.features import FeatureEncoder, FeatureEncoderModel

    encoder = FeatureEncoder(numCols=["x0"], catCols=["cliente", "tipo_estacion"], target="y")
    encoder.save(f"file://{tmp_path}/encoder")
    again = FeatureEncoder.load(f"file://{tmp_path}/encoder")
    assert again.names() == (["x0"], ["cliente", "tipo_estacion"])
    again.fit(frame).save(f"file://{tmp_path}/model")
    other = spark.newSession()
    model = FeatureEncoderModel.load(f"file://{tmp_path}/model")
    got = model.transform(frame).toPandas().set_index("campana").loc[pdf.campana]
    np.testing.assert_allclose(got.num_0, (pdf.x0 - pdf.x0.mean()) / pdf.x0.std(ddof=0))
    np.testing.assert_allclose(got.cat_0, encode(pdf, pdf, "cliente"))
    np.testing.assert_allclose(got.cat_1, encode(pdf, pdf, "tipo_estacion"))
    new = other.createDataFrame([("n", None, "Azul", None, 1.0, 1.0), ("m", "nuevo", None, 100.0, 1.0, 1.0)], SCHEMA)
    for r in model.transform(new).collect():
        assert r.cat_0 == pytest.approx(pdf.y.mean()) and r.num_0 is not None


def test_encoder_without_training_rows(frame, tmp_path):
    from flowmetrics.operators.features import FeatureEncoder, FeatureEncoderModel

    FeatureEncoder(numCols=["x0"], catCols=["cliente"], target="y").fit(frame.where("false")).save(f"file://{tmp_path}/none")
    got = FeatureEncoderModel.load(f"file://{tmp_path}/none").transform(frame).first()
    assert got.num_0 is None and got.cat_0 is None
