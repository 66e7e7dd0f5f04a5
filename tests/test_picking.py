import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowmetrics.operators import deadtime, difficulty, picking
from flowmetrics.plans.picking_times import picking_tables
from flowmetrics.schemas import STATION_ORDER

EVENTS = "event_id bigint, type string, box_id string, estacion string, campana string, id_campana string, time timestamp_ntz, scan string, cliente_db string"


def at(minutes, day=1):
    return dt.datetime(2026, 6, day) + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, "box_open", "b1", "Estacion 1", "FDA JUN26", "7", at(5), None, "fda"),
        (2, "box_open", "b1", "Estacion 1", "FDA JUN26", "7", at(3), None, "fda"),
        (3, "scan", "b1", "Estacion 1", "FDA JUN26", "7", at(6), "x", "fda"),
        (4, "otro", "b1", "Estacion 1", "FDA JUN26", "7", at(6), "x", "fda"),
        (5, "scan", "b1", "Estacion 1", "FDA JUN26", "7", at(7), None, "fda"),
        (6, "box_close", "b1", "Estacion 1", "FDA JUN26", "7", at(9), None, "fda"),
        (7, "box_close", "b1", "Estacion 1", "FDA JUN26", "7", at(8), None, "fda"),
        (8, "box_open", "b2", "Estacion E1", "FDA JUN26", "7", at(1), None, "aaa"),
        (9, "box_close", "b2", "Estacion E1", "FDA JUN26", "7", at(2), None, "fda"),
        (10, "box_open", "b3", "Calidad", "DQ X", "8", at(1), None, None),
        (11, "box_open", "b4", "rara", "DQ X", "8", at(1), None, "dq"),
        (12, "box_close", "b4", "rara", "DQ X", "8", at(4), None, "dq"),
        (13, "box_open", None, "rara", "DQ X", "8", at(1), None, "dq"),
        (14, "box_close", None, "rara", "DQ X", "8", at(4), None, "dq"),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_build_operations(events):
    got = {r.box_id: r for r in picking.build_operations(events).collect()}
    assert set(got) == {"b1", "b2", "b4"}  # pairs only, no NULL keys
    b1 = got["b1"]
    assert (b1.init_scan, b1.last_scan, b1.picks, b1.tipo_estacion) == (at(3), at(9), 2, "Azul")
    assert b1.cliente == "aaa"  # two clients recorded for the campaign: the first in order, and reported
    assert got["b2"].tipo_estacion == "Naranja" and got["b4"].tipo_estacion == "Otro"
    assert {(r.campana, r.clientes_distintos) for r in picking.client_map(events).collect()} == {("FDA JUN26", 2), ("DQ X", 1)}
    plain = picking.build_operations(events.drop("cliente_db"))
    assert {r.cliente for r in plain.collect()} == {"FDA", "DQ"}
    before = picking.build_operations(events, extra_from="2026-07-01")
    assert {r.tipo_estacion for r in before.where("box_id = 'b2'").collect()} == {"Otro"}


def test_unmapped_stations(events):
    assert [tuple(r) for r in picking.unmapped_stations(picking.pair_operations(events)).collect()] == [("rara", 1)]


def test_operations_use_one_shuffle(events):
    plan = picking.build_operations(events.drop("cliente_db"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_exclude_campaigns_keeps_missing_names(spark):
    ops = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "campana string, picks int")
    excluded = spark.createDataFrame([("a",), ("a",)], "campana string")
    assert {r.picks for r in picking.exclude_campaigns(ops, excluded).collect()} == {2, 3}


def test_cast_ids_is_case_sensitive(spark):
    df = picking.cast_ids(spark.createDataFrame([(1, 2, 3, 4)], "id int, box_id int, ID2 int, valid int"))
    assert [t for _, t in df.dtypes] == ["string", "string", "int", "int"]


def test_metrics_without_division_errors(spark):
    ops = spark.createDataFrame([("X A", 0, 10.0, 0.0), ("X A", 2, 10.0, 0.5)], "campana string, picks int, tiempo_total_seg double, tiempo_total_min double")
    got = picking.efficiency_metrics(ops).collect()
    assert (got[0].tiempo_por_pick, got[0].picks_por_min, got[0].cliente) == (None, None, "X")
    assert (got[1].tiempo_por_pick, got[1].picks_por_min) == (5.0, 4.0)


def test_campaign_station_median_keeps_missing_keys(spark):
    ops = spark.createDataFrame([("a", None, 1.0), ("a", None, 3.0), ("a", "z", None)], "campana string, cliente string, m double")
    got = {r.cliente: r.mediana_tpp for r in picking.campaign_station_median(ops, ["campana", "cliente"], "m").collect()}
    assert got == {None: 2.0, "z": None}


@pytest.fixture(scope="module")
def ops_pandas():
    rng = np.random.default_rng(2)
    names = [*STATION_ORDER, "Otro"]
    rows = []
    for i in range(2500):
        box = "hot" if rng.random() < 1 / 3 else f"b{rng.integers(0, 150)}"
        start = dt.datetime(2025, 12, 20) + dt.timedelta(seconds=int(rng.integers(0, 30 * 86400)))
        campaign = f"C{rng.integers(0, 3)}"
        rows.append((box, campaign, campaign[:1], names[rng.integers(0, 9)], start, start + dt.timedelta(seconds=int(rng.integers(1, 4000))), int(rng.integers(0, 9))))
    return pd.DataFrame(rows, columns=["box_id", "campana", "cliente", "tipo_estacion", "init_scan", "last_scan", "picks"])


@pytest.fixture(scope="module")
def ops(spark, ops_pandas):
    schema = "box_id string, campana string, cliente string, tipo_estacion string, init_scan timestamp_ntz, last_scan timestamp_ntz, picks int"
    rows = [tuple(r) for r in ops_pandas.astype(object).itertuples(index=False)]
    rows = [(*r[:4], r[4].to_pydatetime(), r[5].to_pydatetime(), int(r[6])) for r in rows]
    return picking.base_operations(spark.createDataFrame(rows, schema).repartition(4)).persist()


def expected_gaps(pdf):
    df = pdf.sort_values(["campana", "box_id", "init_scan", "last_scan", "tipo_estacion"]).reset_index(drop=True)
    before = df.groupby(["campana", "box_id"])
    df["origen"], left = before.tipo_estacion.shift(), before.last_scan.shift()
    df["gap"] = (df.init_scan - left).dt.total_seconds()
    df["back"] = df.origen.map(STATION_ORDER) > df.tipo_estacion.map(STATION_ORDER)
    base = df.gap.where((df.gap >= 0) & ~df.back)
    lo = df.tipo_estacion.map(base.groupby(df.tipo_estacion).quantile(0.05))
    hi = df.tipo_estacion.map(base.groupby(df.tipo_estacion).quantile(0.90))
    df["muerto"] = base.where(base.between(lo, hi))
    return df


@pytest.mark.parametrize("hot_rows", [10**6, 50])
def test_dead_time_equals_pandas(ops, ops_pandas, hot_rows):
    want = expected_gaps(ops_pandas)
    got = deadtime.annotate_gaps(ops, hot_rows=hot_rows).toPandas()
    assert len(got) == len(ops_pandas)  # no row lost or added
    key = ["campana", "box_id", "init_scan", "last_scan", "tipo_estacion"]
    got["init_scan"], got["last_scan"] = (pd.to_datetime(got[c]).astype("datetime64[us]") for c in ("init_scan", "last_scan"))
    got = got.sort_values(key).reset_index(drop=True)
    assert got.tipo_estacion_origen.fillna("-").tolist() == want.origen.fillna("-").tolist()
    np.testing.assert_allclose(got.tiempo_muerto_seg.to_numpy(float), want.muerto.to_numpy(float))
    moved = got.gap_seg.notna().sum()
    assert moved == got.tiempo_muerto_seg.notna().sum() + got.motivo.notna().sum()
    negative = want.gap < 0
    assert (got.motivo[negative] == "negativo").all()
    assert (got.motivo[want.back & ~negative & want.gap.notna()] == "retroceso_flujo").all()


def test_transitions_and_destinations(ops):
    gaps = deadtime.annotate_gaps(ops)
    clean, outliers = deadtime.dead_time(ops)
    one, two = deadtime.transition_summary(gaps).toPandas(), deadtime.transition_summary(clean, outliers).toPandas()
    key = ["campana", "cliente", "año", "tipo_estacion_origen", "tipo_estacion"]
    one, two = (t.sort_values(key).reset_index(drop=True) for t in (one, two))
    pd.testing.assert_frame_equal(one, two)
    # the campaigns span two years and the rejected count carries no year: it is repeated
    both = one[one.duplicated(["campana", *key[3:]], keep=False)]
    rejected = (both.n_transiciones_total - both.n_transiciones_validas).groupby([both.campana, both.tipo_estacion_origen, both.tipo_estacion])
    assert len(both) and (rejected.nunique() == 1).all()
    # the mean by destination is the mean of the accepted gaps
    by_destination = deadtime.dead_time_by_destination(deadtime.transition_summary(gaps)).toPandas()
    raw = gaps.where("tiempo_muerto_seg is not null").toPandas().groupby(["campana", "año", "tipo_estacion"]).tiempo_muerto_seg.mean()
    found = by_destination[by_destination.n_transiciones_validas > 0].set_index(["campana", "año", "tipo_estacion"]).promedio_tiempo_muerto_seg
    pd.testing.assert_series_equal(found.sort_index(), raw.sort_index(), check_names=False, check_index_type=False)
    assert (by_destination[by_destination.n_transiciones_validas == 0].promedio_tiempo_muerto_seg == 0).all()


def test_delta_to_the_campaign_before(spark):
    rows = [("c2", "K", "A", "B", at(0, 2), 30.0, 31.0, 5), ("c1", "K", "A", "B", at(0, 1), 0.0, 1.0, 4), ("c3", "K", "A", "B", at(0, 3), 45.0, 31.0, 5),
            ("d1", "L", "A", "B", at(0, 1), 9.0, 9.0, 1)]
    schema = ("campana string, cliente string, tipo_estacion_origen string, tipo_estacion string, fecha_inicio timestamp_ntz, "
              "mediana_tiempo_muerto_seg double, promedio_tiempo_muerto_seg double, n_transiciones_validas bigint")
    got = {r.campana: r for r in deadtime.dead_time_delta(spark.createDataFrame(rows, schema)).collect()}
    assert got["c1"].campana_anterior is None and got["d1"].delta_tiempo_muerto_seg is None
    assert (got["c2"].campana_anterior, got["c2"].delta_tiempo_muerto_seg, got["c2"].delta_tiempo_muerto_pct) == ("c1", 30.0, None)
    assert (got["c3"].delta_tiempo_muerto_pct, got["c3"].mediana_tiempo_muerto_min, got["c3"].n_transiciones_validas_anterior) == (50.0, 0.75, 5)


def test_campaign_summary(ops, ops_pandas):
    clean = picking.efficiency_metrics(picking.positive_picks(ops))
    got = picking.campaign_summary(clean).toPandas().set_index("campana")
    pdf = ops_pandas[ops_pandas.picks > 0]
    seconds = (pdf.last_scan - pdf.init_scan).dt.total_seconds()
    pace = pdf.picks / (seconds / 60)
    for c, part in pdf.groupby("campana"):
        r = got.loc[c]
        assert (r.picks_total, r.ops_total, r.picks_max_op) == (part.picks.sum(), len(part), part.picks.max())
        assert r.picks_por_min_mediana == pytest.approx(pace[part.index].median())
        assert r.hora_inicio_mediana == part.init_scan.dt.hour.median()
        assert r.pct_estacion_morado == pytest.approx((part.tipo_estacion == "Morado").mean())
        assert r.dias_habiles == max(1, np.busday_count(part.init_scan.min().date(), part.last_scan.max().date()))
        assert r["año"] == part.sort_values("init_scan").init_scan.iloc[0].year


def test_genuine_time_per_pick(spark):
    t = lambda m: at(m)
    base = spark.createDataFrame(
        [("b", "c", "Azul", t(0), 3), ("b", "c", "Rojo", t(5), 4), ("b", "c", "Pre-Calidad", t(6), 1), ("b", "c", "Verde", t(7), 5), ("b", "c", "Calidad", t(9), 1),
         ("b", "c", "Azul", t(10), 50), ("z", "c", "Azul", t(0), 0), ("z", "c", "Calidad", t(1), 1), ("y", "c", "Calidad", t(1), 1), ("y", "c", "Azul", t(2), 7)],
        "box_id string, campana string, tipo_estacion string, init_scan timestamp_ntz, picks int")
    clean = base.withColumn("tiempo_total_seg", F.lit(70.0))
    got = {(r.box_id, r.tipo_estacion): (r.tpp_genuino, r.denom_tramo) for r in difficulty.genuine_time_per_pick(base, clean).collect()}
    assert got == {("b", "Pre-Calidad"): (10.0, 7), ("b", "Calidad"): (14.0, 5), ("z", "Calidad"): (None, None), ("y", "Calidad"): (None, None)}


def test_whole_flow(events):
    tables = picking_tables(events, events.sparkSession.createDataFrame([("DQ X",)], "campana string"))
    assert {r.box_id for r in tables.clean.collect()} == {"b1"}
    assert tables.campaigns.count() == 1 and tables.station_scores.first().categoria == "sin_referencia"
    assert tables.transitions.count() == tables.outliers.count() == tables.destinations.count() == 0


# ------------------------------------------------------------------ difficulty

SCANS = "type string, campana string, box_id string, row string, consecutivo bigint, sku string, time timestamp_ntz"


@pytest.mark.parametrize("hot_rows", [10**6, 10])
def test_row_changes_equal_pandas(spark, hot_rows):
    rng = np.random.default_rng(9)
    rows, n = [], 1500
    for i in range(n):
        box = "hot" if rng.random() < 1 / 3 else f"b{rng.integers(0, 60)}"
        rows.append(("scan", "c", box, None if rng.random() < 0.1 else str(rng.integers(0, 3)), i * 40, "s", at(i)))
    df = spark.createDataFrame(rows, SCANS).repartition(4)
    got = {r.box_id: r.n for r in difficulty.row_changes(df, hot_rows).groupBy("box_id").agg(F.sum("_change").alias("n")).collect()}
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in SCANS.split(", ")])
    want = {b: int((p.row != p.row.shift()).sum() - 1) for b, p in pdf.sort_values("consecutivo").groupby("box_id")}
    assert got == want


def test_box_difficulty_optional_columns(spark):
    rows = [("scan", "c", "b", None, 1, "s", at(0)), ("pick_ok", "c", "b", None, 2, "t", at(1)), ("otro", "c", "b", None, 3, "u", at(2)), ("scan", "c", None, None, 3, "u", at(2))]
    full = spark.createDataFrame(rows, SCANS)
    got = difficulty.box_difficulty(full.drop("row")).collect()
    assert [tuple(r) for r in got] == [("c", "b", 2, 0, 1, 0)]  # without rows every further pick counts as a change
    assert difficulty.box_difficulty(full.drop("box_id")).count() == 0
    assert difficulty.campaign_complexity(full.drop("type")).columns[0] == "campana"
    no_box = difficulty.campaign_complexity(full.drop("box_id")).first()
    assert (no_box.n_skus_distintos, no_box.skus_por_caja_mediana) == (3, None)


def test_concentration(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] + [("b", "x")] * 4 + [("c", None)], "g string, s string")
    got = {r.g: (r.h, r.q) for r in difficulty.concentration(df, ["g"], "s", "h", "q").collect()}
    assert got["a"] == (pytest.approx(-(0.75 * np.log2(0.75) + 0.25 * np.log2(0.25))), 0.625)
    assert got["b"] == (0.0, 1.0) and "c" not in got


def test_difficulty_correlation_equals_ranks(spark):
    rng = np.random.default_rng(4)
    n = 300
    rows, feats = [], []
    for i in range(n):
        campaign, k = f"C{i % 2}", int(rng.integers(1, 6))
        seconds = float(rng.integers(1, 40)) * k
        rows += [("box_open", f"b{i}", campaign, at(0), f"cli{i % 2}"), ("scan", f"b{i}", campaign, at(0), f"cli{i % 2}"),
                 ("box_close", f"b{i}", campaign, at(0) + dt.timedelta(seconds=seconds), f"cli{i % 2}")]
        feats.append((campaign, f"b{i}", k, seconds))
    events = spark.createDataFrame(rows, "type string, box_id string, campana string, time timestamp_ntz, cliente_db string")
    boxes = spark.createDataFrame([f[:3] for f in feats], "campana string, box_id string, n_skus_en_caja int")
    got = {r.scope: r for r in difficulty.difficulty_correlation(boxes, events, tpp_max=100).collect()}
    pdf = pd.DataFrame(feats, columns=["campana", "box", "k", "s"]).query("s <= 100")
    for scope, part in (("global", pdf), ("cli0", pdf[pdf.campana == "C0"]), ("cli1", pdf[pdf.campana == "C1"])):
        assert got[scope].r == pytest.approx(part.k.rank().corr(part.s.rank()), abs=0.00051)
        assert got[scope].n == len(part)
    assert got["global"].sig == "***" and set(got) == {"global", "cli0", "cli1"}
    assert difficulty.difficulty_correlation(boxes.limit(9), events).count() == 0  # fewer than 10 pairs


@pytest.mark.parametrize("name", ["a24_efficiency_text", "a24_efficiency_summary"])
def test_efficiency_joins_the_raw_tables_once(spark, name):
    """The summary reads its rows twice; they are settled, so neither reading joins lines, orders and customers again."""
    import __spark_entry__ as E

    files = E.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "lineitem" in f]
