import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from flowmetrics.functions.variants import is_json
from flowmetrics.operators import lifecycle, nested, quality
from flowmetrics.plans.campaign_lifecycle import lifecycle_tables, write_report
from flowmetrics.schemas import STRATEGIES, require_columns
from flowmetrics.sources import api, tables

RECORD = "id bigint, name string"


def strategy_rows(campaign="Navidad"):
    return [
        ("1", campaign, "E1", "2025-01-06 09:00:00", "2025-01-07 10:00:00", "2025-01-08 18:30:00", "NaT"),
        ("x", campaign, "E2", "2025-01-06 12:00:00", "2025-01-09 09:30:00", "", "2025-01-08 20:00:00"),
        ("3", None, "E3", "null", "2025-01-09 09:30:00", "", ""),
    ]


@pytest.fixture(scope="module")
def sources(spark):
    one = spark.createDataFrame(strategy_rows(), STRATEGIES)
    two = spark.createDataFrame(strategy_rows("Verano"), STRATEGIES).withColumn("arte", F.lit("a")).withColumn("extra", F.lit(1))
    return {"dq_2025": one, "fab_2026": two, "fda_2026": one.where("false")}


def test_lifecycle(sources):
    got = lifecycle_tables(sources)
    status = {r.fuente: (r.n_registros, r.estado) for r in got.status.collect()}
    assert status == {"dq_2025": (3, "OK"), "fab_2026": (3, "OK"), "fda_2026": (0, "ERROR")}
    assert "arte" not in got.strategies.columns and got.strategies.columns[:4] == ["Campaña", "Cliente", "Estrategia", "Folio"]
    assert {(r.Cliente, r["Año"], r.Folio) for r in got.strategies.collect()} == {
        (c, y, f) for c, y in (("DQ", 2025), ("FAB", 2026)) for f in (1, None, 3)
    }
    camp = {(r.Cliente, r["Campaña"]): r for r in got.campaigns.collect()}
    assert (("DQ", None) in camp) and camp[("DQ", None)].total_estrategias == 1  # missing campaign is a group
    nav = camp[("DQ", "Navidad")]
    assert nav.max_fecha_aprobacion == dt.datetime(2025, 1, 8, 20) and nav.duracion_carga_arte == 3.0
    assert nav.duracion_etapa_tres_td < 0 <= nav.duracion_etapa_tres
    assert nav.porcentaje_duracion_etapa_uno + nav.porcentaje_duracion_etapa_dos + nav.porcentaje_duracion_etapa_tres == pytest.approx(100)
    assert camp[("DQ", None)].porcentaje_duracion_carga_arte is None  # total of 0
    clients = {r.Cliente: r for r in got.clients.collect()}
    assert clients["DQ"].total_campanas == 2 and clients["DQ"].total_estrategias == 3


def test_report_is_written_newest_first(spark, sources, tmp_path):
    rows = lifecycle_tables(sources)
    write_report(rows, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r" / "campanas"))
    assert set(back.columns) >= {"hoja", "Campaña", "Total Etapa 1", "marca", "orden_fecha"} and "Año" not in back.columns
    assert {r.hoja for r in back.select("hoja").distinct().collect()} == {"DQ", "FAB"}
    dq = back.where("hoja = 'DQ' and `Campaña` = 'Navidad'").first()
    assert (dq["Total de carga de artes"], dq.marca) == ("03:00", "negativo")
    assert spark.read.parquet(str(tmp_path / "r" / "clientes")).count() == 2
    write_report(rows, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c" / "campanas"), header=True).count() == back.count()


def test_clean_with_one_or_no_approval(spark):
    df = spark.createDataFrame(strategy_rows(), STRATEGIES)
    one = lifecycle.clean_strategies(df.drop("fecha_aprobado_ODT")).where("Folio = 1").first()
    assert one.fecha_aprobacion == dt.datetime(2025, 1, 8, 18, 30)
    assert lifecycle.clean_strategies(df.drop("fecha_aprobado_ODT", "fecha_aprobado_arte")).first().fecha_aprobacion is None


def test_row_flag_modes(spark):
    names = list(lifecycle.DURATIONS)
    schema = "total_estrategias int, " + ", ".join(f"{n} double, {n}_td double" for n in names)
    row = lambda n, td: (n, *[x for _ in names for x in (1.0, td)])
    df = spark.createDataFrame([row(9, -1.0), row(5, 1.0), row(4, 1.0), row(4, None)], schema)
    got = [tuple(r) for r in df.select(lifecycle.row_flag(), lifecycle.row_flag(mode="literal")).collect()]
    assert got == [("negativo", "destacada"), ("destacada", "destacada"), (None, None), (None, None)]


def one_after_the_other(names):
    taken, out = {"Notas"}, {}
    for name in sorted(names):
        clean = name
        for ch in "\\/*[]:?":
            clean = clean.replace(ch, " ")
        clean = (" ".join(clean.split()) or "Cliente")[:31]
        base, i = clean, 0
        while clean in taken:
            i += 1
            clean = base[: 31 - len(f"_{i}")] + f"_{i}"
        taken.add(clean)
        out[name] = clean
    return out


def test_sheet_names_equal_one_after_the_other(spark):
    names = ["A", "A*", "A:", "A_1", "A_1_1", "Notas", "Notas?", "", "/", "Cliente", "x" * 40, "x" * 35, "x" * 31, "B  C", "B/C", "único", "A_2", "2025_1", "2025"]
    df = spark.createDataFrame([(n,) for n in [*names, *names, None]], "Cliente string")
    got = {r.Cliente: r.hoja for r in lifecycle.sheet_names(df).collect()}
    assert got == one_after_the_other(names)
    assert len(set(got.values())) == len(names) and max(map(len, got.values())) <= 31


def test_thousands_of_names_with_one_stem_take_a_few_jobs(spark):
    import random

    rng = random.Random(8)
    names = ["una campaña con un nombre largo " + "".join(rng.choice("abc?*") for _ in range(12)) for _ in range(6000)]
    names += [f"una campaña con un nombre lar_{i}" for i in range(0, 9000, 3)] + ["x_1", "x", "x*", "x_1*", "x?", "x_1_1", "_1", "_1*", "__1"]
    names = sorted(set(names))
    spark.sparkContext.setJobGroup("sheets", "sheets")
    got = {r.Cliente: r.hoja for r in lifecycle.sheet_names(spark.createDataFrame([(n,) for n in names], "Cliente string").repartition(5)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("sheets"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == one_after_the_other(names) and jobs <= 5


def test_classify_campaigns(spark, tmp_path):
    path = str(tmp_path / "clas")
    sheet = [("  dq ", "navidad", 0), ("DQ", "Verano ", None), (None, "suelta", 1), ("FAB", "doble", 1), ("fab", "DOBLE", 0)]
    spark.createDataFrame(sheet, "Cliente string, `Campaña` string, tradicional int").write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    classes = tables.read_classification(spark, path)
    rows = [("DQ", "Navidad", 9), ("dq", "verano", 6), ("DQ", "Otra", 5), (None, "Suelta", 1), ("FAB", "Doble", 1), ("DQ", "Nula", None)]
    got = lifecycle.classify_campaigns(spark.createDataFrame(rows, "cliente string, campana string, total_estrategias int"), classes)
    found = sorted((r.campana, r.clasificacion_campana_trad_ext) for r in got.collect())
    assert found == [("Doble", 0), ("Doble", 1), ("Navidad", 0), ("Nula", 2), ("Otra", 2), ("Suelta", 1), ("verano", 1)]
    assert [tuple(r) for r in lifecycle.duplicate_classes(classes).collect()] == [("FAB", "DOBLE", 2)]


def test_totals_of_intervals(spark):
    df = spark.createDataFrame([(dt.timedelta(hours=1), None, dt.timedelta(0)), (dt.timedelta(hours=1), dt.timedelta(hours=3), dt.timedelta(hours=2))], "a interval day to second, b interval day to second, c interval day to second")
    got = lifecycle.totals_and_shares(df, ["a", "b"], ["c"], unit="interval").collect()
    assert (got[0].total_tiempo_invertido, got[0].porcentaje_a, got[0].porcentaje_b, got[0].porcentaje_c) == (dt.timedelta(hours=1), 100.0, None, None)
    assert (got[1].porcentaje_b, got[1].porcentaje_c) == (75.0, 100.0)


def test_require_columns(spark):
    with pytest.raises(ValueError, match="falta"):
        require_columns(spark.range(1), ["id", "falta"])


# ------------------------------------------------------------------ nested and quality

@pytest.fixture(scope="module")
def records(spark):
    schema = "id int, u struct<user_id:int, g:struct<zona_ID:string, n:int>>, l array<struct<a:int, b:struct<c:int>>>, s array<string>"
    rows = [(1, (5, ("z", 1)), [(1, (2,)), (3, (4,))], ["p"]), (2, None, [], None), (2, (5, None), None, ["q", "r"])]
    return spark.createDataFrame(rows, schema)


def test_flatten_structs(records):
    flat = nested.flatten_structs(records)
    assert flat.columns == ["id", "l", "s", "u.user_id", "u.g.zona_ID", "u.g.n"]
    assert tuple(flat.first())[3:] == (5, "z", 1) and json.loads(flat.first().s) == ["p"]


def test_explode_column(records):
    got = nested.explode_column(records, "l")
    assert got.columns == ["id", "u", "s", "l.a", "l.b.c"]
    assert sorted((r.id, r["l.a"], r["l.b.c"]) for r in got.collect() if r["l.a"]) == [(1, 1, 2), (1, 3, 4)]
    assert got.count() == 4  # empty and missing lists keep a row
    assert sorted(str(r.s) for r in nested.explode_column(records, "s").collect()) == ["None", "p", "q", "r"]
    assert [r.id for r in nested.explode_column(records, "id").collect()] == [None, None, None]


def test_foreign_keys_and_candidates(records, spark):
    keys = nested.foreign_key_map({"t": records, "plain": spark.range(3)})
    assert {tuple(r) for r in keys.collect()} == {("t", "u.user_id", "5"), ("t", "u.g.zona_ID", "z")}
    assert nested.foreign_key_map({"plain": spark.range(3)}).count() == 0
    found = nested.candidate_joins(keys, {"t": records, "nums": spark.range(4, 9)})
    assert [tuple(r) for r in found.collect()] == [("t", "u.user_id", "nums", 1, 1.0)]
    many = nested.foreign_key_samples(spark.range(50).selectExpr("'t' tabla", "'k' fk", "cast(id as string) valor")).first()
    assert (many.valores_distintos, many.muestra) == (50, "0, 1, 10")


def test_quality_report(records, spark):
    plain = spark.createDataFrame([("a", 1.0), ("a", 1.0), (None, float("nan")), (None, None)], "x string, y double")
    got = {(r.tabla, r.metrica, r.columna): r.valor for r in quality.quality_report({"r": records, "p": plain}).collect()}
    assert got[("r", "duplicados_id", None)] == 1 and got[("r", "duplicados_fila", None)] == 0 and got[("r", "filas", None)] == 3
    assert ("r", "pct_nulos", "id") not in got and ("r", "anidada", "u") in got and ("r", "pct_nulos", "u") not in got
    assert got[("p", "pct_nulos", "x")] == 50.0 and got[("p", "pct_nulos", "y")] == 50.0 and got[("p", "duplicados_fila", None)] == 1


def test_duplicates_are_exact(spark):
    rows = [(1, "2025-01-01 00:00:00.000001", 0.0, None), (2, "2025-01-01 00:00:00.000002", -0.0, {"a": 1}), (2, "2025-01-01 00:00:00.000002", 0.0, {"a": 1}), (3, None, float("nan"), None), (3, None, float("nan"), None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "n int, t string, v double, m map<string,int>").withColumn("id", F.to_timestamp("t")).drop("t")
    got = {r.metrica: r.valor for r in quality.table_quality("t", df).collect() if r.columna is None}
    assert (got["duplicados_fila"], got["duplicados_id"]) == (2, 3)


def test_failing_source_does_not_stop_the_others(spark):
    opened = tables.read_sources({"dq_2025": lambda: spark.createDataFrame(strategy_rows(), STRATEGIES), "mal_2025": "/no/such/folder"}, spark.read.parquet)
    status = {r.fuente: r for r in tables.load_status(opened).collect()}
    assert status["dq_2025"].estado == "OK" and status["mal_2025"].estado == "ERROR" and "Exception" in status["mal_2025"].aviso
    assert tables.load_status({}).count() == 0


def test_dates_in_given_formats(spark):
    rows = [("1", "a", "E", "05/01/2026", "20260105", "Jan 5 2026", "nada")]
    df = spark.createDataFrame(rows, STRATEGIES)
    formats = ("dd/MM/yyyy", "yyyyMMdd", "MMM d yyyy")
    got = lifecycle.clean_strategies(df, formats).first()
    assert got.fecha_arte == got.fecha_preproyecto == got.fecha_aprobacion == dt.datetime(2026, 1, 5)
    lost = {r.columna: r.ilegibles for r in lifecycle.unreadable_dates(df, formats).collect()}
    assert sum(lost.values()) == 1 and lost["fecha_aprobado_ODT"] == 1


def test_maps_become_columns(spark):
    df = spark.createDataFrame([(1, {"b": "x", "a": "y"}), (2, {"a": "z"}), (3, None)], "id int, m map<string,string>")
    flat = nested.flatten_structs(df)
    assert flat.columns == ["id", "m.a", "m.b"] and sorted(tuple(r) for r in flat.collect())[1] == (2, "z", None)
    with pytest.raises(ValueError):
        nested.maps_to_structs(df, most=1)


# ------------------------------------------------------------------ API records

def numbers(n, calls=None):
    def fetch(offset, limit):
        rows = [{"id": i, "name": f"n{i}"} for i in range(n)]
        return {"data": rows[offset: None if limit is None else offset + limit]}

    return fetch


@pytest.mark.parametrize("limit,fetch_all,total,count", [
    (None, False, None, 25), (None, True, None, 25), (10, False, None, 10), (10, True, None, 25), (10, True, 25, 25), (5, True, None, 25), (5, True, 25, 25), (5, True, 12, 25), (5, True, 99, 25), (5, True, 0, 25),
])
def test_paged_records(spark, limit, fetch_all, total, count):
    got = api.read_api_records(spark, numbers(25), RECORD, "data", limit, fetch_all, total)
    assert sorted(r.id for r in got.collect()) == list(range(count))


def test_paging_status_and_errors(spark):
    pages = api.fetch_pages(spark, numbers(25), "data", 10)
    assert tuple(api.read_status(pages, "src", 10).first()) == ("src", 10, "OK", "puede haber más registros")

    def broken(offset, limit):
        if offset:
            raise RuntimeError("caída")
        return {"data": [{"id": i} for i in range(limit)]}

    pages = api.fetch_pages(spark, broken, "data", 10, True)
    assert tuple(api.read_status(pages, "src", 10, True).first()) == ("src", 0, "ERROR", "RuntimeError: caída")
    assert api.read_api_records(spark, broken, RECORD, "data", 10, True).count() == 0
    single = api.read_api_records(spark, lambda offset, limit: {"id": 7, "name": "x"}, RECORD)
    assert [tuple(r) for r in single.collect()] == [(7, "x")]


def test_landed_pages(spark, tmp_path):
    for i, page in enumerate([[1, 2], [3, 4], [5], [6, 7]]):
        (tmp_path / f"page-{i:03}.json").write_text(json.dumps({"data": [{"id": x, "name": "n"} for x in page]}), encoding="utf8")
    schema = spark.createDataFrame([], RECORD).schema
    ids = lambda **options: sorted(r.id for r in api.read_api_records(spark, str(tmp_path), schema, "data", **options).collect())
    assert ids() == ids(limit=2) == ids(limit=2, fetch_all=True) == [1, 2, 3, 4, 5, 6, 7]
    for i in range(1, 12):
        folder = tmp_path / "unpadded"
        folder.mkdir(exist_ok=True)
        (folder / f"page_{i}.json").write_text(json.dumps({"data": [{"id": 3 * i + k, "name": "n"} for k in range(3 if i < 11 else 1)]}), encoding="utf8")
    every = api.read_landed_pages(spark, str(tmp_path / "unpadded"), schema, "data")
    assert sorted(r.id for r in every.collect()) == list(range(3, 34))
    first = api.read_landed_pages(spark, str(tmp_path / "unpadded"), schema, "data", first_only=True)
    assert sorted(r.id for r in first.collect()) == [3, 4, 5]


def test_landed_pages_share_files(spark, tmp_path):
    (tmp_path / "part-0").write_text("\n".join(json.dumps({"data": [{"id": x, "name": "a\nb"} for x in page]}) for page in [[1, 2], [], [3]]) + "\n", encoding="utf8")
    got = api.read_api_records(spark, str(tmp_path), RECORD, "data", lines=True).collect()
    assert sorted((r.id, r.name) for r in got) == [(i, "a\nb") for i in (1, 2, 3)]


def test_pages_of_the_queries_land_in_few_files(spark, tmp_path, monkeypatch):
    """Files grow with the rows, not with the pages; each page is still found by its offset."""
    from suite import queries_tables
    from suite.registry import QUERIES

    spark.range(30_000).selectExpr("id as doc_id", "cast(id % 2 as int) quality", "0 toxic").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(queries_tables, "checkpoint_dir", lambda _: str(tmp_path))
    assert QUERIES["s1_landed_pages"](spark, str(tmp_path)).distinct().count() == 30_000
    assert len(list(tmp_path.glob("pages-*/**/part-*"))) <= 8
    fetch = queries_tables.label_pages(queries_tables.landed_labels(spark, str(tmp_path)))
    assert [fetch(o, 100)["data"][0]["doc_id"] for o in (0, 29_900, 10_000, 9_900)] == [0, 29_900, 10_000, 9_900] and fetch(30_000, 100) == {"data": []}
    assert len(list(tmp_path.glob("pages-*/**/part-*"))) <= 8 + 3


def test_schema_comes_from_all_records(spark, tmp_path):
    from flowmetrics.sources import api

    pages = [
        '{"data": [{"id": 1, "a": 1, "b": "x", "c": {"d": [1, 2], "OBJECT": 1}}, {"id": 2, "a": 1.5, "solo": true}]}',
        '{"data": [{"id": 3, "a": null, "b": 7, "c": {"d": [2.5], "VOID": "v"}, "vacio": null}, {"id": 4, "b": {"k": [1]}, "con espacio": "s"}]}',
        '{"data": {"id": 5, "a": -2}}',
    ]
    for i, page in enumerate(pages):
        (tmp_path / f"page_{i}.json").write_text(page)
    got = api.read_api_records(spark, f"file://{tmp_path}", None, "data")
    kinds = dict(got.dtypes)
    assert kinds["id"] == "bigint" and kinds["a"] == "double" and kinds["b"] == "string" and kinds["vacio"] == "string" and kinds["solo"] == "boolean"
    assert "d:array<double>" in kinds["c"] and "OBJECT:bigint" in kinds["c"] and "VOID:string" in kinds["c"] and kinds["con espacio"] == "string"
    rows = {r.id: r for r in got.collect()}
    assert [rows[i].a for i in range(1, 6)] == [1.0, 1.5, None, None, -2.0]
    assert [rows[i].b for i in range(1, 6)] == ["x", None, "7", '{"k":[1]}', None] and rows[3].c.d == [2.5] and rows[2].c is None


def test_fetched_records_without_a_schema(spark):
    from flowmetrics.sources import api

    def fetch(offset, limit):
        return [{"id": i, "extra": "late"} if i == 11 else {"id": i} for i in range(offset, min(offset + limit, 12))]

    got = api.read_api_records(spark, fetch, None, limit=5, fetch_all=True)
    assert got.dtypes == [("extra", "string"), ("id", "bigint")] and sorted(r.id for r in got.where("extra is null").collect()) == list(range(11))
    empty = api.read_api_records(spark, lambda offset, limit: [], None, limit=5, fetch_all=True)
    assert empty.columns == [] and empty.count() == 0
    assert sorted(r.valor for r in api.read_api_records(spark, lambda offset, limit: [3, 4], None).collect()) == [3, 4]

    def broken(offset, limit):
        raise ValueError("no")

    assert api.read_api_records(spark, broken, None).count() == 0


# ------------------------------------------------------------------ values of any kind

def variants(spark, rows, names="id int, texto string"):
    return spark.createDataFrame(rows, names).select("id", F.parse_json("texto").alias("v"))


def test_lists_of_any_elements_are_exploded(spark):
    rows = [(1, '[{"a": 1, "b": {"c": "x"}}, 5, null, [1], {"b": {"d": true}, "a": 2.5}]'), (2, "[]"), (3, '"no"'), (4, None), (5, '{"a": 9}')]
    got = nested.explode_column(variants(spark, rows), "v")
    assert got.columns == ["id", "v.a", "v.b.c", "v.b.d"]
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found.count((1, None, None, None)) == 3 and (1, 1.0, "x", None) in found and (1, 2.5, None, True) in found
    assert [f for f in found if f[0] > 1] == [(i, None, None, None) for i in (2, 3, 4, 5)]


def test_lists_without_objects_keep_their_column(spark):
    got = nested.explode_column(variants(spark, [(1, "[1, 2]"), (2, "[]"), (3, "7")]), "v")
    assert got.dtypes == [("id", "int"), ("v", "bigint")] and sorted(str(r.v) for r in got.collect()) == ["1", "2", "None", "None"]
    mixed = nested.explode_column(variants(spark, [(1, '[1, "a", [2], null]')]), "v")
    assert mixed.dtypes[1] == ("v", "string") and sorted(str(r.v) for r in mixed.collect()) == ["1", "None", "[2]", "a"]
    assert nested.explode_column(variants(spark, [(1, None)]), "v").collect()[0].v is None


def test_objects_among_other_values_are_flattened(spark):
    got = nested.flatten_structs(variants(spark, [(1, '{"a": {"b": 1}, "l": [1, 2]}'), (2, "[3]"), (3, "4"), (4, None)]))
    assert got.columns == ["id", "v.a.b", "v.l"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, [1, 2]), (2, None, None), (3, None, None), (4, None, None)]
    lists = nested.flatten_structs(variants(spark, [(1, "[1, 2]"), (2, "4")]))
    assert sorted(r.v for r in lists.collect()) == ["4", "[1,2]"]


def test_thousands_of_keys(spark):
    rows = [(i, json.dumps([{f"k{i}": i, "id": {"x_id": i}}, i])) for i in range(5000)]
    frame = variants(spark, rows).repartition(4)
    got = nested.explode_column(frame, "v")
    assert len(got.columns) == 5002
    assert got.select("`v.k17`", "`v.id.x_id`").where("`v.k17` is not null").collect()[0] == (17, 17)
    maps = spark.range(3000).select(F.create_map(F.concat(F.lit("k"), F.col("id"), F.lit("_id")), F.create_map(F.lit("n"), F.col("id"))).alias("m"))
    keys = nested.foreign_key_map({"t": maps})
    assert keys.count() == 3000 and ("t", "m.k5_id.n", "5") in {tuple(r) for r in keys.collect()}
    assert {tuple(r) for r in nested.foreign_key_map({"t": variants(spark, [(1, '{"u": {"uid": 3}, "x": 1}'), (2, "5")])}).collect()} == {("t", "v.u.uid", "3")}


def test_wide_objects_are_parsed_to_the_same_values(spark, monkeypatch):
    texts = ['[{"k%03d": %s, "n": %s, "w": {"d": "\\u00e9\\"%d"}}, 7]' % (i, ('"t%d"' % i, str(i), "1.50", "true", "null", "[1, 2]")[i % 6], ("3", "2.25", "1e300")[i % 3], i) for i in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", F.parse_json("t").alias("l")).coalesce(1)
    wide = nested.explode_column(rows, "l")
    cast = "try_variant_get"
    assert len(wide.columns) == 153 and cast not in wide._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    monkeypatch.setattr(nested, "WIDE_FIELDS", 10**6)
    narrow = nested.explode_column(rows, "l")
    assert wide.schema == narrow.schema
    in_order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert in_order(wide) == in_order(narrow) and len(in_order(wide)) == 300
    assert is_json("OBJECT<DATE: BIGINT, a: DECIMAL(3,1)>") and not is_json("OBJECT<a: DATE>") and not is_json("OBJECT<a: VARIANT>")


def test_sketches_lose_no_pair_however_few_values_it_shares(spark):
    """One value of 3,000 is an id of a small table, one of a table as large as the key."""
    keys = spark.range(3000).selectExpr("'a' tabla", "'k.id' fk", "cast(id as string) valor")
    frames = {"pocas": spark.range(2999, 3005), "muchas": spark.range(2999, 9000), "ajena": spark.range(5000, 9000)}
    want = {("a", "k.id", t, 1, 1 / 3000) for t in ("pocas", "muchas")}
    for sketch in (None, 10):
        assert {tuple(r) for r in nested.candidate_joins(keys, frames, sketch=sketch).collect()} == want


def test_sketches_leave_out_unrelated_keys_only(spark):
    keys = spark.range(20_000).selectExpr("'t' tabla", "'a.id' fk", "cast(id as string) valor")
    keys = keys.unionByName(spark.range(5000).selectExpr("'t' tabla", "'b.id' fk", "concat('x', id) valor")).unionByName(spark.range(30).selectExpr("'t' tabla", "'c.id' fk", "cast(id * 700 as string) valor"))
    frames = {"near": spark.range(0, 30_000, 2), "one": spark.range(20_300, 20_400), "far": spark.range(10**6, 10**6 + 50)}
    want = {tuple(r) for r in nested.candidate_joins(keys, frames).collect()}
    assert {tuple(r) for r in nested.candidate_joins(keys, frames, sketch=200).collect()} == want and len(want) == 3
    known = frames["near"].selectExpr("'near' tabla_id", "cast(id as string) valor").unionByName(frames["far"].selectExpr("'far' tabla_id", "cast(id as string) valor"))
    assert {tuple(r) for r in nested.related(keys, known, 200).collect()} == {("t", "a.id", "near"), ("t", "c.id", "near")}


def test_keys_match_whatever_white_space_pads_them(spark):
    from flowmetrics.functions.labels import station_type

    campaigns = spark.createDataFrame([("Acme", "Uno", 9)], "cliente string, campana string, total_estrategias int")
    sheet = spark.createDataFrame([("ACME\t", " uno \r\n", 0)], "Cliente string, `Campaña` string, tradicional int")
    got = lifecycle.classify_campaigns(campaigns, tables.normalise_classification(sheet)).first()
    assert got.clasificacion_campana_trad_ext == 0
    assert spark.createDataFrame([(" calidad ",)], "e string").select(station_type(F.col("e"))).first()[0] == "Calidad"


def test_campaign_models_join_the_raw_tables_once(spark, monkeypatch):
    from suite import adapters, queries_tables

    opened, table = [], adapters.table
    monkeypatch.setattr(adapters, "table", lambda s, d, name: opened.append(name) or table(s, d, name))
    queries_tables._campaign_models(spark, "/root/testdata/sf0.001")
    assert sorted(opened) == ["customer", "lineitem", "orders"]


def test_station_features_count_equal_boxes_once(spark):
    """Medians over boxes equal the plain ones, and quantiles take a row as often as its weight says."""
    from flowmetrics.operators import difficulty, order_stats

    boxes = spark.createDataFrame([("A", str(i), i % 3, i % 5) for i in range(40)] + [(None, "1", 9, 9), ("B", "2", 7, 1)], "campana string, box_id string, n_categorias_en_caja long, n_filas_distintas long")
    visits = [(str(i), s) for i in range(0, 40) for s in ("Azul", "Rojo", "Calidad")[: 1 + i % 3]] + [("2", "Azul"), (None, "Azul")]
    got = {(r[0], r[1]): (r[2], r[3]) for r in difficulty.station_features(boxes, spark.createDataFrame(visits, "box_id string, tipo_estacion string")).collect()}
    median = lambda values: (sorted(values)[(len(values) - 1) // 2] + sorted(values)[len(values) // 2]) / 2
    red = [i for i in range(40) if i % 3]
    want = {("A", s): (median([i % 3 for i in ids]), median([i % 5 for i in ids])) for s, ids in (("Azul", range(40)), ("Rojo", red))}
    assert got == want | {("B", "Azul"): (7, 1), ("B", "Rojo"): (7, 1)}
    weighted = spark.createDataFrame([(1.0, 3), (5.0, 2), (9.0, 1)], "v double, w long")
    assert order_stats.quantiles(weighted, [], {"m": ("v", 0.5)}, "w").first()["m"] == 3.0
