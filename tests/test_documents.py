"""The report's documents: order, parts, commit and abandoned attempts."""

import datetime as dt
import json
import os

import pytest

from flowmetrics.sources import documents

CAMPAIGNS = "hoja string, `Campaña` string, orden_fecha timestamp, n int"


def report(spark, path, rows, clients=(("A", "a"), ("B/ñ", "b"))):
    table = spark.createDataFrame(rows, CAMPAIGNS).repartition(3)
    documents.write_report_documents(table, spark.createDataFrame(list(clients), "hoja string, Cliente string"), path)
    return [(r.hoja, r.fila, r.bloque, json.loads(r.contenido)) for r in documents.read_report_documents(spark, path).collect()]


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def test_client_first_then_campaigns_newest_first(spark, tmp_path):
    rows = [("A", "x", day(1), 1), ("A", "y", day(5), 2), ("A", "nada", None, 3), ("A", "w", day(5), None), ("B/ñ", "q\nz", day(2), 5)]
    got = report(spark, str(tmp_path / "r"), rows)
    a = [c for h, _, _, c in sorted(got) if h == "A"]
    assert [c.get("Campaña") for c in a] == [None, "w", "y", "x", "nada"] and a[0] == {"Cliente": "a"} and a[1]["n"] is None
    assert [(f, b) for h, f, b, _ in sorted(got) if h == "B/ñ"] == [(1, "cliente"), (2, "campaña")]
    assert [c for h, f, _, c in got if h == "B/ñ" and f == 2] == [{"Campaña": "q\nz", "n": 5}]


def test_a_sheet_of_several_tasks_keeps_its_order(spark, tmp_path):
    rows = [("A", f"c{i:05d}", day(i % 900), i) for i in range(6000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(report(spark, str(tmp_path / "r"), rows, [("A", "a"), ("Z", "z")]), key=lambda line: line[:2])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    a = [c for h, _, _, c in got if h == "A"]
    assert [f for h, f, *_ in got if h == "A"] == list(range(1, 6002))
    want = sorted(range(6000), key=lambda i: (-(i % 900), i))
    assert [c["n"] for c in a[1:]] == want
    with open(tmp_path / "r" / "_commit.json") as commit:
        assert len(json.load(commit)) > 1


def test_a_new_report_replaces_the_old_one_and_strays_are_not_read(spark, tmp_path):
    path = str(tmp_path / "r")
    report(spark, path, [("A", "old", day(1), 1)])
    got = report(spark, path, [("A", "new", day(1), 1)])
    assert sorted(c["Campaña"] for _, _, b, c in got if b == "campaña") == ["new"]
    run = next(n for n in os.listdir(path) if n.startswith("run-"))
    (tmp_path / "r" / run / "A").mkdir(exist_ok=True)
    (tmp_path / "r" / run / "A" / "000000-999.jsonl").write_text('["campaña", "{}"]\n')
    assert len(documents.read_report_documents(spark, path).collect()) == 3


def test_a_failed_write_leaves_the_report_before(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "r")
    report(spark, path, [("A", "old", day(1), 1)])
    bad = spark.range(10).select(F.lit("A").alias("hoja"), F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("Campaña"), F.lit(None).cast("timestamp").alias("orden_fecha"), F.lit(1).alias("n"))
    with pytest.raises(Exception):
        documents.write_report_documents(bad, spark.createDataFrame([("A", "a")], "hoja string, Cliente string"), path)
    assert [json.loads(r.contenido).get("Campaña") for r in documents.read_report_documents(spark, path).where("hoja = 'A'").orderBy("fila").collect()] == [None, "old"]
    writer = documents.DocumentsWriter(path, "run-x")
    kept = documents.opened(path)[1]
    os.makedirs(f"{kept}/run-x/_tasks")
    for name, text in (("run-x/a.jsonl", ""), ("run-x/_tasks/0.json", json.dumps([{"hoja": "A", "archivo": "run-x/a.jsonl", "filas": 0}]))):
        with open(f"{kept}/{name}", "w") as out:
            out.write(text)
    writer.abort([documents.Written(0, "run-x/_tasks/0.json", "A", 0, "A", 0), None])
    assert not os.path.exists(f"{kept}/run-x/a.jsonl")


def test_an_empty_report(spark, tmp_path):
    table = spark.createDataFrame([], CAMPAIGNS)
    documents.write_report_documents(table, spark.createDataFrame([], "hoja string, Cliente string"), str(tmp_path / "r"))
    assert documents.read_report_documents(spark, str(tmp_path / "r")).collect() == []
