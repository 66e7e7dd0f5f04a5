"""The pipeline's stages: each alone on a small table, and all together."""

import corpus_pipeline as P
from flowmetrics.llm.common import prepare

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = prepare(spark).read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SMALL).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_near_duplicates_stay_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "en", "s", 1), (5, text.replace("w9", "v"), "en", "s", 1), (4, "other text of its own here", None, None, None), (7, "", "en", "s", 0), (8, None, "en", "s", 0), (None, "alone", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(str(r[0]) for r in P.one_of_each_class(spark, docs, SMALL).collect()) == ["3", "4", "7", "None"]


def test_leaks_go_and_clean_documents_stay(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").head().text
    rows = [(1, f"before {item} after", "en", "s", 1), (2, item[: len(item) // 3], "en", "s", 1), (None, "clean", "en", "s", 1), (4, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(str(r[0]) for r in P.without_benchmark(spark, docs, SMALL).collect()) == ["2", "4", "None"]


def test_run(spark):
    rows = P.run(spark, SMALL).collect()
    total = {}
    for r in rows:
        total.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert rows and all(a == b for a, b in total.values())


def test_each_row_is_decided_by_its_own_text(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").head().text
    text = " ".join(f"w{i}" for i in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    rows = [(3, text), (None, text), (None, "a text of its own"), (5, text.replace("w9", "v")), (5, "another one of key five"), (None, "said twice"), (None, "said twice"), (6, "again here"), (6, "again here")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], schema)
    got = sorted((str(r.doc_id), r.text) for r in P.one_of_each_class(spark, docs, SMALL).collect())
    assert got == [("3", text), ("5", "another one of key five"), ("6", "again here"), ("None", "a text of its own"), ("None", "said twice")]
    rows = [(None, f"before {item} after"), (None, "clean"), (7, item), (7, "clean as well"), (7, None), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], schema)
    got = sorted((str(r.doc_id), r.text or "") for r in P.without_benchmark(spark, docs, SMALL).collect())
    assert got == [("7", ""), ("7", "clean as well"), ("None", ""), ("None", "clean")]
