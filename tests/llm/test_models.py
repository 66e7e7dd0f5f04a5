"""Language, quality and personal data: held-out accuracy, edge cases, patterns against plain regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as E
from flowmetrics.llm import language, pii, quality
from flowmetrics.llm.common import prepare

SMALL = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = E.queries()["op3_language"](spark, SMALL).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) > 150 and (found.lang_pred == found.lang).mean() > 0.97 and found.score.between(0, 1).all()


def test_language_edges(spark):
    prepare(spark)
    rows = [(1, "the cat and the dog sat"), (2, None), (3, ""), (4, "123 !?"), (5, "der hund und die katze"), (6, "hund " * 20_000), (7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id").isin(5, 6), "de").when(F.col("doc_id") == 1, "en"))
    model = language.fit(df, "doc_id", "text", "lang")
    got = {r[0]: (r[1], r[2]) for r in language.predict(df, "doc_id", "text", model).collect()}
    assert [got[i] for i in (2, 3, 4)] == [("und", 0.0)] * 3 and got[1][0] == "en" and got[5][0] == got[6][0] == "de" and got[7][0] in ("de", "en")
    assert language.fit(df.where("lang is null"), "doc_id", "text", "lang") is None
    assert {r[1] for r in language.predict(df, "doc_id", "text", None).collect()} == {"und"}
    assert language.predict(df.limit(0), "doc_id", "text", model).count() == 0


def test_presence_is_a_set_of_ngrams():
    found, has = language.presence(["Abab", "abAB!", "", "a b"])
    assert (found[1] == found[1] | found[0]).all() and has.tolist() == [True, True, False, True] and not found[2].any()
    assert (language.presence(["xyz"])[0][0] == language.presence(["q", "xyz"])[0][1]).all()


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = E.queries()["op6_quality"](spark, SMALL)
    assert found.count() == 1000
    held = found.where("held_out").join(labels, "doc_id").toPandas()
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and (held.predicted == held.quality).mean() > 0.95


def test_quality_edges(spark):
    prepare(spark)
    rows = [(i, "plain words in a row here. And more of them, all fine.") for i in range(20)] + [(20 + i, "BUY!! BUY!! $$$ *** " * 5) for i in range(20)] + [(90, None), (91, ""), (92, "a " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = df.where("doc_id < 40").select("doc_id", (F.col("doc_id") < 20).cast("int").alias("quality"))
    model = quality.fit(df, labels, "doc_id", "text", "quality")
    got = {r["doc_id"]: r["_score"] for r in quality.score(df, "text", model).collect()}
    assert all(got[i] >= 0.3 for i in range(20)) and all(got[20 + i] < 0.3 for i in range(20)) and all(0 <= v <= 1 for v in got.values()) and len(got) == len(rows)
    assert quality.fit(df, labels.where("quality = 1"), "doc_id", "text", "quality") is None
    assert {r["_score"] for r in quality.score(df, "text", None).collect()} == {0.5}
    assert quality.score(df.limit(0), "text", model).count() == 0


def test_quality_fits_on_every_row_and_pair(spark):
    """The weights are those of all pairs written out, and the threshold lies between two of all strengths."""
    prepare(spark)
    rng = np.random.default_rng(3)
    words = np.array("the of a plain note on Some WORDS here 12 $$ !! more, all. fine BUY now x7".split())
    texts = [" ".join(rng.choice(words, rng.integers(4, 40), p=None)) for _ in range(150)]
    good = np.array([sum(c in "$!" for c in t) / len(t) + rng.normal() * 0.02 < 0.035 for t in texts])
    df = spark.createDataFrame([(i, t, int(g)) for i, (t, g) in enumerate(zip(texts, good, strict=True))], "doc_id long, text string, quality int")
    model = quality.fit(df, df.drop("text"), "doc_id", "text", "quality")
    x = quality.features(pa.array(texts))
    z = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6)
    better, worse = np.repeat(z[good], (~good).sum(), axis=0), np.tile(z[~good], (good.sum(), 1))
    assert 30 < good.sum() < 120 and np.abs(model.weights - quality.fit_pairs(better, worse)).max() < 2e-3
    ranked = np.sort(model.strength(x))
    assert np.isclose(model.threshold, ranked[(~good).sum() - 1 : (~good).sum() + 1].mean())


def test_language_fits_on_every_text(spark):
    """The weights are those of a ridge regression over all texts, also where one language has many."""
    prepare(spark)
    rng = np.random.default_rng(4)
    words = {"aa": "kala mina tori vesa oli nata".split(), "bb": "kala wort stein oli baum nata".split()}
    rows = [(i, " ".join(rng.choice(words[c], 6)), c) for i, c in enumerate(["aa"] * 900 + ["bb"] * 40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    kernel = np.concatenate([model.kernel([t for _, t, _ in rows[i : i + 100]])[0] for i in range(0, len(rows), 100)]).astype(float)
    value, vector = np.linalg.eigh((model.landmarks.T @ model.landmarks).astype(float))
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    target = np.array([[c == l for l in model.languages] for _, _, c in rows], float)
    weight = (target / target.sum(axis=0)).sum(axis=1)[:, None]
    x = kernel @ root
    want = x @ np.linalg.solve(x.T @ (x * weight) + 1e-3 * np.eye(x.shape[1]), x.T @ (target * weight))
    assert np.abs(kernel @ model.weights - want).max() < 1e-3


def test_pair_weights_follow_the_preferences():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(4000, 3)), np.array([1.5, -1.0, 0.0])
    a, b = x[:2000], x[2000:]
    first = rng.random(2000) < 1 / (1 + np.exp(-(a - b) @ w))
    fitted = quality.fit_pairs(np.where(first[:, None], a, b), np.where(first[:, None], b, a))
    assert np.abs(fitted - w).max() < 0.15


def test_features_of_single_texts_do_not_depend_on_the_batch():
    texts = ["a b a b", "", "Word WORD!! x", "é\nü ü", "a b a b"]
    together = quality.features(pa.array(texts))
    assert all(np.allclose(together[i], quality.features(pa.array([t]))[0]) for i, t in enumerate(texts))


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m.group())
            if (12 <= len(digits) <= 19 and pii.luhn(digits)) if kind == 2 else 9 <= len(digits) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_patterns():
    rng = random.Random(3)
    texts = ["a@b.com@c.org", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (499) 555-6503", "%+a@-.-", "१.2.3.4", "0001.2.3.004"]
    texts += ["".join(rng.choice("a1.@+- (5) 0") for _ in range(rng.randrange(5, 40))) for _ in range(5000)]
    assert all(pii.pattern_spans(t) == plain_spans(t) for t in texts)


def test_repeats_are_added(spark):
    prepare(spark)
    phones = [f"+1 ({100 + i}) 555-{1000 + i}" for i in range(40)]
    rows = [(i, f"call {p} now, again {p} or mail x{i}@mail.example.com x{i}@mail.example.com ref{i} 12{i}") for i, p in enumerate(phones)]
    rows += [(100, "call +1 (499) 555-6503 today. Later 555-6503, code 777-1234"), (101, None), (102, ""), (103, "1" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.fit(df, "doc_id", "text")
    got = {r[0]: (r[1], r[2]) for r in pii.find(df, "doc_id", "text", field).collect()}
    assert got[100] == ("phone:5:22", "phone:5:22,phone:36:44") and got[101] == got[102] == got[103] == ("", "")
    assert all(got[i][0] == got[i][1] and got[i][0].count("phone") == 2 for i in range(40))
    empty = pii.fit(df.limit(0), "doc_id", "text")
    assert {r[0]: r[1] for r in pii.find(df, "doc_id", "text", empty).collect()} == {k: v[0] for k, v in got.items()}


def test_messages_equal_enumeration():
    """On a graph without a loop the marginals are exact."""
    rng = np.random.default_rng(5)
    text = "a1 b2 +1 (499) 555-6503 zz 5556503 q7"
    graph = pii.Graph(text, pii.pattern_spans(text))
    n, k = len(graph.place), len(pii.KINDS) + 1
    pair = [(m + m.T) / 2 for m in rng.normal(size=(2, k, k))]
    field = pii.Field(rng.normal(size=(k, pii.FEATURES)) * 0.3, *pair)
    got = field.marginals(graph)
    bits = (np.array(graph.mask)[:, None] >> np.arange(pii.FEATURES)) & 1
    free = [i for i in range(n) if graph.label[i] == 0]
    want = np.zeros((n, k))
    for code in range(k ** len(free)):
        y = graph.label.copy()
        for i in free:
            y[i], code = code % k, code // k
        total = sum(field.own[y[i]] @ bits[i] for i in free) + sum(pair[0][y[a], y[b]] for a, b in graph.chain) + sum(pair[1][y[a], y[b]] for a, b in graph.skip)
        want[np.arange(n), y] += np.exp(total)
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(got, want, atol=0.02)


def test_a_null_key_is_not_held_out(spark):
    from flowmetrics.llm.queries import held_out

    rows = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,), (5,), (6,), (7,)], "doc_id long")
    got = {r.doc_id: r.held_out for r in rows.select("doc_id", held_out("doc_id", 4, 2)).collect()}
    assert got[None] is False and True in got.values()
