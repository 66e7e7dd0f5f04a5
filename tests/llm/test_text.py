"""Line dedup, near duplicates, decontamination and fingerprints against brute force."""

import random
import re

import pytest

from flowmetrics.llm import decontamination, fingerprints, lines, similarity_join
from flowmetrics.llm.common import prepare
from flowmetrics.llm.components import components


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup(spark):
    prepare(spark)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randrange(5, 14))] for _ in range(25)]
    texts = []
    for _ in range(60):
        some = []
        for _ in range(rng.randrange(0, 6)):
            line = list(rng.choice(base))
            kind = rng.randrange(5)
            at = rng.randrange(len(line))
            if kind == 1:
                line[at] = rng.choice(words)
            elif kind == 2:
                del line[at]
            elif kind == 3:
                line.insert(at, rng.choice(words))
            some.append(rng.choice(["", " ", "\t"]) + "  ".join(line))
            if rng.random() < 0.2:
                some.append("")
        texts.append("\n".join(some) + rng.choice(["", "\n"]))
    long_line = " ".join(rng.choice(words) for _ in range(41))
    texts += [long_line, "x " + long_line, "a a a a a a", "a a a a a", "b", "b"]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(500, None, 1), (501, "", 1), (None, "a a a a a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int").repartition(4)
    got = {r[0]: r for r in lines.dedup_lines(df, "doc_id", "text", max_words=16).collect()}
    seen, gone, kept_text = [], {}, {}
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        parts = []
        for line in re.findall(r"[^\n]*\n|[^\n]+", text or ""):
            parts += re.findall(r"\s*(?:\S+\s*){1,16}", line) if len(line.split()) > 16 and len(line) > 32 else [line]
        out = []
        for place, part in enumerate(parts):
            own = part.split()
            if own and any(own == w or (min(len(own), len(w)) >= 5 and edits(own, w) <= 1) for w in seen):
                gone.setdefault(key, []).append(place)
            else:
                out.append(part)
            if own:
                seen.append(own)
        new = "".join(out)
        kept_text[key] = text if key not in gone else (new[:-1] if new.endswith("\n") and not text.endswith("\n") else new)
        assert (got[key]["lines"], got[key]["_gone"], got[key]["text"]) == (len(parts), gone.get(key, []), kept_text[key]), key
    assert any(gone.values()) and got[500]["gone"] == 1
    assert lines.dedup_lines(df.limit(0), "doc_id", "text").count() == 0


def test_long_lines_are_compared_whole(spark, monkeypatch):
    prepare(spark)
    rng = random.Random(6)
    long = [f"w{rng.randrange(500)}" for _ in range(3000)]
    other = [f"v{i}" for i in range(1700)]
    some = [long, [*long[:100], "x", *long[100:]], [*long[:2500], "y", *long[2501:]], long[1:], other, [*other[:900], "z", "z", *other[900:]], [*other[:512], *long[512:]], other[:512], other[:513], other[:511]]
    df = spark.createDataFrame([(i, " ".join(w) + "\nend of it " + str(i)) for i, w in enumerate(some)], "doc_id long, text string")
    got = {r.doc_id: r.gone for r in lines.dedup_lines(df, "doc_id", "text").collect()}
    assert got == {i: [0] if i in (1, 2, 3, 8, 9) else [] for i in range(len(some))}
    monkeypatch.setattr(lines, "LONG_WORDS", 8)
    base = [[rng.choice("abcdefghij") for _ in range(n)] for n in (5, 6, 7, 7, 8, 8, 9, 9, 10, 14)]
    rows = []
    for i in range(120):
        line = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(line))
            line[at : at + rng.randrange(2)] = [rng.choice("abcdefghij")] * rng.randrange(2)
        rows.append((i, " ".join(line)))
    want, seen = set(), []
    for i, t in rows:
        own = t.split()
        if any(own == w or (min(len(own), len(w)) >= 5 and edits(own, w) <= 1) for w in seen):
            want.add(i)
        seen.append(own)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in lines.dedup_lines(df, "doc_id", "text").collect() if r.gone} == want


def test_every_line_is_hashed_without_a_step_per_word(spark, monkeypatch):
    """The pass over all lines of all texts cuts and hashes strings in compiled code; interpreted lambdas are for needed lines only."""
    plans = []
    settle = lines.settle
    monkeypatch.setattr(lines, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    df = spark.createDataFrame([(1, "a b c d e f\nx"), (2, "a b c d e g")], "doc_id long, text string")
    assert {r.doc_id: r.gone for r in lines.dedup_lines(df, "doc_id", "text").collect()} == {1: [], 2: [0]}
    passes = [p for p in plans if "halves" in p and "explode" in p and "text" in p]
    assert passes and not any("lambda" in p for p in passes)


def test_white_space_does_not_tell_lines_apart(spark):
    rng = random.Random(9)
    spaces = [" ", " ", "  ", "\t", "\r", "\x0b", "\f", " \t  "]
    alphabet = ["ä", "b", "ßß", "d\u00a0d", "\U0001f600", "\u3000", "g", "\x1c"]
    base = [[rng.choice(alphabet) for _ in range(n)] for n in (1, 2, 4, 5, 5, 6, 6, 7, 8, 9, 70, 71)]
    rows = []
    for i in range(90):
        some = []
        for _ in range(rng.randrange(4)):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = [rng.choice(alphabet)] * rng.randrange(2)
            odd = rng.random() < 0.6
            end = rng.choice(["", *spaces]) if odd else ""
            some.append(end + "".join(w + (rng.choice(spaces) if odd else " ") for w in line[:-1]) + "".join(line[-1:]) + rng.choice(["", end]))
        rows.append((i, "\n".join([*some, *rng.choice([[], [""], [" \t"]])])))
    want, seen = {i: [] for i, _ in rows}, []
    for i, text in rows:
        for place, line in enumerate(text.split("\n")):
            own = [w for w in re.split("[ \t\r\x0b\f]+", line) if w]
            if own and any(own == w or (min(len(own), len(w)) >= 5 and edits(own, w) <= 1) for w in seen):
                want[i].append(place)
            if own:
                seen.append(own)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.gone for r in lines.dedup_lines(df, "doc_id", "text").collect()} == want


def test_no_python_in_the_native_plans(spark):
    df = spark.createDataFrame([(1, "a b c d e f\nx"), (2, "a b c d e g")], "doc_id long, text string")
    for plan in (lines.dedup_lines(df, "doc_id", "text"), fingerprints.compare_with_edit_and_next(df, "doc_id", "text")):
        shown = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in shown and "Arrow" not in shown and "Pandas" not in shown and "Cartesian" not in shown


@pytest.mark.parametrize("tile", [512, 9])
def test_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(similarity_join, "TILE", tile)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 30)):
            t = list(base)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += ["", None, "  ", "a b", "A  b", "a b c", "long " * 5000]
    rows = list(enumerate(texts)) + [(None, "only null key here now"), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(similarity_join.near_duplicates(df, "doc_id", "text").collect(), key=str)
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])))
    near = [[j for j, y in enumerate(sets) if j != i and (x == y or (x and y and len(x & y) / len(x | y) >= 0.8))] for i, x in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in near[i])]) for i in range(len(rows))]
    want = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        want.append((key, min(keys, default=None), len(near[i])))
    assert got == sorted(map(lambda w: w, want), key=lambda w: str(type(got[0])(w) if False else f"Row(doc_id={w[0]}, class_id={w[1]}, n_links={w[2]})"))
    assert similarity_join.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_each_linked_text_is_fetched_once(spark, monkeypatch):
    fetched = spark.sparkContext.accumulator(0)
    plain = similarity_join.slices

    def counted(batches, text):
        for batch, texts in plain(batches, text):
            if "component" in batch.schema.names:
                fetched.add(len(texts))
            yield batch, texts

    monkeypatch.setattr(similarity_join, "slices", counted)
    rows = []
    for i in range(40):
        words = [f"t{i}w{j}" for j in range(50)]
        rows += [(None, " ".join(words)), (None, " ".join([*words[:-1], "x"])), (1, " ".join([*words[:-1], "y"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = similarity_join.near_duplicates(df, "doc_id", "text").collect()
    assert len(got) == 120 and {(r.class_id, r.n_links) for r in got} == {(1, 2)}
    assert fetched.value == 120


def test_posterior_bound():
    least = similarity_join.least_matches()
    assert list(least) == list(range(16, 129, 16)) and all(0 <= m <= 0.8 * n for n, m in least.items()) and sorted(least.values()) == list(least.values())


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 101), (7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 105: 100}


def test_decontamination(spark):
    prepare(spark)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    items = [" ".join(word() for _ in range(rng.randrange(12, 40))) for _ in range(8)] + ["tiny one", None, "!!"]
    docs, want = [], set()
    for i in range(60):
        text = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(8)
            copy = list(items[k])
            for _ in range(rng.randrange(0, int(0.1 * len(copy)) + 1)):
                copy[rng.randrange(len(copy))] = "z"
            text.insert(rng.randrange(len(text) + 1), "".join(copy).upper())
            want.add((i, k))
        docs.append((i, ",\n".join(text)))
    docs += [(100, None), (101, ""), (102, "x tiny, one y"), (103, "tinyone"), (104, "v " * 9000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = decontamination.matches(df, "doc_id", "text", table, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(102, 8)}
    by_id = dict(docs)
    fold = lambda t: " ".join(re.findall(r"[a-z0-9]+", t.lower()))
    for r in got:
        assert edits(fold(items[r.item_id]), fold(by_id[r.doc_id][r.start : r.end])) == r.edits
    assert decontamination.matches(df, "doc_id", "text", table.limit(0), "item_id", "text").count() == 0
    assert decontamination.matches(df.limit(0), "doc_id", "text", table, "item_id", "text").count() == 0


def test_fingerprints(spark):
    rng = random.Random(6)
    texts = [". ".join("word%d" % rng.randrange(30) * rng.randrange(1, 9) for _ in range(rng.randrange(0, 40))) for _ in range(30)]
    rows = [*enumerate(texts), (40, None), (41, ""), (42, "é😀x"), (43, "same"), (44, "same"), (45, "p.\n" * 2000), (45, "p.\n" * 2000), (None, "null key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprints.compare_with_edit_and_next(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    cut = re.compile(fingerprints.PARAGRAPH)
    order = sorted({k for k, _ in rows if k is not None}, reverse=True) + [None]
    text = {k: t or "" for k, t in rows}
    import hashlib

    for r in got:
        own, following = text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]]
        third = len(own) // 3
        edited = own[: len(own) - third] + following[:third]
        a, b, c = (set(cut.findall(t)) - {""} for t in (own, edited, following))
        like = lambda x, y: 1 - len(x ^ y) / (len(x) + len(y)) if x or y else 1.0
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == pytest.approx((like(a, b), like(a, c)))
    assert fingerprints.compare_with_edit_and_next(df.limit(0), "doc_id", "text").count() == 0
    shown = {r.doc_id: r.fingerprint for r in got}
    assert shown[43] == shown[44] and len({shown[k] for k in range(30)}) == len({text[k] for k in range(30)})


def test_sketch_too_small_fails_and_then_decodes(spark):
    rows = [(i, list(range(1000 * i, 1000 * i + 40)), list(range(1000 * i + 30, 1000 * i + 75))) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "i long, a array<long>, b array<long>")
    tight = fingerprints.differing(df, ["i"], "a", "b", steps=2).collect()
    assert not all(r.whole for r in tight)
    loose = fingerprints.differing(df, ["i"], "a", "b", growth=4, steps=9).collect()
    assert all(r.whole and r.recovered == 65 and r.held == 85 for r in loose)


def test_rows_of_one_key_whose_texts_share_a_short_hash_are_told_apart(spark):
    """Two texts with equal 32-bit hashes under a null key: what goes from one, as a copy of another row's line, stays in the other."""
    from pyspark.sql import functions as F

    shared = "and a shared line of some words here"
    opening = F.concat_ws(" ", *[F.substring(F.sha2(F.col("id").cast("string"), 256), 1 + 8 * i, 8) for i in range(7)])
    texts = spark.range(300_000).select(F.concat(opening, F.lit(f"\n{shared}")).alias("text"))
    one, two = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").head().texts[:2]
    rows = [(1, one.split("\n")[0]), (None, one), (None, two)]
    got = [line for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect() for line in r.text.split("\n") if line]
    assert sorted(got) == sorted([one.split("\n")[0], two.split("\n")[0], shared])
