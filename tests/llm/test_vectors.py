"""Prefix trie, whitening and neighbour search against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmetrics.llm import collision_search, prefix_trie, whitening
from flowmetrics.llm.common import prepare

TURNS = "conv_id long, turn long, role string, text string, extra string"


def plain_trie(rows):
    """All nodes as sorted tuples, from every prefix of every rebuilt conversation."""
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in turns.items()}
    rebuilt = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + said[h:])
    members, kids, leaves, saved, ends = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(list)
    for c, said in rebuilt.items():
        ends[said].append(c)
        for d in range(len(said) + 1):
            members[said[:d]].append(c)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += (len(own_members) - 1) * (len(node[-1][1]) if node else 0)
    digest = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], digest(n)) for n, m in members.items())


def trie(turns):
    nodes = prefix_trie.prefix_nodes(prefix_trie.with_shared_heads(prefix_trie.turn_sequences(turns)))
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends_sha256) for r in nodes.collect())


@pytest.mark.parametrize("shard_turns", [200_000, 40])
def test_trie_equals_all_prefixes(spark, monkeypatch, shard_turns):
    """A third of the conversations are the same, some long, some turnless after rebuilding; shards cut through shared prefixes."""
    prepare(spark)
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 7)
    rng = random.Random(shard_turns)
    texts = ["", "a", "bb", "ünï", "x" * 3000, None]
    rows = []
    for c in [*range(0, 60), *range(100, 160), 30_000_000_000, -3, -250]:
        said = [("user", "same")] * 4 if c % 3 == 0 else [(rng.choice(["user", None, "assistant"]), rng.choice(texts)) for _ in range(rng.choice([1, 2, 3, 9]))]
        rows += [(c, t or None, role, text, "x") for t, (role, text) in enumerate(said)]
    rows += [(7000, t, "user", f"turn {t % 11}", None) for t in range(700)]
    rows += [(None, 1, "user", "nobody", None)]
    rng.shuffle(rows)
    assert trie(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)


def test_trie_of_nothing_and_of_empty_turns(spark):
    assert trie(spark.createDataFrame([], TURNS)) == []
    rows = [(5, None, None, None, None), (5, 1, "", "", None), (6, 1, None, "", None)]
    assert trie(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)


def test_repeated_rows_are_repeated_turns(spark):
    rows = [(c, 1, "user", "again", None) for c in (1, 1, 2, 2, 2)]
    found = trie(spark.createDataFrame(rows, TURNS))
    assert found == plain_trie(rows) and max(d for _, d, *_ in found) >= 2


def test_medians_first_gives_a_shallow_tree():
    order = list(prefix_trie.medians_first(1000))
    assert sorted(order) == list(range(1000)) and order[0] == 500
    tree = prefix_trie.Tree()
    for i in order:
        tree.path([i], [1])
    height = {tree.below[0]: 1}
    for v in range(1, 1001):
        for side in (tree.less[v], tree.more[v]):
            if side > 0:
                height[side] = height[v] + 1
    assert max(height.values()) == 10


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, n string"


def plain_whitening(x, k):
    n, s = len(x), x.sum(0)
    a = (n * x - s) / n
    _, singular, right = np.linalg.svd(a, full_matrices=False)
    return (a @ right[:k].T) / (singular[:k] / np.sqrt(n)), (singular**2 / (singular**2).sum())[:k], ((n * x - s) ** 2).sum(1)


def whitened(spark, rows, components=8):
    ints = whitening.integers(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding")
    model = whitening.fit(ints, components)
    return model, whitening.whiten(ints, model, "vec_id").orderBy("vec_id", "component").collect()


def test_whitening_equals_svd(spark):
    prepare(spark)
    rng = np.random.default_rng(0)
    vectors = (rng.normal(0, 1, (400, 12)) * np.linspace(0.02, 3, 12) + rng.normal(0, 1, 12)).astype(np.float32)
    vectors[100:230] = vectors[99]  # a third are copies
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(900, None, None), (901, [], None), (902, [None] * 12, None), (903, [float("nan")] * 12, None), (904, [float("inf")] * 12, None), (905, [1.0], None)]
    model, got = whitened(spark, rows)
    want, explained, deviation = plain_whitening(np.floor(1024 * vectors.astype(float)).astype(np.int64) + 100_000, 8)
    w = np.array([r.whitened for r in got]).reshape(400, 8)
    np.testing.assert_allclose(w * np.sign((w * want).sum(0)), want, atol=1e-9)
    np.testing.assert_allclose([r.explained for r in got[:8]], explained, rtol=1e-10)
    assert [r.deviation for r in got[::8]] == deviation.tolist() and {r.n for r in got} == {400}
    assert model.identity_error < 1e-9 and [r.component for r in got[:8]] == list(range(1, 9)) and model.passes >= 3


def test_ill_conditioned_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, (300, 6))
    vectors = base * [1e6, 1e4, 10, 1, 1e-1, 1e-2]
    vectors[:, 5] = vectors[:, 0] * 0.25 + rng.normal(0, 0.01, 300)
    model, got = whitened(spark, [(i, v.astype(np.float32).tolist(), None) for i, v in enumerate(vectors)])
    want, explained, _ = plain_whitening(np.floor(1024 * vectors.astype(np.float32).astype(float)).astype(np.int64) + 100_000, 6)
    w = np.array([r.whitened for r in got]).reshape(300, 6)
    np.testing.assert_allclose(w * np.sign((w * want).sum(0)), want, atol=1e-6)
    assert model.identity_error < 1e-4


def test_rows_that_do_not_span_all_dimensions(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0, 1.0], None) for i in range(10)]
    model, got = whitened(spark, rows)
    assert sum(r.whitened is not None for r in got) == 10 and model.identity_error < 1e-4
    first = [r for r in got if r.component == 1]
    np.testing.assert_allclose([abs(r.whitened) for r in first], np.abs((np.arange(10) - 4.5) / np.arange(10).std()), rtol=1e-9)
    assert first[0].explained == pytest.approx(1)
    _, one = whitened(spark, [(1, [3.0, 4.0], None), (2, [3.0, 4.0], None)])
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in one)
    assert whitened(spark, [])[1] == [] and whitened(spark, [(1, None, None)])[1] == []


def test_deviations_beyond_a_long_are_null(spark):
    _, got = whitened(spark, [(1, [3e12], None), (2, [-3e12], None), (3, [1.0], None)], 1)
    assert got[0].deviation is None and got[2].whitened is not None


def test_key_with_the_name_of_an_output(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (None, [0.0, 2.0]), (3, [5.0, 1.0])], "n long, v array<double>")
    ints = whitening.integers(rows, "n", "v")
    got = whitening.whiten(ints, whitening.fit(ints), "n")
    assert got.columns[:3] == ["n", "component", "_n"] and {r.n for r in got.collect()} == {1, None, 3}


# ---------------------------------------------------------------- neighbours


def plain_neighbours(rows, every, k):
    out = []
    for q, vq in rows:
        if q % every == 0:
            away = []
            for i, (c, vc) in enumerate(rows):
                if (c, vc) != (q, vq):
                    away.append((float(np.sqrt(np.add.reduce((np.array(vc) - np.array(vq)) ** 2))), c))
            out += [(q, i + 1, c, round(d, 9)) for i, (d, c) in enumerate(sorted(away)[:k])]
    return out


def neighbours(df, every, k=10):
    found = collision_search.nearest(df, "vec_id", "embedding", F.col("vec_id") % every == 0, k)
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found.collect())


def test_neighbours_with_copies_and_ties(spark):
    """Few components on a grid: many equal distances, and a third of the rows are one vector."""
    prepare(spark)
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(1, 5)) for _ in range(3)]) for i in range(300)]
    for i in range(0, 300, 3):
        rows[i] = (i, [2.0, 2.0, 2.0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert neighbours(df, 15) == sorted(plain_neighbours(rows, 15, 10))


def test_recall_over_several_shards_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(collision_search, "SAMPLE", 200)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (30, 24))
    vectors = centres[rng.integers(0, 30, 4000)] + rng.normal(0, 0.4, (4000, 24))
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = neighbours(df, 100)
    want = plain_neighbours(rows, 100, 10)
    assert len(got) == 400 and len(set(got) & set(want)) >= 0.97 * len(want)


def test_queries_are_sent_in_parts_and_not_once_a_shard(spark, monkeypatch):
    """What a search broadcasts is a part of the queries, however many shards read it; the parts together find all."""
    prepare(spark)
    rng = np.random.default_rng(11)
    vectors = (rng.normal(0, 1, (12, 8))[rng.integers(0, 12, 600)] + rng.normal(0, 0.3, (600, 8))).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    plans, settle = [], collision_search.settle

    def seen(table):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        plans.extend([plan] if "MapInArrow search" in plan else [])
        return settle(table)

    monkeypatch.setattr(collision_search, "settle", seen)
    monkeypatch.setattr(collision_search, "SHARD_ROWS", 100)
    monkeypatch.setattr(collision_search, "SENT", 25 * 8 * 8, raising=False)
    got, want = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10), plain_neighbours(rows, 10, 10)
    assert len(got) == 600 and len(set(got) & set(want)) >= 0.97 * len(want)
    assert not any("explode" in plan for plan in plans), "a copy of the queries for each shard"
    assert len(plans) >= 3


def test_few_rows_of_the_sample_reach_the_driver(spark, monkeypatch):
    monkeypatch.setattr(collision_search, "SAMPLE", 100)
    groups, order = spark.range(40_000, numPartitions=40).withColumnRenamed("id", "node"), F.xxhash64("node", F.lit("sample"))
    few = collision_search.thinned(groups, 40_000)
    assert 100 <= few.count() <= 300
    assert few.orderBy(order).limit(100).collect() == groups.orderBy(order).limit(100).collect()
    assert collision_search.thinned(groups.where("node < 120"), 120).count() == 120


def test_fewer_rows_than_neighbours_and_rows_that_take_no_part(spark):
    schema = "vec_id long, embedding array<double>, rank int"
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (0, [1.0, 0.0], 2), (2, None, 1), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (None, [1.0, 1.0], 1), (6, [1.0], 1), (7, [], 1)]
    assert neighbours(spark.createDataFrame(rows, schema), 5) == [(0, 1, 0, 0.0), (0, 2, 1, 0.5)]
    assert neighbours(spark.createDataFrame(rows[:1], schema), 5) == []
    assert neighbours(spark.createDataFrame([], schema), 5) == []


def test_threshold_bounds_the_misses():
    rng = np.random.default_rng(7)
    collisions = (np.abs(rng.normal(0, 1, (20_000, collision_search.PROJECTIONS))) <= collision_search.WIDTH).sum(1)
    assert (collisions < collision_search.threshold()).mean() < 3 * collision_search.MISS
    assert collision_search.threshold(miss=0.2) > collision_search.threshold(miss=0.01) > 64
