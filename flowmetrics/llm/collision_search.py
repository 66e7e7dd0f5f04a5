"""Nearest neighbours by collision counting on single projections (query-aware hashing), Euclidean distance.

* Vectors that are equal become one row with their ``k + 1`` smallest ids, so copies cost one comparison.
* Index: rows are dealt by hash into shards of about ``SHARD_ROWS``; a shard is one row with its vectors and, for each of
  ``PROJECTIONS`` random directions, the order of its vectors along that direction (a sorted array). Directions come from
  a fixed seed, so they are nowhere stored.
* Search: a query with radius ``r`` collides with a vector in a direction if their projections differ by at most
  ``WIDTH * r``: a window around the query in the sorted array. Projected differences are normal with the distance as
  deviation, so a vector within ``r`` collides in each direction with at least a known probability, and in
  ``threshold()`` of them or more but for a chance of ``MISS``. Such vectors are verified by their distance.
* Virtual rehashing: a larger radius widens the same windows; only what they gain is counted. In a shard the windows grow to
  ``r`` in two steps and stop early once ``k + 1`` neighbours lie within the smaller radius. Queries that found fewer than
  ``k + 1`` within ``r`` search again with a larger one.
* The first radius is extrapolated from the distances to a sample of at most ``SAMPLE`` rows. The query's ``k + 1``-th distance in
  the sample bounds that in the whole, so the radius never exceeds it; where the sample is too small the last radius is
  infinite and every vector is verified. There is no cap on candidates.

Queries travel in blocks of at most ``BLOCK``, broadcast in parts of about ``SENT`` bytes one after the other: the driver holds
a part, whatever the number of queries and shards, and nothing is copied per shard. A task reads its shards once a part and
works on one shard and one block at a time. Only neighbours within the radius, at most ``k + 1`` a shard, leave it.

Rows whose id or vector is null, or whose vector is empty, zero, of another length than most, or has null or non-finite
components, take no part. Equal query rows (same id and vector) are one query, of which one copy is not its own
neighbour. Equal distances: smaller id first. Distances are exact for what is found; squares must not overflow.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, inf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmetrics.llm.common import parts_for
from flowmetrics.llm.vectors import matrix, usable
from flowmetrics.session import settle

PROJECTIONS, WIDTH, MISS, SEED = 128, 1.5, 0.001, 20
SHARD_ROWS, BLOCK, SAMPLE = 8_192, 2_048, 1_024
#: Bytes of query vectors that are broadcast at a time.
SENT = 16 << 20
#: Windows first grow to the radius over this; growth of the radius from round to round, and rounds before the bound.
STEP, LEAST_GROWTH, MOST_GROWTH, ROUNDS = 1.2, 1.1, 2.0, 3


def threshold(projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """The most collisions that a vector at the radius reaches with a probability of at least ``1 - miss``."""
    p, below = erf(width / sqrt(2)), 0.0
    for count in range(projections + 1):
        below += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
    return projections


def directions(d: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((d, PROJECTIONS))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; squares are added up in the order of the components."""
    difference = np.ascontiguousarray((vectors.astype(np.float64) - query.astype(np.float64)).T)
    return np.sqrt(np.add.reduce(difference * difference, axis=0))


class Shard:
    """The sorted projections of some vectors, ready for searches."""

    def __init__(self, vectors: np.ndarray, least: np.ndarray, order: np.ndarray | None = None):
        self.vectors, self.least = vectors, least
        along = vectors.astype(np.float64) @ directions(vectors.shape[1])
        self.order = np.argsort(along, axis=0, kind="stable").T if order is None else order.astype(np.int64)
        self.values = np.take_along_axis(along.T, self.order, axis=1)

    def search(self, queries: np.ndarray, radius: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query its number, rows and distances: up to ``most`` found within the radius, nearest first."""
        along = queries.astype(np.float64) @ directions(queries.shape[1])
        bounds = []
        for r in (radius / STEP, radius):
            low, high = np.empty(along.shape, np.int64), np.empty(along.shape, np.int64)
            for j, values in enumerate(self.values):
                low[:, j] = np.searchsorted(values, along[:, j] - WIDTH * r)
                high[:, j] = np.searchsorted(values, along[:, j] + WIDTH * r, side="right")
            bounds.append((r, low, high))
        wanted, size, order = threshold(), len(self.vectors), self.order
        for i, query in enumerate(queries):
            counts, left, right = np.zeros(size, np.int64), None, None
            verified, rows, away = np.zeros(size, bool), np.zeros(0, np.int64), np.zeros(0)
            for r, low, high in bounds:
                lows, highs = low[i].tolist(), high[i].tolist()
                if left is None:
                    gained = [order[j, a:b] for j, (a, b) in enumerate(zip(lows, highs))]
                else:
                    gained = [order[j, a:b] for j, (a, b) in enumerate(zip(lows, left))] + [order[j, a:b] for j, (a, b) in enumerate(zip(right, highs))]
                counts += np.bincount(np.concatenate(gained), minlength=size)
                left, right = lows, highs
                new = np.flatnonzero((counts >= wanted) & ~verified)
                verified[new] = True
                rows, away = np.concatenate([rows, new]), np.concatenate([away, distances(self.vectors[new], query)])
                if (away <= r[i]).sum() >= most:
                    break
            near = away <= r[i]
            rows, away = rows[near], away[near]
            best = np.lexsort((self.least[rows], away))[:most]
            if len(best):
                yield i, rows[best], away[best]


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """``node, v, ids`` of each distinct vector of ``rows`` (``key, v``): its ``most`` smallest ids, ascending."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("key"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    groups = few.groupBy("v").agg(F.sort_array(F.collect_list("key")).alias("ids"))
    return settle(groups.select(F.monotonically_increasing_id().alias("node"), "v", "ids"))


def index_of(groups: DataFrame) -> DataFrame:
    """``shard, nodes, least, vectors, orders``: one row a shard, all columns but the first packed."""
    shards = parts_for(groups.sparkSession, groups.count(), SHARD_ROWS)

    def packed(table: pa.Table) -> pa.Table:
        vectors = matrix(table.column("v").combine_chunks())
        least = table.column("least").to_numpy()
        order = Shard(vectors, least).order
        small = order.astype(np.uint16 if len(least) <= 1 << 16 else np.int64)
        cells = [table.column("node").to_numpy().tobytes(), least.tobytes(), vectors.astype(np.float64 if vectors.dtype.itemsize > 4 else np.float32).tobytes(), small.tobytes()]
        return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], ["shard", "nodes", "least", "vectors", "orders"])

    dealt = groups.select(F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", F.col("ids")[0].alias("least"), "v")
    index = dealt.groupBy("shard").applyInArrow(packed, "shard int, nodes binary, least binary, vectors binary, orders binary")
    return settle(index)


def thinned(groups: DataFrame, total: int) -> DataFrame:
    """Of ``total`` groups those whose hash is among the first, a little more than ``SAMPLE``: each task sends the first of what
    it reads to the driver, so that all tasks together must not read more."""
    share = (1.5 * SAMPLE + 50) / max(1, total)
    return groups.where(F.xxhash64("node", F.lit("sample")) < int((share - 0.5) * (1 << 64))) if share < 1 else groups


def first_radius(queries: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """``queries`` (``node, v``) with ``radius`` to begin with, ``bound`` that suffices, and ``growth``, the exponent by which the
    number of neighbours grows with the distance, all from a sample of the groups by hash."""
    total = groups.count()
    rows = thinned(groups, total).orderBy(F.xxhash64("node", F.lit("sample")), "node").limit(SAMPLE).select("node", "v").collect()
    sample, nodes = np.array([r["v"] for r in rows], np.float64), np.array([r["node"] for r in rows], np.int64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            radius, bound, growth = [], [], []
            for node, query in zip(batch.column(0).to_numpy(), matrix(batch.column(1)) if batch.num_rows else ()):
                away = np.sort(distances(sample, query)[nodes != node])
                last = float(away[k - 1]) if len(away) >= k else inf
                far = float(away[min(4 * k, len(away)) - 1]) if len(away) else inf
                exponent = np.log(min(4 * k, len(away)) / k) / np.log(far / last) if 0 < last < far < inf and len(away) > k else 1.0
                bound.append(last)
                growth.append(exponent)
                radius.append(last if total <= len(nodes) else min(last, 1.05 * last * (len(nodes) / total) ** (1 / exponent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.float64()) for x in (radius, bound, growth)]], ["node", "v", "radius", "bound", "growth"])

    kind = queries.schema["v"].dataType.simpleString()
    return queries.select("node", "v").mapInArrow(measure, f"node long, v {kind}, radius double, bound double, growth double")


def _round(queries: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """``query, node, least, away, rank``: up to ``most`` neighbours within its radius of each query, nearest first."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                some = batch.slice(begin, BLOCK)
                cells = [some.column(0).to_numpy().tobytes(), matrix(some.column(1), np.float64).tobytes(), some.column(2).to_numpy().tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["queries", "wanted", "radius"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda name: batch.column(batch.schema.get_field_index(name))[r].as_py()  # noqa: E731,B023
                names, least = np.frombuffer(cell("nodes"), np.int64), np.frombuffer(cell("least"), np.int64)
                asked, radius = np.frombuffer(cell("queries"), np.int64), np.frombuffer(cell("radius"), np.float64)
                wanted = np.frombuffer(cell("wanted"), np.float64).reshape(len(asked), -1)
                if held != cell("shard"):
                    raw, orders = cell("vectors"), cell("orders")
                    d = wanted.shape[1]
                    vectors = np.frombuffer(raw, np.float64 if len(raw) == 8 * d * len(names) else np.float32).reshape(-1, d)
                    order = np.frombuffer(orders, np.uint16 if len(names) <= 1 << 16 else np.int64).reshape(PROJECTIONS, -1)
                    held, shard = cell("shard"), Shard(vectors, least, order)
                found = list(shard.search(wanted, radius, most))
                if found:
                    rows, away = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
                    query = np.repeat(asked[[f[0] for f in found]], [len(f[1]) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query, names[rows], least[rows], away)], ["query", "node", "least", "away"])

    count, d = queries.agg(F.count("*"), F.max(F.size("v"))).head()
    parts = -(-count * 8 * (d or 0) // SENT) or 1
    rank = F.row_number().over(Window.partitionBy("query").orderBy("away", "least", "node"))
    found = None
    for part in range(parts):
        some = queries.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == part).select("node", "v", "radius")
        blocks = some.mapInArrow(packed, "queries binary, wanted binary, radius binary")
        # Written before the next part is sent. The planner can only guess the size of packed rows, so it is told what to broadcast.
        near = index.crossJoin(F.broadcast(blocks)).mapInArrow(search, "query long, node long, least long, away double")
        near = settle(near.withColumn("rank", rank).where(F.col("rank") <= most))
        found = near if found is None else found.unionByName(near)
    return found if parts == 1 else settle(found)


def nearest_nodes(queries: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """``query, node, away``: of each query (``node, v``) the ``k + 1`` nearest groups found, its own among them."""
    index = index_of(groups)
    waiting = settle(first_radius(queries, groups, k))
    done = None
    for turn in range(ROUNDS + 1):
        found = _round(waiting, index, k + 1)
        got = found.groupBy("query").agg(F.count("*").alias("got"))
        joined = waiting.join(got, F.col("node") == F.col("query"), "left").drop("query").withColumn("got", F.coalesce("got", F.lit(0)))
        enough = (F.col("got") > k) | (F.col("radius") >= F.col("bound"))
        ready = joined.where(enough).select(F.col("node").alias("query"))
        part = found.join(ready, "query").select("query", "node", "away")
        done = part if done is None else done.unionByName(part)
        wider = F.greatest(F.lit(LEAST_GROWTH), F.least(F.lit(MOST_GROWTH), 1.05 * F.pow(F.lit(k + 1.0) / (F.col("got") + 0.5), 1 / F.col("growth"))))
        again = F.col("bound") if turn >= ROUNDS - 1 else F.least(F.col("bound"), F.col("radius") * wider)
        waiting = settle(joined.where(~enough).select("node", "v", again.alias("radius"), "bound", "growth"))
        if waiting.isEmpty():
            break
    return done


ORACLE_SQL = """
with valid as (
    select vec_id, embedding from embeddings
    where vec_id is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
      and len(list_filter(embedding, lambda c: not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0
), pairs as (
    select q.vec_id as query_id, v.vec_id, sqrt(list_reduce(list_transform(range(1, len(v.embedding) + 1),
        lambda i: (v.embedding[i]::double - q.embedding[i]::double) * (v.embedding[i]::double - q.embedding[i]::double)), lambda a, b: a + b)) as score
    from valid q, valid v where q.vec_id % 100 = 0 and v.vec_id <> q.vec_id
)
select query_id, row_number() over (partition by query_id order by score, vec_id)::integer as rank, vec_id, score
from pairs qualify rank <= 10
"""


def nearest(rows: DataFrame, key: str, vector: str, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank`` (from 1), ``vec_id, score``: the ``k`` nearest rows found of each row where ``is_query`` (an
    expression of ``rows``' columns) holds, itself left out; all rows if there are fewer. ``key`` is a whole number."""
    named = rows.select(F.struct(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks")).alias("row"), F.col(f"`{vector}`").alias("v"))
    valid = settle(usable(named.where("row.id is not null"), "row", "v", zero=False).select(F.col("key.id").alias("key"), F.col("key.asks").alias("asks"), "v"))
    groups = distinct_vectors(valid.select("key", "v"), k + 1)
    asked = settle(valid.where("asks").select("key", "v").distinct().join(groups.select("node", "v"), "v").select(F.col("key").alias("query_id"), "node"))
    queries = groups.join(asked.select("node").distinct(), "node").select("node", "v")
    found = nearest_nodes(queries, groups, k)
    members = found.join(groups.select("node", "ids"), "node").select("query", "node", "away", F.explode("ids").alias("id"))
    order = Window.partitionBy("query").orderBy("away", "id")
    first = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = first.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "away", "id", "node"))).alias("near"))
    joined = asked.join(lists, F.col("node") == F.col("query"))
    own = F.array_position(F.transform("near", lambda x: (x["id"] == F.col("query_id")) & (x["node"] == F.col("query"))), F.lit(True))
    rest = F.filter("near", lambda x, i: i != own - 1)
    return joined.select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("at", "n")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.away").alias("score")
    )
