"""Prefix trie of conversations: ternary search trees over dictionary-encoded turns, one per range of sequences.

* A turn becomes a number: turns meet by a SHA-256 of role and text, so texts are read once and never shuffled
  (``turn_sequences``). A conversation is the array of its numbers.
* Equal sequences become one row with the number, the least and the hash of their conversations (``distinct_sequences``).
  Ids are joined as text per block of ``BLOCK_IDS`` ids first, and the hash reads one block after the other, so that a
  sequence shared by a third of all conversations costs a few rows and constant memory.
* Distinct sequences are range-partitioned in lexicographic order. Each shard inserts its own, medians first, into a
  ternary search tree (smaller, equal, greater turn number) and accumulates members, leaves and savings from the last
  created node to the first, without recursion (``prefix_nodes``).
* Only prefixes of a shard's first and last sequence can occur in another shard. These boundary nodes are merged by the
  hash of their prefix. Boundary paths are ranked in shard order; the nodes below a boundary node are those of its own path
  at its depth or more, and all nodes that first occur on the later paths that pass through it, so subtree sums are a sum
  along a path and a difference of running sums, in a constant number of jobs.

One conversation's turn numbers (8 bytes a turn) must fit into a task; its texts need not. Rows with a null conversation
id take no part. Null roles and texts are empty. Turns are ordered by ``turn``, null first; ties by their SHA-256.
Repeated rows are repeated turns. An empty table has no node. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmetrics.llm.common import parts_for, small
from flowmetrics.session import settle

BLOCK_IDS = 16_384
#: Turns of distinct sequences in one shard.
SHARD_TURNS = 200_000
SMALL_ROWS = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = "kind byte, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string, node binary, parent binary, weight long, low long, high long"
#: Kinds of rows that a shard returns: complete ones, complete ones below a boundary node, and boundary nodes.
INNER, ATTACHED, OPEN = 0, 1, 2


def turn_sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, ids, weights``: per conversation the numbers of its turns in order, and the code points of their texts."""
    role_of, text_of = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    said = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role_of).cast("string"), F.lit(":"), role_of, text_of), 256)).alias("said"),
        F.length(text_of).cast("long").alias("weight"),
    )
    said = settle(said)
    numbers = settle(said.select("said").distinct().select("said", F.monotonically_increasing_id().alias("id")))
    turn_of = F.struct("turn", "said", "id", "weight")
    rows = said.join(numbers, "said").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn_of)).alias("turns"))
    return rows.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.weight").alias("weights"))


def with_shared_heads(sequences: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Every conversation with its first ``h`` turns replaced by those of conversation ``c - c % group``; ``h`` is the
    CRC-32 of the decimal id modulo ``most``. All are taken where there are fewer, none where that one is absent."""
    conv = F.col("conv_id")
    heads = sequences.where(conv % group == 0).select(conv.alias("of"), *[F.slice(c, 1, most - 1).alias(f"head_{c}") for c in ("ids", "weights")])
    held = (F.crc32(conv.cast("string")) % most).cast("int")

    def rebuilt(c: str) -> Column:
        head = F.slice(F.coalesce(F.col(f"head_{c}"), F.array().cast("array<bigint>")), F.lit(1), held)
        return F.concat(head, F.slice(F.col(c), held + 1, F.size(c) + 1)).alias(c)

    return sequences.join(heads, conv - conv % group == F.col("of"), "left").select("conv_id", rebuilt("ids"), rebuilt("weights"))


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """``ids, weights, n_convs, conv_id, ends``: each distinct sequence, how many conversations have it, the least of them,
    and the SHA-256 of all of them, ascending and joined by commas."""
    block = F.floor(F.col("conv_id") / F.lit(BLOCK_IDS)).alias("block")
    key = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("key")
    decimal = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = sequences.groupBy(key, block).agg(
        decimal.alias("decimal"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("ids").alias("ids"), F.first("weights").alias("weights")
    )
    schema = "ids array<bigint>, weights array<bigint>, n_convs long, conv_id long, ends string"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, digest, rows = None, None, None, []

        def out() -> pa.RecordBatch:
            names = ["ids", "weights", "n_convs", "conv_id", "ends"]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] != key:
                    if row:
                        rows.append([*row, digest.hexdigest()])
                    key, row, digest = r["key"], [r["ids"], r["weights"], 0, r["conv_id"]], hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(r["decimal"].encode())
                row[2] += r["n_convs"]
            if rows:
                yield out()
                rows.clear()
        if row:
            rows.append([*row, digest.hexdigest()])
            yield out()

    ordered = blocks.repartition("key").sortWithinPartitions("key", "block")
    return ordered.mapInArrow(hashed, schema)


class Tree:
    """A ternary search tree of sequences of numbers. Node 0 is the root; a node is created after its parent."""

    def __init__(self):
        self.symbol, self.less, self.more, self.below = [0], [-1], [-1], [-1]
        self.up, self.depth, self.weight = [-1], [0], [0]
        self.members, self.least, self.ends = [0], [None], [None]

    def _new(self, symbol: int, weight: int, up: int) -> int:
        for column, value in ((self.symbol, symbol), (self.less, -1), (self.more, -1), (self.below, -1), (self.up, up), (self.depth, self.depth[up] + 1), (self.weight, weight), (self.members, 0), (self.least, None), (self.ends, None)):
            column.append(value)
        return len(self.symbol) - 1

    def path(self, ids: list[int], weights: list[int]) -> list[int]:
        """The nodes of all prefixes of a sequence, the root first; missing ones are created."""
        symbol, less, more, below = self.symbol, self.less, self.more, self.below
        at, nodes = 0, [0]
        for x, weight in zip(ids, weights):
            node = below[at]
            if node < 0:
                node = below[at] = self._new(x, weight, at)
            while symbol[node] != x:
                side = less if x < symbol[node] else more
                if side[node] < 0:
                    side[node] = self._new(x, weight, at)
                node = side[node]
            at = node
            nodes.append(at)
        return nodes

    def accumulate(self, open_nodes: set[int]) -> tuple[list[int], list[int], list[int]]:
        """Members and least member of every node in place; children, leaves and savings of its subtree. Of open nodes
        only what lies in complete subtrees below them counts, besides their members."""
        size = len(self.symbol)
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for v in range(size - 1, -1, -1):
            p, is_open = self.up[v], v in open_nodes
            if not is_open:
                leaves[v] += children[v] == 0
                saved[v] += (self.members[v] - 1) * self.weight[v]
            if p >= 0:
                self.members[p] += self.members[v]
                if self.least[p] is None or self.least[v] < self.least[p]:
                    self.least[p] = self.least[v]
                if not is_open:
                    children[p] += 1
                    leaves[p] += leaves[v]
                    saved[p] += saved[v]
        return children, leaves, saved


def medians_first(n: int) -> Iterator[int]:
    """0 to n - 1: the middle, the middles of both halves, and so on."""
    ranges = [(0, n)]
    for low, high in ranges:
        if low < high:
            middle = (low + high) // 2
            yield middle
            ranges += [(low, middle), (middle + 1, high)]


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of one shard's sequences, which arrive in lexicographic order."""
    table = pa.Table.from_batches(batches)
    if not table.num_rows:
        return
    ids, weights = (table.column(c).combine_chunks() for c in ("ids", "weights"))
    own = list(zip(table.column("n_convs").to_pylist(), table.column("conv_id").to_pylist(), table.column("ends").to_pylist()))
    tree = Tree()
    for i in medians_first(len(own)):
        at = tree.path(ids[i].values.to_pylist(), weights[i].values.to_pylist())[-1]
        tree.members[at], tree.least[at], tree.ends[at] = own[i]
    sides = [tree.path(ids[i].values.to_pylist(), weights[i].values.to_pylist()) for i in (0, len(own) - 1)]
    digest_of, low, high, rank = {}, {}, {}, 2 * TaskContext.get().partitionId()
    for side, nodes in enumerate(sides):
        prefix = hashlib.sha256()
        for v in nodes:
            if v:
                prefix.update(tree.symbol[v].to_bytes(8, "little", signed=True))
            digest_of[v] = prefix.digest()
            low.setdefault(v, rank + side)
            high[v] = rank + side
    children, leaves, saved = tree.accumulate(set(digest_of))
    for begin in range(0, len(tree.symbol), 20_000):
        some = range(begin, min(begin + 20_000, len(tree.symbol)))
        parent = [tree.up[v] for v in some]
        kinds = np.array([OPEN if v in digest_of else ATTACHED if p in digest_of else INNER for v, p in zip(some, parent)], np.int8)
        take = lambda column: pa.array([column[v] for v in some], pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array(kinds), take(tree.least), take(tree.depth),
            pa.array([tree.least[p] if k == INNER else None for k, p in zip(kinds, parent)], pa.int64()),
            take(tree.members), take(children), take(leaves), take(saved), pa.array([tree.ends[v] for v in some], pa.string()),
            pa.array([digest_of.get(v) for v in some], pa.binary()), pa.array([digest_of.get(p) for p in parent], pa.binary()),
            take(tree.weight), pa.array([low.get(v) for v in some], pa.int64()), pa.array([high.get(v) for v in some], pa.int64()),
        ], [c.split()[0] for c in NODES.split(", ")])


def _merged(pieces: DataFrame) -> DataFrame:
    """Boundary nodes of all shards, one row each with complete counts; ``pieces``: their parts."""
    same = [F.first(c).alias(c) for c in ("depth", "parent", "weight")]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = pieces.groupBy("node").agg(*same, *sums, F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"), F.min("low").alias("low"), F.max("high").alias("high"))
    merged = settle(merged)
    kids = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    counted = merged.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    counted = counted.withColumns({
        "n_leaves": F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0),
        "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("weight"),
    })
    down = Window.partitionBy("low").orderBy(F.desc("depth"))
    paths = settle(counted.withColumns({f"path_{c}": F.sum(c).over(down) for c in ("n_leaves", "saved")}))
    # One row per boundary path, twice the shards in number.
    upto = Window.orderBy("rank")
    ranks = paths.select(F.explode(F.array("low", "high")).alias("rank")).distinct()
    totals = paths.groupBy(F.col("low").alias("rank")).agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved")])
    running = ranks.join(totals, "rank", "left").select("rank", *[F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(c) for c in ("n_leaves", "saved")])
    running = settle(running)
    begin, end = running.select(*[F.col(c).alias(f"begin_{c}") for c in running.columns]), running.select(*[F.col(c).alias(f"end_{c}") for c in running.columns])
    spanned = paths.join(begin, F.col("low") == F.col("begin_rank")).join(end, F.col("high") == F.col("end_rank"))
    return settle(spanned.select(
        "node", "parent", "conv_id", "depth", "n_convs", "n_children", "ends",
        *[(F.col(f"path_{c}") + F.col(f"end_{c}") - F.col(f"begin_{c}")).alias(c) for c in ("n_leaves", "saved")],
    ))


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """All nodes of the trie of ``sequences`` (``conv_id, ids, weights``; conversations without turns end at the root):
    ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved`` (summed
    over the subtree, members but one times weight), ``ends_sha256``."""
    distinct = settle(distinct_sequences(sequences))
    turns = distinct.agg(F.sum(F.size("ids"))).head()[0] or 0
    shards = parts_for(distinct.sparkSession, turns, SHARD_TURNS)
    ordered = distinct.repartitionByRange(shards, "ids").sortWithinPartitions("ids")
    nodes = settle(ordered.mapInArrow(_shard, NODES))
    boundary = _merged(nodes.where(F.col("kind") == OPEN))
    above = boundary.select(F.col("node").alias("parent"), F.col("conv_id").alias("of_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    inner = nodes.where(F.col("kind") == INNER).select(*columns)
    attached = nodes.where(F.col("kind") == ATTACHED).join(small(above, SMALL_ROWS), "parent").withColumn("parent_conv_id", F.col("of_parent")).select(*columns)
    outer = boundary.join(small(above, SMALL_ROWS), "parent", "left").withColumn("parent_conv_id", F.col("of_parent")).select(*columns)
    every = inner.unionByName(attached).unionByName(outer)
    return every.select(*columns[:-1], F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


ORACLE_SQL = """
with turns as (
    select conv_id, length(coalesce(text, '')) as weight, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as said,
           row_number() over (partition by conv_id order by turn nulls first) as place
    from conversations where conv_id is not null
), own as (
    select conv_id, list(said order by place) as ids, list(weight order by place) as weights from turns group by 1
), held as (
    select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint)), lambda crc, byte:
        list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 as h
    from own
), rebuilt as (
    select c.conv_id, list_concat(coalesce(list_slice(b.ids, 1, c.h), []), list_slice(c.ids, c.h + 1, len(c.ids))) as ids,
           list_concat(coalesce(list_slice(b.weights, 1, c.h), []), list_slice(c.weights, c.h + 1, len(c.weights))) as weights
    from held c left join own b on b.conv_id = c.conv_id - c.conv_id % 100
), prefixes as (
    select conv_id, depth, list_slice(ids, 1, depth) as node, coalesce(weights[depth], 0) as weight, depth = len(ids) as ends
    from (select *, unnest(range(0, len(ids) + 1)) as depth from rebuilt)
), nodes as (
    select node, depth, any_value(weight) as weight, min(conv_id) as conv_id, count(*) as n_convs,
           sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
    from prefixes group by 1, 2
), kids as (
    select list_slice(node, 1, depth - 1) as node, count(*) as n_children from nodes where depth > 0 group by 1
), full_nodes as (
    select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k using (node)
), sums as (
    select list_slice(node, 1, above) as node, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * weight)::bigint as saved_tokens
    from (select *, unnest(range(0, depth + 1)) as above from full_nodes) group by 1
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from full_nodes n join sums s using (node) left join nodes p on n.depth > 0 and p.node = list_slice(n.node, 1, n.depth - 1)
"""
