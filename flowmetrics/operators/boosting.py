"""Gradient boosting on histograms, for all folds at once, with trees grown leaf by leaf.

A row's features become bins of about equal weight (``binned``), so that rows with the same bins always get the same
prediction. Rows with equal bins in a fold's training set become one cell with their number and target sum, which is all
that squared loss needs. ``boost`` keeps the trees of all folds on the driver and the cells in a settled table: a job sends
every cell down the trees, adds up count and gradient per (fold, node, feature, bin), and the driver reads off the best
split of every node. A tree grows best first: the leaf with the largest gain is split until there are ``leaves`` of them. A
job counts the children of every leaf that may still be split, for all folds, so a tree needs about as many jobs as it is
deep. Every ``SETTLED_ROUNDS`` trees the cells are written with their predictions, so no job evaluates more trees than that.
Cells below a checked bound take the same steps in one task a fold, as a few thousand cells are not worth a job a level.

What reaches the driver is bounded by folds x nodes x features x ``BINS`` sums, whatever the number of rows. Sums are
compared up to a relative 1e-9, so that their order plays no part in a choice: the first feature and the smallest bin win ties.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmetrics.operators.order_stats import positions, value_counts
from flowmetrics.schemas import quoted
from flowmetrics.session import settle

BINS = 255
SETTLED_ROUNDS = 10
CELLS_PER_TASK = 200_000
CLOSE = 1e-9


def binned(df: DataFrame, by: Sequence[str], col: str, weight: str | None = None) -> DataFrame:
    """``by, _v, bin``: each distinct value's bin within its group, the share of weight below it in steps of 1 / ``BINS``.

    Missing values have bin 0, as the smallest ones.
    """
    placed = positions(value_counts(df, by, [col], weight))
    bins = F.least(F.lit(BINS - 1), F.floor(F.try_divide(F.col("_before") * BINS, F.col("_total")))).cast("int")
    return placed.select(*[F.col(f"_k.k{i}").alias(c) for i, c in enumerate(by)], "_v", F.coalesce(bins, F.lit(0)).alias("bin"))


@dataclass
class Node:
    count: float = 0.0
    gradient: float = 0.0
    gain: float | None = None
    feature: int = 0
    bin: int = 0
    children: tuple[int, int] | None = None
    known: bool = False


@dataclass
class Tree:
    """Nodes in order of creation. ``split`` nodes belong to the tree; children of others were only looked at."""

    nodes: list[Node] = field(default_factory=lambda: [Node()])
    split: list[int] = field(default_factory=list)

    def leaves(self) -> list[int]:
        inner, found = set(self.split), [0]
        for i in self.split:
            found += self.nodes[i].children
        return [i for i in found if i not in inner]

    def route(self, bins: np.ndarray, inner: set[int] | None = None) -> np.ndarray:
        """The node that each row of ``bins`` ends in, going through ``inner`` nodes (by default all with children)."""
        at = np.zeros(len(bins), np.int64)
        for i, node in enumerate(self.nodes):
            if node.children and (inner is None or i in inner):
                here = at == i
                right = bins[:, node.feature] > node.bin
                at[here & ~right] = node.children[0]
                at[here & right] = node.children[1]
        return at


def best_split(counts: np.ndarray, gradients: np.ndarray, least: int) -> tuple[float, int, int] | None:
    """Gain, feature and last bin of the left side from sums per (feature, bin); None if no split improves the fit."""
    n, g = counts.cumsum(1), gradients.cumsum(1)
    total_n, total_g = n[:, -1:], g[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g**2 / n + (total_g - g) ** 2 / (total_n - n) - total_g**2 / total_n
    gain[~((n >= least - 0.5) & (total_n - n >= least - 0.5))] = -np.inf
    most = gain.max()
    if not most > CLOSE * (1 + abs(total_g[0, 0])):
        return None
    feature, at = np.unravel_index(np.flatnonzero(gain.ravel() >= most * (1 - CLOSE))[0], gain.shape)
    return float(gain[feature, at]), int(feature), int(at)


def grow(tree: Tree, leaves: int) -> list[int]:
    """Split known leaves, best first, as far as possible; the nodes whose sums are wanted next (none: the tree is done)."""
    while True:
        open_leaves = tree.leaves()
        wanted = [i for i in open_leaves if not tree.nodes[i].known]
        if wanted:
            # With the leaves at hand counted, look ahead below those that may be split as well.
            break
        able = sorted((i for i in open_leaves if tree.nodes[i].gain is not None), key=lambda i: (-tree.nodes[i].gain, i))
        if len(open_leaves) >= leaves or not able:
            return []
        first = tree.nodes[able[0]]
        close = [i for i in able if tree.nodes[i].gain >= first.gain * (1 - CLOSE)]
        chosen = min(close)
        _expand(tree, chosen)
        tree.split.append(chosen)
    able = sorted((i for i in open_leaves if tree.nodes[i].known and tree.nodes[i].gain is not None), key=lambda i: -tree.nodes[i].gain)
    for i in able[: leaves - len(open_leaves)]:
        _expand(tree, i)
        wanted += [c for c in tree.nodes[i].children if not tree.nodes[c].known]
    return wanted


def _expand(tree: Tree, i: int) -> None:
    if tree.nodes[i].children is None:
        tree.nodes[i].children = (len(tree.nodes), len(tree.nodes) + 1)
        tree.nodes += [Node(), Node()]


@dataclass
class Boosted:
    """Trees of one fold, with the value of each leaf (already shrunk) by node."""

    base: float
    trees: list[tuple[Tree, dict[int, float]]] = field(default_factory=list)

    def add_up(self, bins: np.ndarray, begin: int = 0) -> np.ndarray:
        """The sum of the leaf values of the trees from ``begin`` on."""
        total = np.zeros(len(bins))
        for tree, values in self.trees[begin:]:
            table = np.zeros(len(tree.nodes))
            table[list(values)] = list(values.values())
            total += table[tree.route(bins, set(tree.split))]
        return total


def _bins(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("bins"))
    return column.flatten().to_numpy().reshape(batch.num_rows, -1)


def _histograms(model: Boosted, begin: int, tree: Tree, wanted: list[int], cells: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and gradients of one fold's ``cells`` (bins, n, s, now), each as (wanted node, feature, bin)."""
    bins, n, s, now = cells
    features = bins.shape[1]
    gradient = s - n * (now + model.add_up(bins, begin))
    place = np.full(len(tree.nodes), -1)
    place[wanted] = np.arange(len(wanted))
    at = place[tree.route(bins)]
    inside = np.flatnonzero(at >= 0)
    key = ((at[inside, None] * features + np.arange(features)) * BINS + bins[inside]).ravel()
    size = (len(wanted), features, BINS)
    total = lambda x: np.bincount(key, np.repeat(x[inside], features), len(wanted) * features * BINS).reshape(size)
    return total(n), total(gradient)


def _columns(batch: pa.RecordBatch, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    return _bins(batch)[rows], *(batch.column(c).to_numpy()[rows] for c in ("n", "s", "now"))


def _sums(cells: DataFrame, models: dict[int, Boosted], begin: int, trees: dict[int, Tree], wanted: dict[int, list[int]], features: int) -> dict:
    """Counts and gradients of the wanted nodes of every fold from one job: ``{fold: histograms}``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = batch.column(0).to_numpy()
            for m in np.unique(model).tolist():
                if wanted.get(m):
                    c, g = (x.ravel() for x in _histograms(models[m], begin, trees[m], wanted[m], _columns(batch, model == m)))
                    used = np.flatnonzero(c)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used + (m << 40), c[used], g[used])], ["key", "n", "g"])

    rows = cells.mapInArrow(part, "key long, n double, g double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).toArrow()
    key, n, g = (rows.column(c).to_numpy() for c in ("key", "n", "g"))
    out = {}
    for m, nodes in wanted.items():
        mine = key >> 40 == m
        size = (len(nodes), features, BINS)
        counts, gradients = np.zeros(size).ravel(), np.zeros(size).ravel()
        counts[key[mine] & ((1 << 40) - 1)], gradients[key[mine] & ((1 << 40) - 1)] = n[mine], g[mine]
        out[m] = counts.reshape(size), gradients.reshape(size)
    return out


def _add_tree(trees: dict[int, Tree], models: dict[int, Boosted], leaves: int, least: int, rate: float, sums) -> set[int]:
    """Grow one tree for every fold in ``trees``, counting by ``sums(trees, wanted)``; the folds that got one."""
    while wanted := {m: nodes for m, t in trees.items() if (nodes := grow(t, leaves))}:
        for m, (counts, gradients) in sums(trees, wanted).items():
            for i, c, g in zip(wanted[m], counts, gradients):
                node = trees[m].nodes[i]
                node.known, node.count, node.gradient = True, c[0].sum(), g[0].sum()
                if found := best_split(c, g, least):
                    node.gain, node.feature, node.bin = found
    grown = {m for m, tree in trees.items() if tree.split}
    for m in grown:
        tree = trees[m]
        models[m].trees.append((tree, {i: rate * tree.nodes[i].gradient / tree.nodes[i].count for i in tree.leaves()}))
    return grown


def _boost_in_tasks(cells: DataFrame, rounds: int, leaves: int, least: int, rate: float) -> dict[int, Boosted]:
    """The trees of few cells: the same steps, one task a fold, predictions kept from round to round."""

    def fit(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        m = batch.column(0)[0].as_py()
        bins, n, s, now = _columns(batch, slice(None))
        models, now = {m: Boosted(float(now[0]))}, now.copy()
        for number in range(rounds):
            sums = lambda trees, wanted: {m: _histograms(models[m], number, trees[m], wanted[m], (bins, n, s, now))}  # noqa: E731,B023
            if not _add_tree({m: Tree()}, models, leaves, least, rate, sums):
                break
            now += models[m].add_up(bins, number)
        return pa.table({"model": [m], "fitted": [pickle.dumps(models[m])]})

    rows = cells.groupBy("model").applyInArrow(fit, "model long, fitted binary").collect()
    return {r["model"]: pickle.loads(r["fitted"]) for r in sorted(rows, key=lambda r: r["model"])}


def boost(
    cells: DataFrame, features: int, rounds: int = 100, leaves: int = 8, least: int = 10, rate: float = 0.1, task_cells: int = CELLS_PER_TASK
) -> dict[int, Boosted]:
    """Boosted trees of every fold in ``cells`` (``model, bins, n, s``: bins of the features, rows and target sum).

    Starts from the mean target; a leaf's value is its mean residual times ``rate``; both sides of a split have at least
    ``least`` rows. Up to ``task_cells`` cells in all, each fold is fitted in one task, without a job for every level.
    """
    base = {r["model"]: r["s"] / r["n"] for r in cells.groupBy("model").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0").collect()}
    models = {m: Boosted(mean) for m, mean in sorted(base.items())}
    if not models:
        return models
    first = F.element_at(F.create_map(*[F.lit(x) for m, b in base.items() for x in (m, b)]), F.col("model"))
    filled = cells.where("n > 0").select("model", "bins", F.col("n").cast("double"), F.col("s").cast("double"), first.alias("now"))
    count = filled.count()
    if count <= task_cells:
        return _boost_in_tasks(filled, rounds, leaves, least, rate)
    begin, growing = 0, set(models)
    current = settle(filled.repartition(-(-count // CELLS_PER_TASK)))
    for number in range(rounds):
        growing = _add_tree({m: Tree() for m in sorted(growing)}, models, leaves, least, rate, lambda trees, wanted: _sums(current, models, begin, trees, wanted, features))  # noqa: B023
        if not growing:
            break
        if (number + 1) % SETTLED_ROUNDS == 0 and number + 1 < rounds:
            current, begin = settle(predicted(current, models, begin, "now")), number + 1
    return models


def predicted(cells: DataFrame, models: dict[int, Boosted], begin: int, out: str) -> DataFrame:
    """``cells`` with ``out``: their ``now`` plus the trees from ``begin`` on; without ``now``, plus the fold's mean."""
    columns = [f for f in cells.schema.fields if f.name != out]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns) + f", {out} double"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, bins = batch.column(0).to_numpy(), _bins(batch)
            now = batch.column("now").to_numpy().copy() if "now" in batch.schema.names else np.array([models[m].base if m in models else np.nan for m in model.tolist()], np.float64)
            for m in np.unique(model).tolist():
                if m in models:
                    now[model == m] += models[m].add_up(bins[model == m], begin)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in columns], pa.array(now, from_pandas=True)], [*[f.name for f in columns], out])

    return cells.mapInArrow(add, schema)


def cross_boosted(
    df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], target: str, folds: int, rounds: int, fold_key: str,
    encoding, out: str, leaves: int = 8, least: int = 10, rate: float = 0.1, task_cells: int = CELLS_PER_TASK,
) -> DataFrame:
    """``df`` (a settled table) with ``out``: every row's prediction by the trees fitted on the other folds' rows.

    Rows of one ``fold_key`` share a fold. Numbers are binned over all rows, which gives the trees of any fold the same
    choice of cuts; categories are target encoded by the fold's training rows (``encoding(n)`` is the weight of their own
    mean) and binned by that. NULL where no other fold has rows.
    """
    fold = F.pmod(F.xxhash64(quoted(fold_key)), F.lit(folds)).cast("long").alias("_fold")
    names = [f"_b{i}" for i in range(len(num_cols) + len(cat_cols))]
    rows = df.select("*", fold, quoted(target).cast("double").alias("_y"))
    for i, c in enumerate(num_cols):
        bins = binned(df, [], c).select("_v", F.col("bin").alias(names[i]))
        value = F.nullif(quoted(c).cast("double") + F.lit(0.0), F.lit(float("nan")))
        rows = rows.withColumn("_v", value).join(bins.withColumnRenamed("_v", "_w"), F.col("_v").eqNullSafe(F.col("_w")), "left").drop("_v", "_w")
    rows = settle(rows)
    totals = rows.groupBy("_fold").agg(F.count("_y").alias("n"), F.sum("_y").alias("s"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long")))
    prior = totals.withColumn("model", every).where("model <> _fold").groupBy("model").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("_prior"))
    with_model = rows.withColumn("model", every)
    for i, c in enumerate(cat_cols):
        name = names[len(num_cols) + i]
        parts = rows.groupBy(quoted(c).alias("_c"), "_fold").agg(F.count("_y").alias("n"), F.sum("_y").alias("s"), F.count("*").alias("all"))
        each = parts.withColumn("model", every)
        inside = F.col("model") != F.col("_fold")
        known = each.groupBy("_c", "model").agg(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(inside, F.col("s")).otherwise(0.0)).alias("s"), F.sum("all").alias("all"))
        w = encoding(F.col("n").cast("double"))
        value = F.when(F.col("n") > 0, w * F.col("s") / F.col("n") + (1 - w) * F.col("_prior")).otherwise(F.col("_prior"))
        table = settle(known.join(F.broadcast(prior), "model", "left").select("_c", "model", "all", value.alias("_e")))
        bins = binned(table, ["model"], "_e", "all").select(F.col("model").alias("_m"), F.col("_v").alias("_w"), F.col("bin").alias(name))
        encoded = table.join(bins, (F.col("model") == F.col("_m")) & F.col("_e").eqNullSafe(F.col("_w")), "left").select("_c", F.col("model").alias("_m"), F.coalesce(name, F.lit(0)).alias(name))
        with_model = with_model.join(encoded, (quoted(c).eqNullSafe(F.col("_c"))) & (F.col("model") == F.col("_m")), "left").drop("_c", "_m")
    with_model = settle(with_model.withColumn("bins", F.array(*names)))
    inside = (F.col("model") != F.col("_fold")) & F.col("_y").isNotNull()
    grouped = with_model.groupBy("model", "bins").agg(F.sum(inside.cast("double")).alias("n"), F.sum(F.when(inside, F.col("_y")).otherwise(0.0)).alias("s"))
    cells = settle(grouped)
    fitted = boost(cells, len(names), rounds, leaves, least, rate, task_cells)
    seen = predicted(cells.select("model", "bins"), fitted, 0, out)
    own = with_model.where(F.col("model") == F.col("_fold"))
    return own.join(seen, ["model", "bins"], "left").select(*[quoted(c) for c in df.columns], out)
