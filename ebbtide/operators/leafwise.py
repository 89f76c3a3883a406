"""Leaf-wise boosted trees with an L2 penalty, on second-order histograms.

Rows are cut into bins once and kept as blocks: a row of the block table holds the bins of
some ten thousand customers, their labels, weights and margins as plain buffers. One pass over
the blocks adds up gradients, hessians and rows per node, feature and bin; tasks add up their
blocks, then the sums of all tasks are added by stretches of features and searched there, and
the driver sees the best splits of each node, whatever the number of rows and bins.

A tree grows best first: of all leaves the one whose split gains most is split next, until
there are enough leaves. A split depends on its own node alone, so the nodes of a level are
searched in one pass, and the order of the gains then tells which of the splits are made. Leaf
values are Newton steps, -step * G / (H + l2).

The training blocks stay in the executors' memory, with margins beside the rows that each tree
moves on, so a pass is one short job; where one task holds them all, it grows tree after tree. Every ``FOLD`` trees all blocks are written with their
margins and taken up from there, which keeps the lineage short. Before that, one
pass over the held-out blocks gives for each of the trees since the distinct margins,
counted by label in the task; buckets over the range that the leaves allow are put in order,
and the exact area of every round follows. So no table of rows times rounds arises.

A null or NaN counts as the lowest value. Rows without a label take no part. The functions that
tasks run travel with the plan, so executors need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ebbtide.functions.plans import once
from ebbtide.operators.attribution import Node
from ebbtide.operators.boosted import ModelCorrupted, ModelNotFound
from ebbtide.operators.linear import feature_array
from ebbtide.operators.split import with_class_weight
from ebbtide.schema import FEATURE_COLUMNS, ModelConfig
from ebbtide.session import fresh_path, remove

for _module in (__name__, ModelConfig.__module__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])

#: Trees after which margins are written beside the rows.
FOLD = 25
#: Training rows of one task, unless there are more cores than that makes tasks.
LEAST_ROWS, MOST_ROWS = 50_000, 1_000_000
#: Ranges of margins that are put in order one by one.
BUCKETS = 1024
#: Nodes are numbered as in a heap, so their arrays double with each level.
MOST_DEPTH = 14
#: Gains that differ by less than this share are equal: sums come in no fixed order.
SAME = 1e-10

BLOCK = "held_out boolean, bins binary, label binary, weight binary, margin binary"


@dataclass(frozen=True)
class Tree:
    """A tree over bins, numbered as a heap from 1: children of i are 2i and 2i + 1.

    ``feature`` is -1 where a node has no children; bins up to ``cut`` go left.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    def nodes_of(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each column of ``bins`` is in after so many levels."""
        at, every = np.ones(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(levels):
            feature = self.feature[at]
            right = bins[np.maximum(feature, 0), every] > self.cut[at]
            at = np.where(feature < 0, at, 2 * at + right)
        return at

    @property
    def depth(self) -> int:
        return (len(self.feature) - 1).bit_length() - 1


@dataclass(frozen=True)
class LeafwiseModel:
    """Fitted trees, the edges of the bins they ask for, and the columns they expect."""

    trees: tuple[Tree, ...]
    edges: tuple[np.ndarray, ...]
    columns: tuple[str, ...]
    #: Log-odds before the first tree.
    start: float
    #: On held-out rows after each tree: area and mean log-loss, if there were any.
    areas: tuple[float, ...] = ()
    losses: tuple[float, ...] = ()

    def ensemble(self) -> list[tuple[float, dict[int, Node]]]:
        """The trees with thresholds instead of bins, for attributions. What the start adds to
        every score is in the values of the first tree."""
        found = []
        for number, tree in enumerate(self.trees):
            nodes, shift = {}, self.start if number == 0 else 0.0
            for i in np.flatnonzero(tree.rows):
                f = int(tree.feature[i])
                nodes[int(i)] = Node(int(i), float(tree.value[i]) + shift, float(tree.rows[i])) \
                    if f < 0 else Node(int(i), 0.0, float(tree.rows[i]), 2 * int(i), 2 * int(i) + 1,
                                       f, float(self.edges[f][tree.cut[i]]))
            # Trees are read from node 0.
            root = nodes.pop(1)
            found.append((1.0, {0: root, **nodes}))
        return found

    def score(self, frame: DataFrame) -> DataFrame:
        """Add ``logit``, the log-odds, and ``probability`` of churn to an aligned frame."""
        trees, edges, start, n = self.trees, self.edges, self.start, len(self.columns)

        @F.arrow_udf("double")
        def margin(values: pa.Array) -> pa.Array:
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, n).T
            return pa.array(_margins(trees, _binned(x, edges), np.full(len(values), start)))

        # A null inside an array counts as the lowest number, like NaN.
        values = F.transform(feature_array(self.columns), lambda v: F.coalesce(v, F.lit(float("nan"))))
        scored = frame.withColumn("logit", margin(values))
        return once(scored, {"probability": 1 / (1 + F.exp(-F.col("logit")))})


def _binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of values given by feature; a value is in the first bin whose edge it does not
    exceed, NaN in the lowest."""
    bins = np.empty(x.shape, np.uint8)
    for f, own in enumerate(edges):
        bins[f] = np.where(np.isnan(x[f]), 0, np.searchsorted(own, x[f]))
    return bins


def _margins(trees: Sequence[Tree], bins: np.ndarray, margin: np.ndarray) -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value[tree.nodes_of(bins, tree.depth)]
    return margin


def bin_edges(frame: DataFrame, columns: Sequence[str], bins: int) -> tuple[np.ndarray, ...]:
    """For each column the values that separate its bins.

    Up to ``bins`` distinct values are a bin each, with the edge half-way to the next; of
    more, quantiles are the edges. A task that sees more in a column tells just that.
    """
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * n
        for batch in batches:
            for i in range(n):
                if len(seen[i]) <= bins:
                    own = batch.column(i).to_numpy(zero_copy_only=False)
                    seen[i] = np.unique(np.concatenate((seen[i], own[~np.isnan(own)])))
        for i, own in enumerate(seen):
            if len(own):
                own = own if len(own) <= bins else [None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), i, np.int32)), pa.array(own, pa.float64())],
                    names=["column", "value"])

    numbers = frame.select(*[F.col(f"`{c}`").cast("double").alias(f"f{i}")
                             for i, c in enumerate(columns)])
    path = fresh_path(frame.sparkSession, "values")
    numbers.mapInArrow(run, "column int, value double").distinct().write.parquet(path)
    values = frame.sparkSession.read.schema("column int, value double").parquet(path)
    counts = values.groupBy("column").agg(F.count("*").alias("n"),
                                          F.bool_or(F.col("value").isNull()).alias("many"))
    found = {r["column"]: r["n"] > bins or r["many"] for r in counts.collect()}
    edges = {i: np.zeros(0) for i in range(n)}
    few = [i for i in found if not found[i]]
    # At most ``bins`` values of each.
    listed = values.where(F.col("column").isin(few)).toArrow()
    for i in few:
        own = np.sort(listed["value"].to_numpy()[listed["column"].to_numpy() == i])
        edges[i] = (own[1:] + own[:-1]) / 2
    many = [i for i in found if found[i]]
    if many:
        shares = [i / bins for i in range(1, bins)]
        cuts = numbers.approxQuantile([f"f{i}" for i in many], shares, 0.1 / bins)
        edges |= {i: np.unique(own) for i, own in zip(many, cuts)}
    remove(frame.sparkSession, path)
    return tuple(edges[i] for i in range(n))


def _blocks(frame: DataFrame, columns: Sequence[str], edges: Sequence[np.ndarray], start: float
            ) -> DataFrame:
    """The block table of a frame with ``_held_out``, ``_label`` and ``_weight``."""
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)])
            bins = _binned(x, edges)
            side, label, weight = (batch.column(n + i).to_numpy(zero_copy_only=False)
                                   for i in range(3))
            for held_out in (False, True):
                own = np.flatnonzero(side == held_out)
                if len(own):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([held_out]), *[pa.array([v.tobytes()], pa.binary()) for v in (
                            bins[:, own], label[own].astype(np.uint8),
                            weight[own].astype(np.float64), np.full(len(own), start))]],
                        names=["held_out", "bins", "label", "weight", "margin"])

    numbers = [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(columns)]
    return frame.select(*numbers, "_held_out", F.col("_label").cast("int"), "_weight").mapInArrow(
        run, BLOCK)


def _each(batches: Iterator[pa.RecordBatch], trees: Sequence[Tree], features: int
          ) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Side, bins, label, weight and margin, after the trees, of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            held_out, bins, label, weight, margin = (c[i].as_py() for c in batch.columns)
            bins = np.frombuffer(bins, np.uint8).reshape(features, -1)
            yield (held_out, bins, np.frombuffer(label, np.uint8), np.frombuffer(weight),
                   _margins(trees, bins, np.frombuffer(margin)))


def _folded(blocks: DataFrame, trees: Sequence[Tree], features: int) -> DataFrame:
    """The blocks with margins after the trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held_out, bins, label, weight, margin in _each(batches, trees, features):
            yield pa.RecordBatch.from_arrays(
                [pa.array([held_out]), *[pa.array([v.tobytes()], pa.binary())
                                         for v in (bins, label, weight, margin)]],
                names=["held_out", "bins", "label", "weight", "margin"])

    return blocks.mapInArrow(run, BLOCK)


def _kept(blocks: DataFrame, tasks: int) -> RDD:
    """Bins, label, weight and margin of every training block, in the executors' memory."""
    train = blocks.where("NOT held_out").drop("held_out")
    train = train.coalesce(1) if tasks == 1 else train.repartition(tasks)
    return train.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def _moved(block: tuple, tree: Tree, features: int) -> tuple:
    """A block with margins after one more tree."""
    bins, label, weight, margin = block
    return bins, label, weight, _margins(
        (tree,), np.frombuffer(bins, np.uint8).reshape(features, -1), np.frombuffer(margin)).tobytes()


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut: int
    #: Gradient, hessian and rows of the left and of the right child.
    left: np.ndarray
    right: np.ndarray


def _sums(blocks: Iterable[tuple], growing: Tree, level: int, nodes: Sequence[int],
          sizes: Sequence[int]) -> list[np.ndarray]:
    """For each feature gradient, hessian and rows by node and bin."""
    places = np.full(2 << level, -1)
    places[list(nodes)] = np.arange(len(nodes))
    found = [np.zeros((len(nodes), 3, size)) for size in sizes]
    for bins, label, weight, margin in blocks:
        bins = np.frombuffer(bins, np.uint8).reshape(len(sizes), -1)
        place = places[growing.nodes_of(bins, level)]
        here = np.flatnonzero(place >= 0)
        if len(here) < len(place):
            bins, place = bins[:, here], place[here]
        label, weight, margin = (np.frombuffer(v, kind)[here] for v, kind in (
            (label, np.uint8), (weight, float), (margin, float)))
        chance = 1 / (1 + np.exp(-margin))
        gradient = weight * (chance - label)
        hessian = weight * chance * (1 - chance)
        for f, size in enumerate(sizes):
            at, n = place * size + bins[f], len(nodes) * size
            for k, numbers in enumerate((gradient, hessian, None)):
                found[f][:, k] += np.bincount(at, numbers, n).reshape(-1, size)
    return found


def _candidates(nodes: Sequence[int], sums: Sequence[np.ndarray], first: int, config: ModelConfig
                ) -> list[tuple]:
    """The best split of every node by each of some features, from ``first`` on, unless another
    of them is clearly better: node, gain, feature, cut, and the sums of both sides."""
    found, most = [], {}
    for f, own in enumerate(sums, first):
        upto = np.cumsum(own, axis=2)
        whole, left = upto[:, :, -1:], upto[:, :, :-1]
        right = whole - left
        allowed = (np.minimum(left[:, 2], right[:, 2]) >= config.least_rows) \
            & (np.minimum(left[:, 1], right[:, 1]) >= config.least_hessian)
        some = np.flatnonzero(allowed.any(axis=1))
        if not len(some):
            continue
        allowed, whole, left, right = allowed[some], whole[some], left[some], right[some]
        sides = [np.divide(x[:, 0]**2, x[:, 1] + config.l2, out=np.zeros(allowed.shape), where=allowed)
                 for x in (left, right)]
        gain = np.where(allowed, sum(sides) - whole[:, 0]**2 / (whole[:, 1] + config.l2), -np.inf)
        top = gain.max(axis=1, keepdims=True)
        cuts = np.argmax(gain >= top - SAME * abs(top), axis=1)
        for i, (at, cut) in enumerate(zip(some.tolist(), cuts.tolist())):
            node, own_gain = nodes[at], float(gain[i, cut])
            most[node] = max(most.get(node, 0.0), own_gain)
            found.append((node, own_gain, f, cut, left[i, :, cut], right[i, :, cut]))
    return [x for x in found if x[1] >= most[x[0]] * (1 - SAME)]


def _best(candidates: Iterable[tuple]) -> dict[int, Split]:
    """The split of each node that gains most; of equal ones the first by feature."""
    by_node: dict[int, list[Split]] = {}
    for node, *split in candidates:
        by_node.setdefault(node, []).append(Split(*split))
    found = {}
    for node, splits in by_node.items():
        most = max(s.gain for s in splits)
        if most > 1e-12:
            found[node] = min((s for s in splits if s.gain >= most * (1 - SAME)),
                              key=lambda s: s.feature)
    return found


def level_splits(kept: RDD, growing: Tree, level: int, nodes: Sequence[int], sizes: Sequence[int],
                 config: ModelConfig) -> tuple[np.ndarray, dict[int, Split]]:
    """Gradient, hessian and rows of some nodes of a level of the growing tree together, and the
    best split of each of them that gains; of equal splits the first by feature and bin.

    Each task adds up its rows. The sums of a stretch of features meet in one task, which looks
    for the best cuts, so the driver sees a few splits per node and no sums, whatever the
    numbers of tasks and bins.
    """
    stretches = np.array_split(np.arange(len(sizes)), min(len(sizes), kept.getNumPartitions()))

    def add(blocks: Iterator[tuple]) -> Iterator[tuple[int, list[np.ndarray]]]:
        found = _sums(blocks, growing, level, nodes, sizes)
        for i, stretch in enumerate(stretches):
            yield i, [found[f] for f in stretch]

    def search(parts: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[tuple]:
        sums: dict[int, list[np.ndarray]] = {}
        for i, own in parts:
            if i in sums:
                for x, y in zip(sums[i], own):
                    x += y
            else:
                sums[i] = own
        for i, own in sums.items():
            yield own[0].sum(axis=(0, 2)) if i == 0 else None, _candidates(
                nodes, own, int(stretches[i][0]), config)

    # A few rows for each node.
    found = kept.mapPartitions(add).partitionBy(len(stretches), int).mapPartitions(search).collect()
    totals = [total for total, _ in found if total is not None]
    return totals[0], _best(x for _, candidates in found for x in candidates)


def trees_of_one_task(kept: RDD, trees: int, sizes: Sequence[int], config: ModelConfig) -> list[Tree]:
    """The next trees where all training rows are few enough for one task: nothing has to be
    exchanged between levels, so one job grows them."""
    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        own = list(blocks)

        def search(growing: Tree, level: int, nodes: Sequence[int]) -> tuple[np.ndarray, dict[int, Split]]:
            sums = _sums(own, growing, level, nodes, sizes)
            return sums[0].sum(axis=(0, 2)), _best(_candidates(nodes, sums, 0, config))

        for _ in range(trees):
            tree = grow(search, config)
            yield tree.feature, tree.cut, tree.value, tree.rows
            own = [_moved(block, tree, len(sizes)) for block in own]

    return [Tree(*parts) for parts in kept.mapPartitions(run).collect()]


def _in_turn(splits: dict[int, Split], leaves: int) -> list[int]:
    """The nodes that are split, best first, until there are enough leaves."""
    made: list[int] = []
    open_ = [(-splits[1].gain, 1)] if 1 in splits else []
    while open_ and len(made) + 1 < leaves:
        _, node = heappop(open_)
        made.append(node)
        for child in (2 * node, 2 * node + 1):
            if child in splits:
                heappush(open_, (-splits[child].gain, child))
    return made


def grow(search: Callable[[Tree, int, Sequence[int]], tuple[np.ndarray, dict[int, Split]]],
         config: ModelConfig) -> Tree:
    """One tree, best first. ``search`` gives the best splits of some nodes of a level.

    A split whose turn does not come among those known so far has none when deeper ones are known,
    too: they only come in between. So of a level only the children of splits in turn are
    searched, fewer than twice the leaves."""
    n = 2 << config.depth
    tree = Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))
    splits: dict[int, Split] = {}
    nodes, whole = [1], np.zeros(3)
    for level in range(config.depth):
        total, found = search(tree, level, nodes)
        if level == 0:
            whole = total
        splits |= found
        made = _in_turn(splits, config.leaves)
        tree.feature[:] = -1
        for node in made:
            tree.feature[node], tree.cut[node] = splits[node].feature, splits[node].cut
        nodes = [child for node in made if node >> level for child in (2 * node, 2 * node + 1)]
        if not nodes:
            break
    totals = {1: whole}
    for node in _in_turn(splits, config.leaves):
        own = splits[node]
        tree.rows[node] = totals.pop(node)[2]
        totals[2 * node], totals[2 * node + 1] = own.left, own.right
    for node, (g, h, rows) in totals.items():
        tree.value[node] = -config.step * g / (h + config.l2) if rows else 0.0
        tree.rows[node] = rows
    return tree


def areas_and_losses(blocks: DataFrame, trees: Sequence[Tree], features: int,
                     reach: Sequence[tuple[float, float]]
                     ) -> list[tuple[float | None, float | None]]:
    """Exact area under the curve and mean log-loss of the held-out blocks after each tree.

    All margins after a tree lie within its ``reach``. Tasks count the labels of each distinct
    margin; ranges of margins are put in order apart, and the ranges below one add to it as a
    whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bins, label, _, margin in _each(batches, (), features):
            for i, tree in enumerate(trees):
                margin = _margins((tree,), bins, margin)
                values, of = np.unique(margin, return_inverse=True)
                loss = np.logaddexp(0, np.where(label == 1, -margin, margin))
                low, high = reach[i]
                bucket = np.clip((values - low) // ((high - low) / BUCKETS or 1.0), 0, BUCKETS - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), i, np.int32)),
                     pa.array(bucket.astype(np.int32)), pa.array(values),
                     *[pa.array(np.bincount(of, label == side, len(values)).astype(np.int64))
                       for side in (1, 0)], pa.array(np.bincount(of, loss, len(values)))],
                    names=["tree", "bucket", "margin", "pos", "neg", "loss"])

    parts = blocks.where("held_out").mapInArrow(
        run, "tree int, bucket int, margin double, pos long, neg long, loss double")
    counts = parts.repartition("tree", "bucket").groupBy("tree", "bucket", "margin").agg(
        *[F.sum(c).alias(c) for c in ("pos", "neg", "loss")])
    inside = Window.partitionBy("tree", "bucket").orderBy("margin")
    below = counts.withColumn("below", F.sum("neg").over(inside) - F.col("neg"))
    # Twice the number of pairs in order, as whole numbers.
    twice = F.col("pos").cast("decimal(19,0)") * (2 * F.col("below") + F.col("neg")).cast("decimal(19,0)")
    rows = below.groupBy("tree", "bucket").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(twice).alias("twice"),
        F.sum("loss").alias("loss")).collect()
    found = []
    for i in range(len(trees)):
        pairs, negatives, positives, loss = 0, 0, 0, 0.0
        for r in sorted((r for r in rows if r["tree"] == i), key=lambda r: r["bucket"]):
            pairs += int(r["twice"]) + 2 * r["pos"] * negatives
            negatives, positives, loss = negatives + r["neg"], positives + r["pos"], loss + r["loss"]
        n = negatives + positives
        found.append((pairs / (2 * negatives * positives) if negatives and positives else None,
                      loss / n if n else None))
    return found


def fit(frame: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS, label: str = "Churn",
        config: ModelConfig = ModelConfig(), held_out: str | None = None) -> LeafwiseModel:
    """Fit trees with balanced class weights, as ``config`` says.

    Where the boolean column ``held_out`` is true, rows take no part in the fit; the area and
    the loss on them are taken after every tree.
    """
    if not 1 <= config.depth <= MOST_DEPTH or config.leaves < 2 or not 2 <= config.bins <= 255:
        raise ValueError(f"depth 1 to {MOST_DEPTH}, 2 leaves or more, 2 to 255 bins")
    spark = frame.sparkSession
    side = F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)
    labelled = frame.where(F.col(label).isNotNull()).select(
        *[F.col(f"`{c}`") for c in columns], F.col(label).alias("_label"), side.alias("_held_out"))
    train = labelled.where("NOT _held_out")
    # Balanced weights give both classes the same sum: the log-odds start at 0.
    start = 0.0
    weighted = with_class_weight(train, "_label", "_weight")
    edges = bin_edges(train, columns, config.bins)
    if held_out:
        weighted = weighted.unionByName(labelled.where("_held_out").withColumn("_weight", F.lit(1.0)))
    paths = [fresh_path(spark, "blocks")]
    _blocks(weighted, columns, edges, start).write.parquet(paths[0])
    blocks = spark.read.schema(BLOCK).parquet(paths[0])
    sizes, features = [len(e) + 1 for e in edges], len(columns)
    rows = blocks.where("NOT held_out").agg(F.sum(F.length("label"))).head()[0] or 0
    tasks = min(1 + rows // LEAST_ROWS, max(spark.sparkContext.defaultParallelism, 1 + rows // MOST_ROWS))
    trees: list[Tree] = []
    folded, measured, reach, low, high = 0, [], [], start, start
    kept, used = _kept(blocks, tasks), []
    while len(trees) < config.trees:
        if tasks == 1:
            made = trees_of_one_task(kept, min(FOLD, config.trees - len(trees)), sizes, config)
        else:
            made = [grow(lambda growing, level, nodes: level_splits(
                kept, growing, level, nodes, sizes, config), config)]
        for old in used:
            old.unpersist()
        used = [kept]
        for tree in made:
            leaves = tree.value[(tree.feature < 0) & (tree.rows > 0)]
            low, high = low + leaves.min(initial=0.0), high + leaves.max(initial=0.0)
            reach.append((low, high))
        trees += made
        if len(trees) - folded < FOLD and len(trees) < config.trees:
            kept = kept.map(lambda block, tree=trees[-1]: _moved(block, tree, features)).persist(
                StorageLevel.MEMORY_AND_DISK)
            continue
        if held_out:
            measured += areas_and_losses(blocks, trees[folded:], features, reach[folded:])
        if len(trees) < config.trees:
            paths.append(fresh_path(spark, "blocks"))
            _folded(blocks, trees[folded:], features).write.parquet(paths[-1])
            blocks, folded = spark.read.schema(BLOCK).parquet(paths[-1]), len(trees)
            kept = _kept(blocks, tasks)
            remove(spark, paths[-2])
    for old in used:
        old.unpersist()
    remove(spark, paths[-1])
    return LeafwiseModel(tuple(trees), edges, tuple(columns), start,
                         tuple(a for a, _ in measured), tuple(b for _, b in measured))


NODES = ("tree int, node int, feature int, cut int, threshold double, value double, rows double")


def node_table(spark: SparkSession, model: LeafwiseModel) -> DataFrame:
    """A row for every node of every tree: at most twice the leaves that were asked for."""
    rows = []
    for number, tree in enumerate(model.trees):
        for i in np.flatnonzero(tree.rows).tolist():
            f = int(tree.feature[i])
            inner = f >= 0
            rows.append((number, i, f, int(tree.cut[i]) if inner else None,
                         float(model.edges[f][tree.cut[i]]) if inner else None,
                         None if inner else float(tree.value[i]), float(tree.rows[i])))
    return spark.createDataFrame(rows, NODES)


def save(model: LeafwiseModel, path: str) -> None:
    """Write the trees and, beside them, columns, edges and what was measured, in one row."""
    spark = SparkSession.active()
    node_table(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    about = {"columns": model.columns, "start": model.start, "areas": model.areas,
             "losses": model.losses, "edges": [e.tolist() for e in model.edges],
             "size": len(model.trees[0].feature) if model.trees else 0}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> LeafwiseModel:
    """Read a saved model, telling a missing one from a broken one."""
    try:
        line = spark.read.text(f"{path}/about").head()
    except AnalysisException as missing:
        raise ModelNotFound(f"no model at {path}; run the training job first") from missing
    try:
        about = json.loads(line[0])
        edges = tuple(np.array(e, dtype=float) for e in about["edges"])
        trees: dict[int, Tree] = {}
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            n = about["size"]
            tree = trees.setdefault(r["tree"], Tree(np.full(n, -1), np.zeros(n, np.int64),
                                                    np.zeros(n), np.zeros(n)))
            tree.feature[r["node"]], tree.rows[r["node"]] = r["feature"], r["rows"]
            tree.cut[r["node"]] = r["cut"] or 0
            tree.value[r["node"]] = r["value"] or 0.0
        return LeafwiseModel(tuple(trees[i] for i in sorted(trees)), edges, tuple(about["columns"]),
                             about["start"], tuple(about["areas"]), tuple(about["losses"]))
    except Exception as problem:
        raise ModelCorrupted(f"the model at {path} cannot be read: {problem}") from problem
