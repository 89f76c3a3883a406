"""Exact tree attributions: how much each feature moves a score's log-odds.

A path from root to leaf asks at most ``depth`` different features for an interval.
Whether a row meets each of them is a bit mask, and the Shapley values of a path are a
fixed table over the masks. So the ensemble becomes a small table of paths, and a row
is explained by comparing, looking up and adding; nothing walks a tree per row.

The table doubles with every feature, so beyond ``MAX_SLOTS`` features on a path it gives way to
the polynomial itself: a path is the product of ``ratio + met * t`` over its features, built for
a block of rows at once, and leaving one feature out divides its factor away again. That takes
depth^2 steps a path, whatever the depth.

Shapley values over paths: Lundberg et al. 2020 (TreeSHAP); Mitchell et al. 2022.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ebbtide.functions.plans import once
from ebbtide.operators.boosted import ChurnModel, save
from ebbtide.operators.linear import feature_array
from ebbtide.session import fresh_path, remove

MAX_NODES = 200_000
#: Features on a path up to which contributions are looked up: a mask is one byte.
MAX_SLOTS = 8
#: Of the broadcast path table.
MAX_BYTES = 1 << 29
PATHS_AT_ONCE = 512


class EnsembleTooLarge(ValueError):
    """The ensemble would not fit a broadcast table."""


@dataclass(frozen=True)
class Node:
    """One tree node; ``feature`` is -1 in a leaf. Values up to ``threshold`` go left."""

    id: int
    value: float
    cover: float
    left: int = -1
    right: int = -1
    feature: int = -1
    threshold: float = 0.0


@dataclass(frozen=True)
class PathTable:
    """All paths of an ensemble, padded to the same number of features.

    A row meets slot s of a path if low < x <= high. ``table[path, mask, slot]`` is
    what the slot's feature contributes under a mask of met slots. Paths with many features
    have no table but the cover share of each slot, 1 in padding, and the value of the leaf.
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    table: np.ndarray | None
    bias: float
    columns: tuple[str, ...]
    ratio: np.ndarray | None = None
    value: np.ndarray | None = None


def _shapley_tables(ratios: np.ndarray) -> np.ndarray:
    """Contribution of each slot for every mask of met slots, for paths that ask as many
    features: ``[path, slot]`` to ``[path, mask, slot]``.

    With a set S of known features a path is worth prod(met, S) * prod(ratio, not S): known
    features keep or kill the path, unknown ones keep their cover share. Summed over all S
    of one size these products are the coefficients of prod(ratio + met * t) over the other
    slots, so the sum over all sets is a polynomial product and not an enumeration.
    """
    paths, n = ratios.shape
    met = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    weights = [factorial(size) * factorial(n - size - 1) / factorial(n) for size in range(n)]
    table = np.zeros((paths, 1 << n, n))
    for i in range(n):
        product = np.zeros((paths, 1 << n, n))
        product[:, :, 0] = 1.0
        for j in (j for j in range(n) if j != i):
            raised = product * ratios[:, j, None, None]
            raised[:, :, 1:] += product[:, :, :-1] * met[:, j, None]
            product = raised
        table[:, :, i] = (met[:, i] - ratios[:, i, None]) * (product @ np.array(weights))
    return table


def _paths(tree: dict[int, Node], weight: float) -> Iterator[tuple[dict, float, float]]:
    """(feature -> [low, high, ratio], leaf value, share of cover) of every leaf."""
    stack = [(tree[0], {}, 1.0)]
    while stack:
        node, asked, share = stack.pop()
        if node.feature < 0:
            yield asked, weight * node.value, share
            continue
        for child_id, goes_left in ((node.left, True), (node.right, False)):
            child = tree[child_id]
            ratio = child.cover / node.cover
            low, high, product = asked.get(node.feature, (-np.inf, np.inf, 1.0))
            if goes_left:
                high = min(high, node.threshold)
            else:
                low = max(low, node.threshold)
            stack.append((child, {**asked, node.feature: (low, high, product * ratio)}, share * ratio))


def path_table(
    trees: Sequence[tuple[float, dict[int, Node]]], columns: Sequence[str]
) -> PathTable:
    """Lay out an ensemble of (weight, nodes) as a path table, after checking its size."""
    if sum(len(nodes) for _, nodes in trees) > MAX_NODES:
        raise EnsembleTooLarge(f"more than {MAX_NODES} nodes")
    paths = [p for weight, nodes in trees for p in _paths(nodes, weight)]
    slots = max([len(asked) for asked, _, _ in paths] + [1])
    n = len(paths)
    deep = slots > MAX_SLOTS
    size = n * slots * (32 if deep else (8 << slots) + 24)
    if size > MAX_BYTES:
        raise EnsembleTooLarge(f"{n} paths of up to {slots} features need {size:,} bytes")
    feature = np.zeros((n, slots), dtype=np.int32)
    low = np.full((n, slots), -np.inf)
    high = np.full((n, slots), np.inf)
    ratio = np.ones((n, slots))
    bias = 0.0
    by_width: dict[int, list[int]] = {}
    for p, (asked, value, share) in enumerate(paths):
        bias += value * share
        by_width.setdefault(len(asked), []).append(p)
        for s, (f, (lo, hi, r)) in enumerate(sorted(asked.items())):
            feature[p, s], low[p, s], high[p, s], ratio[p, s] = f, lo, hi, r
    if deep:
        values = np.array([value for _, value, _ in paths])
        return PathTable(feature, low, high, None, bias, tuple(columns), ratio, values)
    table = np.zeros((n, 1 << slots, slots))
    for k, members in by_width.items():
        # Padding slots are always met, so they only repeat the table; they add nothing.
        masks = np.arange(1 << slots) & ((1 << k) - 1)
        for at in range(0, len(members), PATHS_AT_ONCE):
            some = members[at:at + PATHS_AT_ONCE]
            found = _shapley_tables(ratio[some, :k])
            values = np.array([paths[p][1] for p in some])
            table[some, :, :k] = values[:, None, None] * found[:, masks]
    return PathTable(feature, low, high, table, bias, tuple(columns))


def read_trees(spark: SparkSession, model: ChurnModel) -> list[tuple[float, dict[int, Node]]]:
    """The nodes of a fitted model, read from its saved form.

    The table has one row per node (trees * 2^depth, independent of the training data)
    and is refused above a fixed size. Scores are twice the margin on the log-odds
    scale, hence the factor 2.
    """
    path = fresh_path(spark, "model")
    save(model, path)
    weights = model.trees.treeWeights
    stored = spark.read.parquet(f"{path}/pipeline/stages/*/data").filter("nodeData is not null")
    if stored.count() > MAX_NODES:
        raise EnsembleTooLarge(f"more than {MAX_NODES} nodes")
    nodes = stored.select(
        "treeID", "nodeData.id", "nodeData.prediction",
        F.col("nodeData.impurityStats")[0].alias("cover"),
        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
    ).collect()
    remove(spark, path)
    trees: dict[int, dict[int, Node]] = {}
    for r in nodes:
        leaf = r.leftChild < 0
        trees.setdefault(r.treeID, {})[r.id] = Node(
            r.id, r.prediction, r.cover, r.leftChild, r.rightChild,
            -1 if leaf else r.featureIndex, 0.0 if leaf else r.threshold,
        )
    return [(2.0 * weights[i], trees[i]) for i in sorted(trees)]


def deep_contributions(spark: SparkSession, paths: PathTable, values: Column) -> Column:
    """``phi`` as :func:`contributions` has it, for paths of any number of features.

    Of a path's polynomial the coefficient of t^j belongs to the sets of j known features. A
    feature that a row meets has the factor ``ratio + t``: dividing it away goes from the
    highest coefficient down and multiplies errors by the ratio, below 1. One it does not meet
    has the constant factor ``ratio``.
    """
    shared = spark.sparkContext.broadcast(paths.__dict__)
    n_features = len(paths.columns)

    @F.arrow_udf("array<double>")
    def explain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from math import factorial

        import numpy as np
        import pyarrow as pa

        p = shared.value

        def block(x: np.ndarray) -> np.ndarray:
            n = len(x)
            phi = np.zeros((n_features, n))
            for feature, low, high, ratio, value in zip(
                    p["feature"], p["low"], p["high"], p["ratio"], p["value"]):
                slots = np.flatnonzero(np.isfinite(low) | np.isfinite(high))
                k = len(slots)
                own = x[:, feature[slots]].T
                met = (own > low[slots, None]) & (own <= high[slots, None])
                whole = np.zeros((k + 1, n))
                whole[0] = 1.0
                for s, r in enumerate(ratio[slots]):
                    whole[1:s + 2] = r * whole[1:s + 2] + met[s] * whole[:s + 1]
                    whole[0] *= r
                weights = [factorial(j) * factorial(k - j - 1) / factorial(k) for j in range(k)]
                # For an unmet feature -ratio times the rest is the whole with its sign changed.
                unmet = -np.tensordot(weights, whole[:k], 1)
                for s, (f, r) in enumerate(zip(feature[slots], ratio[slots])):
                    rest, total = np.zeros(n), np.zeros(n)
                    for j in range(k, 0, -1):
                        rest = whole[j] - r * rest
                        total += weights[j - 1] * rest
                    phi[f] += value * np.where(met[s], (1 - r) * total, unmet)
            return phi.T

        for batch in batches:
            x = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
            out = np.zeros(x.shape)
            for start in range(0, len(x), 4096):
                out[start:start + 4096] = block(x[start:start + 4096])
            ends = np.arange(0, out.size + 1, n_features, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return explain(values)


def contributions(spark: SparkSession, paths: PathTable, values: Column) -> Column:
    """``phi`` for an array column of feature values in the model's column order.

    Work goes by column: each distinct test of the ensemble is one comparison over all
    rows of a block, a path's mask is a few bit operations on the outcomes, and each of
    its slots one lookup and one addition. Only the value array leaves the JVM, the
    other columns stay. The helper is self-contained, so executors need nothing but
    numpy and pandas.
    """
    if paths.table is None:
        return deep_contributions(spark, paths, values)
    shared = spark.sparkContext.broadcast(paths.__dict__)
    n_features = len(paths.columns)

    @F.arrow_udf("array<double>")
    def explain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow as pa

        p = shared.value
        tests, plan = {}, []
        for feature, low, high, table in zip(p["feature"], p["low"], p["high"], p["table"]):
            slots = []
            for s in np.flatnonzero(np.isfinite(low) | np.isfinite(high)):
                f = int(feature[s])
                above, upto = (
                    tests.setdefault((f, float(edge[s])), len(tests)) if np.isfinite(edge[s]) else -1
                    for edge in (low, high)
                )
                slots.append((f, above, upto, s))
            masks = 1 << len(slots)
            plan.append([(f, i, j, table[:masks, s].copy()) for f, i, j, s in slots])

        def block(x: np.ndarray) -> np.ndarray:
            columns = np.ascontiguousarray(x.T)
            n = len(x)
            holds = np.empty((len(tests), n), dtype=np.uint8)
            for (f, edge), i in tests.items():
                np.less_equal(columns[f], edge, out=holds[i].view(bool))
            fails = holds ^ 1
            phi = np.zeros((n_features, n))
            mask, bit, share = np.empty(n, np.uint8), np.empty(n, np.uint8), np.empty(n)
            for slots in plan:
                mask[:] = 0
                for place, (_, above, upto, _) in enumerate(slots):
                    if above < 0:
                        met = holds[upto]
                    elif upto < 0:
                        met = fails[above]
                    else:
                        met = np.bitwise_and(holds[upto], fails[above], out=bit)
                    np.bitwise_or(mask, np.left_shift(met, place, out=bit), out=mask)
                for f, _, _, table in slots:
                    phi[f] += np.take(table, mask, out=share, mode="clip")
            return phi.T

        for batch in batches:
            x = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
            out = np.zeros(x.shape)
            for start in range(0, len(x), 8192):
                out[start:start + 8192] = block(x[start:start + 8192])
            ends = np.arange(0, out.size + 1, n_features, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return explain(values)


def explain_trees(spark: SparkSession, paths: PathTable, scored: DataFrame) -> DataFrame:
    """Add ``phi``, ``bias`` and ``feature_values`` to a scored frame."""
    values = feature_array(paths.columns)
    frame = once(scored, {"bias": F.lit(paths.bias), "feature_values": values})
    return frame.withColumn("phi", contributions(spark, paths, F.col("feature_values")))


def staged_scores(
    spark: SparkSession,
    trees: Sequence[tuple[float, dict[int, Node]]],
    columns: Sequence[str],
    frame: DataFrame,
    rounds: Sequence[int] | None = None,
    label: str = "Churn",
) -> DataFrame:
    """``round``, ``label`` and ``probability`` after that many trees, for every row.

    Every asked-for round repeats the rows, so ask for fewer rounds (``rounds``) over
    large frames.
    """
    wanted = list(rounds or range(1, len(trees) + 1))
    if sum(len(nodes) for _, nodes in trees) > MAX_NODES:
        raise EnsembleTooLarge(f"more than {MAX_NODES} nodes")
    leaves = []
    for number, (weight, nodes) in enumerate(trees):
        for asked, value, _ in _paths(nodes, weight):
            bounds = [(f, low, high) for f, (low, high, _) in asked.items()]
            leaves.append((number, value, bounds))
    shared = spark.sparkContext.broadcast((leaves, len(trees), wanted))

    @F.pandas_udf("array<double>")
    def margins(values: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        leaves, n_trees, wanted = shared.value
        if not len(values):
            return pd.Series([], dtype=object)
        x = np.stack(values.to_numpy())
        each = np.zeros((len(x), n_trees))
        for number, value, bounds in leaves:
            here = np.ones(len(x), dtype=bool)
            for f, low, high in bounds:
                here &= (x[:, f] > low) & (x[:, f] <= high)
            each[here, number] = value
        total = np.cumsum(each, axis=1)[:, [r - 1 for r in wanted]]
        return pd.Series(list(1.0 / (1.0 + np.exp(-total))))

    staged = frame.select(F.col(label), margins(feature_array(columns)).alias("p"))
    numbers = F.array(*[F.lit(r) for r in wanted])
    return staged.select(label, F.posexplode("p").alias("at", "probability")).select(
        F.get(numbers, F.col("at")).alias("round"), label, "probability"
    )
