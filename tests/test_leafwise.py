import math
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ebbtide.operators import attribution, leafwise
from ebbtide.operators.boosted import ModelCorrupted, ModelNotFound
from ebbtide.schema import ModelConfig
from ebbtide.session import fresh_path
from test_training import brute_auc


def plain_fit(x, y, config):
    """Best-first boosting row by row: a list of leaves (rows, value) per tree, and the
    margins after each tree."""
    n, pos = len(y), sum(y)
    weight = [n / (2 * pos) if label else n / (2 * (n - pos)) for label in y]
    margin, rounds = [0.0] * n, []
    for _ in range(config.trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [w * (a - b) for w, a, b in zip(weight, p, y)]
        h = [w * a * (1 - a) for w, a in zip(weight, p)]

        def worth(rows):
            return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + config.l2)

        def split(rows, depth):
            best = (1e-12, None, None)
            for f in range(len(x[0]) if depth < config.depth else 0):
                for v in sorted({x[i][f] for i in rows})[:-1]:
                    left = [i for i in rows if x[i][f] <= v]
                    right = [i for i in rows if x[i][f] > v]
                    if min(len(left), len(right)) < config.least_rows or min(
                            sum(h[i] for i in left), sum(h[i] for i in right)) < config.least_hessian:
                        continue
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > best[0] * (1 + 1e-10):
                        best = (gain, left, right)
            return best

        leaves = [(list(range(n)), 0, split(range(n), 0))]
        while len(leaves) < config.leaves:
            at = max(range(len(leaves)), key=lambda i: leaves[i][2][0])
            _, depth, (_, left, right) = leaves[at]
            if left is None:
                break
            leaves[at:at + 1] = [(rows, depth + 1, split(rows, depth + 1)) for rows in (left, right)]
        found = []
        for rows, _, _ in leaves:
            value = -config.step * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + config.l2)
            found.append((len(rows), value))
            for i in rows:
                margin[i] += value
        rounds.append((sorted(found), list(margin)))
    return rounds


def sample(n=240, seed=3):
    draw = random.Random(seed)
    x = [[draw.randrange(6), draw.randrange(2), round(draw.random(), 2), draw.gauss(0, 1)]
         for _ in range(n)]
    y = [int(draw.random() < 1 / (1 + math.exp(2 - a[0] + 2 * a[1] * (a[2] > .5)))) for a in x]
    return x, y


COLUMNS = ("a", "b", "c", "d")
SMALL = ModelConfig(trees=6, depth=4, leaves=7, step=0.3, l2=0.5, least_rows=8)


def frame_of(spark, x, y, held=None):
    held = held or [False] * len(y)
    rows = [(*map(float, a), b, c) for a, b, c in zip(x, y, held)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, Churn int, held boolean")


@pytest.mark.parametrize("config", [
    SMALL, ModelConfig(trees=25, depth=3, leaves=100, step=0.1, least_rows=5),
    ModelConfig(trees=3, depth=6, leaves=12, l2=0.0, least_rows=1)])
def test_leaves_equal_the_plain_version(spark, monkeypatch, config):
    monkeypatch.setattr(leafwise, "FOLD", 4)
    x, y = sample()
    model = leafwise.fit(frame_of(spark, x, y).repartition(3), COLUMNS, config=config)
    wanted = plain_fit(x, y, config)
    assert len(model.trees) == config.trees
    for tree, (leaves, _) in zip(model.trees, wanted):
        ends = np.flatnonzero((tree.feature < 0) & (tree.rows > 0))
        assert len(ends) <= config.leaves
        found = sorted((int(tree.rows[i]), float(tree.value[i])) for i in ends)
        assert [n for n, _ in found] == [n for n, _ in leaves]
        assert np.allclose([v for _, v in found], [v for _, v in leaves], rtol=0, atol=1e-9)
    scored = model.score(frame_of(spark, x, y).withColumn("key", F.monotonically_increasing_id()))
    logits = [r.logit for r in scored.orderBy("key").collect()]
    assert np.allclose(logits, wanted[-1][1], atol=1e-9)
    assert all(math.isclose(r.probability, 1 / (1 + math.exp(-r.logit))) for r in scored.collect())


def test_area_and_loss_after_every_round(spark):
    x, y = sample(400)
    held = [i % 4 == 0 for i in range(400)]
    model = leafwise.fit(frame_of(spark, x, y, held).repartition(5), COLUMNS, config=SMALL,
                         held_out="held")
    alone = leafwise.fit(frame_of(spark, x, y).where(
        F.expr("a IS NOT NULL")).limit(0).unionByName(frame_of(spark, *zip(*[
            (a, b) for a, b, h in zip(x, y, held) if not h]))), COLUMNS, config=SMALL)
    test = frame_of(spark, *zip(*[(a, b) for a, b, h in zip(x, y, held) if h]))
    assert len(model.areas) == len(model.losses) == SMALL.trees
    for n in range(1, SMALL.trees + 1):
        part = leafwise.LeafwiseModel(alone.trees[:n], alone.edges, alone.columns, alone.start)
        rows = part.score(test).collect()
        assert math.isclose(model.areas[n - 1], brute_auc([(r.Churn, round(r.logit, 12)) for r in rows]),
                            abs_tol=1e-12)
        assert math.isclose(model.losses[n - 1], np.mean([
            -math.log(r.probability if r.Churn else 1 - r.probability) for r in rows]), rel_tol=1e-9)


def test_missing_values_labels_and_one_class(spark):
    x, y = sample(120)
    frame = frame_of(spark, x, y)
    odd = frame.unionByName(frame.limit(5).withColumns({"Churn": F.lit(None).cast("int")}))
    odd = odd.withColumn("d", F.when(F.col("b") == 0, F.lit(None)).otherwise(
        F.when(F.col("a") == 1, F.lit(float("nan"))).otherwise(F.col("d"))))
    model = leafwise.fit(odd, COLUMNS, config=SMALL)
    assert model.trees[0].rows[1] == 120
    assert model.score(odd).where("logit IS NULL OR isnan(logit)").count() == 0
    single = leafwise.fit(frame.where("Churn = 1"), COLUMNS, config=ModelConfig(trees=1))
    assert (single.trees[0].feature < 0).all()
    empty = leafwise.fit(frame.limit(0), COLUMNS, config=ModelConfig(trees=1), held_out="held")
    assert empty.areas == (None,) and empty.trees[0].value.tolist() == [0.0] * 64
    for wrong in (ModelConfig(depth=99), ModelConfig(leaves=1), ModelConfig(bins=999)):
        with pytest.raises(ValueError):
            leafwise.fit(frame, COLUMNS, config=wrong)


def test_attributions_add_up_to_the_logit(spark):
    x, y = sample(200)
    frame = frame_of(spark, x, y)
    model = leafwise.fit(frame, COLUMNS, config=SMALL)
    paths = attribution.path_table(model.ensemble(), model.columns)
    rows = attribution.explain_trees(spark, paths, model.score(frame)).collect()
    assert max(abs(sum(r.phi) + r.bias - r.logit) for r in rows) < 1e-9


def test_save_and_load(spark):
    x, y = sample(150)
    frame = frame_of(spark, x, y, [i % 5 == 0 for i in range(150)])
    model = leafwise.fit(frame, COLUMNS, config=SMALL, held_out="held")
    path = fresh_path(spark, "leafwise")
    with pytest.raises(ModelNotFound):
        leafwise.load(spark, path)
    leafwise.save(model, path)
    again = leafwise.load(spark, path)
    assert again.columns == model.columns and again.areas == model.areas
    first, second = ([r.logit for r in m.score(frame).orderBy("a", "b", "c", "d").collect()]
                     for m in (model, again))
    assert first == second
    spark.createDataFrame([("{}",)], "value string").write.mode("overwrite").text(f"{path}/about")
    with pytest.raises(ModelCorrupted):
        leafwise.load(spark, path)


def test_many_values_become_quantile_bins(spark):
    df = spark.range(5000).selectExpr("cast(id AS double) AS a", "id % 3 AS b", "cast(null AS double) AS c")
    many, few, none = leafwise.bin_edges(df, ("a", "b", "c"), 50)
    assert len(many) == 49 and np.abs(np.diff(many) - 100).max() < 30
    assert few.tolist() == [0.5, 1.5] and len(none) == 0


def test_many_tasks_grow_the_trees_of_one(spark, monkeypatch):
    monkeypatch.setattr(leafwise, "FOLD", 3)
    x, y = sample(400)
    frame = frame_of(spark, x, y, [i % 5 == 0 for i in range(400)]).repartition(6)
    config = ModelConfig(trees=5, depth=6, leaves=9, step=0.3, l2=0.5, least_rows=3)
    one = leafwise.fit(frame, COLUMNS, config=config, held_out="held")
    monkeypatch.setattr(leafwise, "LEAST_ROWS", 100)
    many = leafwise.fit(frame, COLUMNS, config=config, held_out="held")
    for a, b in zip(one.trees, many.trees, strict=True):
        assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist()
        assert a.rows.tolist() == b.rows.tolist() and np.allclose(a.value, b.value, atol=1e-12)
    assert np.allclose(one.areas, many.areas) and np.allclose(one.losses, many.losses)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_few_rows_need_few_jobs(spark):
    x, y = sample(300)
    frame = frame_of(spark, x, y).cache()
    spark.sparkContext.setJobGroup("few-rows", "trees")
    leafwise.fit(frame, COLUMNS, config=ModelConfig(trees=60, depth=5, least_rows=2))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-rows")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    frame.unpersist()
    assert 0 < len(jobs) < 60


def test_only_splits_whose_turn_may_come_are_searched():
    draw, config, searched = random.Random(4), ModelConfig(depth=10, leaves=12, l2=0.0), []
    gains = {node: draw.random() for node in range(1, 1 << 10)}
    half = np.array([1.0, 2.0, 3.0])

    def search(tree, level, nodes):
        searched.append(len(nodes))
        assert all(node >> level == 1 for node in nodes)
        return 2 * half, {n: leafwise.Split(gains[n], 0, 1, half, half) for n in nodes}

    tree = leafwise.grow(search, config)
    made, open_ = set(), {1}
    while len(made) + 1 < config.leaves:
        best = max(open_, key=gains.get)
        open_ = open_ - {best} | {n for n in (2 * best, 2 * best + 1) if n in gains}
        made.add(best)
    assert set(np.flatnonzero(tree.feature >= 0)) == made
    assert max(searched) <= 2 * (config.leaves - 1) and len(searched) > 6


def test_the_driver_sees_no_sums(spark):
    """Of 40 features with 200 bins the splits that compare with the best come back."""
    draw = np.random.default_rng(5)
    bins = draw.integers(0, 200, (40, 3000)).astype(np.uint8)
    label, weight, margin = draw.integers(0, 2, 3000).astype(np.uint8), np.ones(3000), np.zeros(3000)
    rows = [tuple(np.ascontiguousarray(v[..., i::4]).tobytes() for v in (bins, label, weight, margin))
            for i in range(4)]
    blocks = spark.sparkContext.parallelize(rows, 4)
    config = ModelConfig(l2=0.5)
    empty = leafwise.Tree(np.full(64, -1), np.zeros(64, np.int64), np.zeros(64), np.zeros(64))
    total, found = leafwise.level_splits(blocks, empty, 0, [1], [200] * 40, config)
    sums = leafwise._sums(rows, empty, 0, [1], [200] * 40)
    assert total.tolist() == [sum(0.5 - label), 750.0, 3000.0]
    candidates = leafwise._candidates([1], sums, 0, config)
    assert len(candidates) == 1 and leafwise._best(candidates)[1].gain == pytest.approx(found[1].gain)
    assert (found[1].feature, found[1].cut) == candidates[0][2:4]


def test_a_search_needs_no_package_where_it_runs():
    def search(config=ModelConfig(leaves=3), grow=leafwise.grow, split=leafwise.Split):
        half = np.array([1.0, 2.0, 3.0])
        return grow(lambda *_: (2 * half, {1: split(1.0, 0, 1, half, half)}), config)

    code = "import sys, pickle; print(pickle.load(sys.stdin.buffer)().rows[1:4].tolist(), 'ebbtide' in sys.modules)"
    found = subprocess.run([sys.executable, "-I", "-c", code], input=cloudpickle.dumps(search),
                           capture_output=True, cwd="/", timeout=60)
    assert found.stdout.decode().strip() == "[6.0, 3.0, 3.0] False", found.stderr.decode()[-500:]
