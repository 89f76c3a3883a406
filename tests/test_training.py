import math
import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import attribution, boosted, clean, derive, encode, evaluate, explain, split
from ebbtide.operators.attribution import Node
from ebbtide.plans import catalog, scoring, training
from ebbtide.plans.catalog import FOREST
from ebbtide.schema import FEATURE_COLUMNS, FIELDS, ModelConfig
from ebbtide.session import fresh_path
from ebbtide.sources import generator, ledger, telco

TINY = ModelConfig(trees=3, depth=3, step=0.3)


def labelled(spark, labels):
    return spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "key long, Churn int")


def test_split_is_exact_stratified_and_reproducible(spark):
    df = labelled(spark, [int(i % 5 == 0) for i in range(1003)])
    parts = split.stratified_split(df)
    counts = {(r.Churn, r.is_train): r.n for r in parts.groupBy("Churn", "is_train").agg(F.count("*").alias("n")).collect()}
    # 201 of 1003 are positive; the test part is rounded up to 201.
    assert counts == {(1, True): 161, (1, False): 40, (0, True): 641, (0, False): 161}
    again = split.stratified_split(df.repartition(7))
    assert parts.select("key", "is_train").exceptAll(again.select("key", "is_train")).isEmpty()
    other = split.stratified_split(df, seed=7)
    assert not parts.select("key", "is_train").exceptAll(other.select("key", "is_train")).isEmpty()


def test_split_takes_the_first_hashes_of_each_class(spark):
    df = labelled(spark, [int(i % 3 == 0) for i in range(500)])
    rows = split.stratified_split(df).withColumn("h", split.split_hash(F.col("key"))).collect()
    for label in (0, 1):
        last = max(r.h for r in rows if r.Churn == label and r.is_train)
        assert all(r.h > last for r in rows if r.Churn == label and not r.is_train)


def test_copies_of_a_hot_key_stay_together(spark):
    hot = spark.range(600).select(F.lit(7).cast("long").alias("key"), F.lit(1).alias("Churn"))
    rest = labelled(spark, [i % 2 for i in range(1200)])
    sides = split.stratified_split(hot.unionByName(rest)).filter("key = 7 AND Churn = 1")
    assert sides.select("is_train").distinct().count() == 1
    assert sides.count() == 601


def test_split_of_a_single_row_class(spark):
    parts = split.stratified_split(labelled(spark, [1] + [0] * 9))
    assert parts.count() == 10 and parts.filter("is_train").count() == 8


def test_class_weights(spark):
    got = {r.label: r.weight for r in split.class_weights(labelled(spark, [0] * 6 + [1] * 2)).collect()}
    assert got == {0: 8 / 12, 1: 8 / 4}


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("slices, rows", [(1, 1), (4, 1), (None, 7), (None, 10**6)])
def test_auc_equals_the_pair_count(spark, monkeypatch, slices, rows):
    monkeypatch.setattr(evaluate, "ROWS_PER_SLICE", rows)
    rng = random.Random(5)
    pairs = [(rng.randint(0, 1), round(rng.random(), rng.choice([1, 2, 9]))) for _ in range(400)]
    df = spark.createDataFrame(pairs, "Churn int, probability double")
    row = evaluate.roc_auc(df, slices=slices).first()
    assert math.isclose(row.auc, brute_auc(pairs), abs_tol=1e-12)


def test_auc_of_one_score_and_of_one_class(spark):
    same = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "Churn int, probability double")
    assert evaluate.roc_auc(same).first().auc == 0.5
    assert evaluate.roc_auc(same.filter("Churn = 1")).first().auc is None


# --- attributions -----------------------------------------------------------------

def random_tree(rng, n_features, depth):
    nodes = {}

    def grow(at, cover, level):
        if level == depth or (level and rng.random() < 0.2):
            nodes[at] = Node(at, rng.uniform(-2, 2), cover)
            return
        left = cover * rng.uniform(0.1, 0.9)
        nodes[at] = Node(at, 0.0, cover, 2 * at + 1, 2 * at + 2, rng.randrange(n_features), rng.random())
        grow(2 * at + 1, left, level + 1)
        grow(2 * at + 2, cover - left, level + 1)

    grow(0, 100.0, 0)
    return nodes


def value_of(tree, node, x, known):
    if node.feature < 0:
        return node.value
    left, right = tree[node.left], tree[node.right]
    if node.feature in known:
        return value_of(tree, left if x[node.feature] <= node.threshold else right, x, known)
    return (left.cover * value_of(tree, left, x, known) + right.cover * value_of(tree, right, x, known)) / node.cover


def brute_phi(trees, x):
    n = len(x)
    phi = np.zeros(n)
    for weight, tree in trees:
        value = [value_of(tree, tree[0], x, {j for j in range(n) if m >> j & 1}) for m in range(1 << n)]
        for i in range(n):
            for m in range(1 << n):
                if not m >> i & 1:
                    size = bin(m).count("1")
                    share = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                    phi[i] += weight * share * (value[m | 1 << i] - value[m])
    return phi


@pytest.mark.parametrize("seed", range(4))
def test_attributions_equal_the_definition(spark, seed):
    rng = random.Random(seed)
    trees = [(rng.uniform(0.2, 1), random_tree(rng, 5, 4)) for _ in range(6)]
    paths = attribution.path_table(trees, list("abcde"))
    xs = [[rng.random() for _ in range(5)] for _ in range(30)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(xs)], "key long, a double, b double, c double, d double, e double")
    rows = attribution.explain_trees(spark, paths, df).orderBy("key").collect()
    for row, x in zip(rows, xs):
        np.testing.assert_allclose(row.phi, brute_phi(trees, x), atol=1e-12)
        total = sum(w * value_of(t, t[0], x, set(range(5))) for w, t in trees)
        assert math.isclose(sum(row.phi) + row.bias, total, abs_tol=1e-12)


@pytest.mark.parametrize("seed", range(3))
def test_deep_contributions_equal_the_definition(spark, monkeypatch, seed):
    monkeypatch.setattr(attribution, "MAX_SLOTS", 1)
    rng = random.Random(seed)
    trees = [(rng.uniform(0.2, 1), random_tree(rng, 5, 5)) for _ in range(4)]
    paths = attribution.path_table(trees, list("abcde"))
    assert paths.table is None
    xs = [[rng.random() for _ in range(5)] for _ in range(20)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(xs)], "key long, a double, b double, c double, d double, e double")
    for row, x in zip(attribution.explain_trees(spark, paths, df).orderBy("key").collect(), xs):
        np.testing.assert_allclose(row.phi, brute_phi(trees, x), atol=1e-12)


def test_twelve_levels_add_up(spark):
    rng = random.Random(12)
    names = [f"x{i}" for i in range(14)]
    trees = [(1.0, random_tree(rng, 14, 12)) for _ in range(2)]
    paths = attribution.path_table(trees, names)
    assert paths.table is None and paths.feature.shape[1] > 9
    xs = [[rng.random() for _ in names] for _ in range(12)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(xs)], "key long, " + ", ".join(f"{n} double" for n in names))
    for row, x in zip(attribution.explain_trees(spark, paths, df).orderBy("key").collect(), xs):
        total = sum(value_of(t, t[0], x, set(range(14))) for _, t in trees)
        assert math.isclose(sum(row.phi) + row.bias, total, abs_tol=1e-9)


def test_a_lone_leaf_has_no_contributions(spark):
    paths = attribution.path_table([(1.0, {0: Node(0, 0.7, 10.0)})], ["a"])
    row = attribution.explain_trees(spark, paths, spark.createDataFrame([(1.0,)], "a double")).first()
    assert row.phi == [0.0] and row.bias == 0.7


def test_large_ensembles_are_refused(monkeypatch):
    monkeypatch.setattr(attribution, "MAX_NODES", 5)
    with pytest.raises(attribution.EnsembleTooLarge):
        attribution.path_table(FOREST, FEATURE_COLUMNS)


# --- the model --------------------------------------------------------------------

@pytest.fixture(scope="module")
def fitted(spark):
    customers = generator.with_planted_churn(generator.generated(spark, 2500))
    frame = encode.features(customers, ("key", "Churn"))
    path = fresh_path(spark, "test-frame")
    frame.write.parquet(path)
    frame = spark.read.parquet(path)
    return boosted.fit(frame, config=TINY), frame


def test_tree_attributions_add_up(spark, fitted):
    model, frame = fitted
    paths = attribution.path_table(attribution.read_trees(spark, model), model.columns)
    explained = attribution.explain_trees(spark, paths, model.score(frame))
    row = explain.additivity_audit(explained).first()
    assert row.rows == 2500 and row.additive
    top = explain.importance(explained, model.columns).orderBy(F.desc("mean_size")).first()
    assert top.feature == "SatisfactionScore"


def test_staged_scores_end_at_the_model(spark, fitted):
    model, frame = fitted
    trees = attribution.read_trees(spark, model)
    staged = attribution.staged_scores(spark, trees, model.columns, frame, [1, 3])
    auc = {r["round"]: r.auc for r in evaluate.roc_auc(staged, by=["round"], slices=1).collect()}
    assert set(auc) == {1, 3}
    assert math.isclose(auc[3], evaluate.roc_auc(model.score(frame)).first().auc, abs_tol=1e-9)
    losses = boosted.losses_by_round(model, frame)
    assert len(losses) == 3 and losses[-1] < losses[0]


def test_records_carry_drivers(spark, fitted):
    model, _ = fitted
    paths = attribution.path_table(attribution.read_trees(spark, model), model.columns)
    customers = generator.generated(spark, 20, seed=3)
    rows = scoring.records(scoring.explain_scored_trees(spark, customers, model, paths)).collect()
    assert len(rows) == 20 and all(len(r.feature_importance) == 8 for r in rows)
    plain = scoring.records(scoring.score_trees(customers, model)).collect()
    assert {r.feature_importance for r in plain} == {None}
    assert {(r.key, r.churn_probability) for r in plain} == {(r.key, r.churn_probability) for r in rows}


def test_saved_models(spark, fitted, tmp_path):
    model, frame = fitted
    with pytest.raises(boosted.ModelNotFound, match="run the training job first"):
        boosted.load(spark, str(tmp_path / "nothing"))
    path = str(tmp_path / "model")
    boosted.save(model, path)
    again = boosted.load(spark, path)
    assert again.columns == FEATURE_COLUMNS
    a = model.score(frame).select("key", "probability")
    assert a.exceptAll(again.score(frame).select("key", "probability")).isEmpty()
    model.pipeline.stages[0].write().overwrite().save(f"{path}/pipeline")
    with pytest.raises(boosted.ModelCorrupted):
        boosted.load(spark, path)


def test_training_job(spark, tmp_path):
    table = telco.training_table(generator.with_planted_churn(generator.generated(spark, 1200)))
    result = training.train(spark, table, config=TINY, model_path=str(tmp_path / "m"),
                            ledger_path=str(tmp_path / "l"))
    assert (result.train_rows, result.test_rows) == (960, 240)
    assert result.auc > 0.65 and len(result.losses) == 3
    run = ledger.runs(spark, str(tmp_path / "l")).collect()
    assert [r.run_id for r in run] == [result.run_id]
    assert run[0].metrics["roc_auc"] == result.auc and run[0].params["seed"] == "42"


def test_derived_features(spark):
    ages = [0, 30, 31, 50, 51, 70, 71, 120, 121, None, -5]
    groups = ["nan", "Young", "Adult", "Adult", "Senior", "Senior", "Elderly", "Elderly", "nan", "nan", "nan"]
    df = spark.createDataFrame(
        [(i, a, i % 3, 90.0, 60.0, "Yes", "No", 1) for i, a in enumerate(ages)],
        "key long, Age long, `Tenure in Months` long, `Total Revenue` double, `Total Charges` double, "
        "`Online Security` string, `Streaming TV` string, `Premium Tech Support` long",
    )
    rows = derive.derive(df).orderBy("key").collect()
    assert [r.Age_Group for r in rows] == groups and "Age" not in rows[0].asDict()
    assert [r.Revenue_per_Tenure for r in rows[:3]] == [0.0, 90.0, 45.0]
    assert [r.Charges_per_Month for r in rows[:3]] == [0.0, 60.0, 30.0]
    assert {r.Total_Services for r in rows} == {1}


def test_rows_without_a_label_weigh_nothing(spark):
    df = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, None)], "key long, Churn int")
    assert {r.label: r.weight for r in split.class_weights(df).collect()} == {0: 0.75, 1: 1.5}
    assert {r.key: r.weight for r in split.with_class_weight(df).collect()} == {0: 1.5, 1: 0.75, 2: 0.75, 3: None}
    with pytest.raises(split.TooManyClasses):
        split.with_class_weight(spark.range(500).selectExpr("id AS Churn"))


@pytest.mark.parametrize("slices", [1, 2, 7, None])
def test_scores_that_are_no_number_are_left_out_at_any_size(spark, slices):
    rows = [(1, 0.9), (0, 0.1), (1, 0.2), (0, 0.4), (1, float("nan")), (0, float("nan")), (1, None),
            (None, 0.5)] * 3
    df = spark.createDataFrame(rows, "Churn int, probability double")
    row = evaluate.roc_auc(df, slices=slices).first()
    assert (row.positives, row.negatives, row.left_out, row.auc) == (6, 6, 12, 0.75)


def test_parity_counts_rows_of_one_side_only(spark):
    a = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (3, 1, 0)], "key long, x int, Churn int")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 1.0), (4, 1.0)], "key long, x double")
    row = clean.parity(a, b).first()
    assert (row.rows, row.rows_that_differ, row.shared_columns) == (4, 2, 1)


def test_deep_paths_by_the_definition():
    rng = np.random.default_rng(5)
    ratios = rng.uniform(0.1, 0.9, (3, 8))
    got = attribution._shapley_tables(ratios)
    assert got.shape == (3, 256, 8)
    for path, mask, slot in ((0, 0, 0), (1, 255, 3), (2, 0b10110101, 7)):
        met = [(mask >> i) & 1 for i in range(8)]
        others = [i for i in range(8) if i != slot]
        total = 0.0
        for size in range(8):
            for known in combinations(others, size):
                worth = 1.0
                for i in others:
                    worth *= met[i] if i in known else ratios[path, i]
                total += worth * factorial(size) * factorial(7 - size) / factorial(8)
        assert got[path, mask, slot] == pytest.approx((met[slot] - ratios[path, slot]) * total, abs=1e-12)


def test_a_path_table_is_bounded_by_its_bytes(monkeypatch):
    monkeypatch.setattr(attribution, "MAX_BYTES", 50)
    tree = {0: attribution.Node(0, 0.0, 4, 1, 2, 0, 0.5), 1: attribution.Node(1, 1.0, 2),
            2: attribution.Node(2, -1.0, 2)}
    with pytest.raises(attribution.EnsembleTooLarge):
        attribution.path_table([(1.0, tree)], ["x"])


def test_training_by_a_text_key_with_a_sample(spark):
    table = telco.training_table(generator.with_planted_churn(generator.generated(spark, 600)))
    named = table.withColumn("Customer ID", F.concat(F.lit("c"), "key")).drop("key").withColumn(
        "Churn", F.expr("if(`Customer ID` = 'c7', NULL, Churn)"))
    result = training.train(spark, named, "Customer ID", config=ModelConfig(trees=3), max_rows=400,
                            rounds=[1, 3])
    assert result.train_rows + result.test_rows == 400 and result.unlabelled == 1
    assert set(result.areas) == {1, 3} and len(result.losses) == 3
    assert result.areas[3] == pytest.approx(result.auc)
    assert training.some_rounds(300) == list(range(30, 301, 30)) and training.some_rounds(2) == [1, 2]


def test_a_draw_is_made_once_for_all_columns_that_ask_for_it(spark, folder):
    place = [f.name for f in FIELDS].index("Contract")
    plan = catalog._generated_features(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    drawn = generator.customers_for(spark.range(3).withColumnRenamed("id", "key")).select("Contract")
    one = drawn._jdf.queryExecution().optimizedPlan().toString()
    number = f"* {generator.multiplier(place)})"
    # Once for the column and once for the label.
    assert 0 < plan.count(number) <= 2 * one.count(number)


def test_contributions_of_no_rows_and_of_missing_values(spark):
    model_columns = FEATURE_COLUMNS[:2]
    tree = {0: Node(0, 0.0, 10, 1, 2, 0, 1.5), 1: Node(1, 1.0, 4), 2: Node(2, -1.0, 6)}
    paths = attribution.path_table([(1.0, tree)], model_columns)
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (None, 1.0)],
                               ", ".join(f"{c} double" for c in model_columns))
    assert attribution.explain_trees(spark, paths, df.limit(0)).collect() == []
    phi = [r.phi for r in attribution.explain_trees(spark, paths, df).collect()]
    assert phi[0] == pytest.approx([1.2, 0]) and phi[1] == pytest.approx([-0.8, 0])
    assert phi[2][1] == 0


def test_rows_of_a_task_of_a_fit_are_bounded(spark, monkeypatch):
    frame = encode.features(generator.with_planted_churn(generator.generated(spark, 300)), ("Churn",))
    monkeypatch.setattr(boosted, "LEAST_ROWS", 20)
    monkeypatch.setattr(boosted, "MOST_ROWS", 20)
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("bounded-fit", "trees")
    boosted.fit(frame, config=TINY)
    jobs = status.getJobIdsForGroup("bounded-fit")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [status.getStageInfo(s) for j in jobs for s in status.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) == 16
