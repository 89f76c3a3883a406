import random

import numpy as np
import pytest

from ebbtide.llm import toxicity
from ebbtide.llm.queries import QUERIES

CALM = [a + b for a in ("mor", "tel", "van", "sil", "dor", "kem", "pra", "lun") for b in
        ("an", "eth", "ing", "os", "ul", "ir", "ade")]
RUDE = ["grobnik", "schuftel", "knilchor"]


def corpus(n, seed):
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = [draw.choice(CALM) for _ in range(draw.randrange(20, 200))]
        rude, junk = i % 7 == 0, i % 5 == 0
        if rude:
            for _ in range(draw.randrange(1, 4)):
                text[draw.randrange(len(text))] = draw.choice(RUDE) + draw.choice(["", "en", "s"])
        if junk:
            text = [w + "###" for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, int(not junk), int(rude)))
    return docs, labels


@pytest.fixture(scope="module")
def planted(spark):
    docs, labels = corpus(1500, 1)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([r for r in labels if r[0] % 3], "doc_id long, quality int, toxic int")
    return frame, known, labels, toxicity.fit(frame, known)


def test_unseen_documents_are_told_apart(planted):
    docs, _, labels, chain = planted
    truth = {i: (q, t) for i, q, t in labels if i % 3 == 0}
    rows = [r for r in toxicity.scored(docs, chain).collect() if r.doc_id in truth]
    assert len(rows) == len(truth)
    assert sum(r.toxic == bool(truth[r.doc_id][1]) for r in rows) >= 0.98 * len(rows)
    assert sum((r.p_low_quality > 0.5) == (truth[r.doc_id][0] == 0) for r in rows) >= 0.98 * len(rows)


def test_each_model_sees_the_probabilities_before_it(planted):
    chain = planted[3]
    sizes = [len(chain.weights[n]) for n in toxicity.CATEGORIES]
    first = len(chain.features) + toxicity.FIGURES + 1
    assert sizes == [first, first + 1, first + 2]
    assert abs(chain.weights["toxic_low_quality"][-3:-1]).max() > 0.1


def test_newton_steps_reach_the_optimum():
    draw = np.random.default_rng(0)
    row, column = np.nonzero(draw.random((300, 6)) < 0.3)
    dense = draw.normal(size=(300, 2))
    target = (draw.random(300) < 0.4).astype(float)
    use = (np.arange(300) % 3 != 0).astype(float)
    w = toxicity.fit_linear(row, column, 6, dense, target, use)
    x = np.zeros((300, 9))
    x[row, column] = 1
    x[:, 6:8], x[:, 8] = dense, 1
    penalty = np.full(9, toxicity.PENALTY)
    penalty[-1] = 1e-6
    gradient = x.T @ (use * (1 / (1 + np.exp(-x @ w)) - target)) + penalty * w
    assert np.abs(gradient).max() < 1e-2


def test_the_sample_is_bounded_and_labels_may_repeat(spark, planted):
    docs, known, _, _ = planted
    more = known.unionAll(known).unionAll(spark.createDataFrame(
        [(None, 1, 1), (3, None, 1), (6, 1, None)], known.schema))
    rows = toxicity.sample(docs, more)
    assert rows.count() == known.count() + 2
    open_ones = {tuple(r) for r in rows.where("low_quality IS NULL OR toxic IS NULL").select(
        *toxicity.CATEGORIES).collect()}
    # What a null label leaves open is null; a good document is no toxic one of low quality.
    assert open_ones == {(None, 1, None), (0, None, 0)}
    assert toxicity.sample(docs, more, max_rows=200).count() <= 240


def test_odd_documents_and_no_labels(spark, planted):
    _, known, _, chain = planted
    rows = [(1, None), (2, ""), (None, "grobnik grobniken schuftel"), (3, "… !!"),
            (4, "grobnik schuftels " * 60_000), (5, "moran teleth"), (5, "moran teleth")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS toxic", "'x' AS p")
    found = toxicity.scored(docs, chain).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 7
    assert all(by_id[i].p_toxic == 0 for i in (1, 2, 3)) and by_id[None].toxic and by_id[4].toxic
    kept = toxicity.clean(docs, chain)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 5]
    empty = toxicity.fit(docs, known.where("false"))
    assert toxicity.clean(docs, empty).count() == 7
    assert toxicity.scored(docs.where("false"), chain).count() == 0


def test_query_over_the_whole_table(spark, folder):
    found = QUERIES["op1_toxicity"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert found.count() == docs.count() and "toxic" in found.columns


def test_rows_with_one_label_teach_what_it_says(spark, planted):
    docs, known, labels, _ = planted
    half = known.selectExpr("doc_id", "CASE WHEN toxic = 0 THEN quality END AS quality", "toxic")
    chain = toxicity.fit(docs, half)
    truth = {i: t for i, _, t in labels if i % 3 == 0}
    rows = [r for r in toxicity.scored(docs, chain).collect() if r.doc_id in truth]
    assert sum(r.toxic == bool(truth[r.doc_id]) for r in rows) >= 0.97 * len(rows)


def test_features_of_a_fold_do_not_come_from_its_labels(spark):
    # "onlyone" tells the toxic rows of fold 0 apart, "others" those of the rest.
    rows = [("onlyone" if f == 0 else "others" if t else "calm", 1.0, f, None, t, 0)
            for f in range(3) for t in (0, 1) for _ in range(20) if t or f]
    frame = spark.createDataFrame(
        rows, "text string, kept double, fold int, low_quality int, toxic int, toxic_low_quality int")
    found = toxicity.choose_features(frame)
    assert len(found) == toxicity.FOLDS + 1
    own = {h for _, h in zip(*toxicity.W.words(toxicity.pa.array(["onlyone"])))}
    assert [bool(own & set(c)) for c in found] == [False, True, True, True]
