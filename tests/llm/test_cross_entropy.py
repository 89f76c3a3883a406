import math
import random
from collections import Counter

import pytest

from ebbtide.llm import cross_entropy
from ebbtide.llm.queries import QUERIES


def plain_scores(docs, targets):
    """Losses by the definition: for every document, both models counted anew without it."""
    texts = [(t or "").split() for _, t in docs]
    size, prior = len({w for t in texts for w in t}), cross_entropy.PRIOR
    found = {}
    for at, (i, _) in enumerate(docs):
        rest = [(j, texts[k]) for k, (j, _) in enumerate(docs) if k != at]
        models = []
        for kept in ([t for j, t in rest if j in targets], [t for _, t in rest]):
            pair = Counter(p for t in kept for p in zip(t, t[1:]))
            context = Counter()
            for (a, _), n in pair.items():
                context[a] += n
            models.append((Counter(w for t in kept for w in t), pair, context))
        total = [sum(m[0].values()) for m in models]
        loss = []
        for (single, pair, context), n in zip(models, total):
            scale = min(total) / n if n else 0
            alone = {w: (single[w] * scale + 1) / (n * scale + size) for w in texts[at]}
            of = [math.log(alone[w]) for w in texts[at][:1]] + [
                math.log((pair[a, b] * scale + prior * alone[b]) / (context[a] * scale + prior))
                for a, b in zip(texts[at], texts[at][1:])]
            loss.append(-sum(of) / len(of) if of else None)
        found[i] = loss
    return found


def test_losses_equal_the_definition(spark):
    draw = random.Random(9)
    names = ["ant", "bee", "cat", "dog", "eel", "fox"]
    docs = [(i, " ".join(draw.choices(names[i % 2:i % 2 + 5], k=draw.randrange(1, 30))))
            for i in range(120)] + [(200, None), (201, ""), (202, " \t\n"), (203, "cat " * 50_000)]
    targets = {i for i in range(120) if i % 2}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6).selectExpr(
        "*", "1 AS tokens", "'x' AS wanted")
    wanted = spark.createDataFrame([(i,) for i in targets] * 2 + [(None,)], "doc_id long")
    rows = {r.doc_id: r for r in cross_entropy.scored(frame, wanted).collect()}
    assert len(rows) == len(docs)
    for i, (target, background) in plain_scores(docs[:-4] + docs[-1:], targets).items():
        assert rows[i].target_loss == pytest.approx(target, rel=1e-4)
        assert rows[i].background_loss == pytest.approx(background, rel=1e-4)
        assert rows[i].difference == pytest.approx(target - background, abs=2e-3)
    assert all(rows[i].tokens == 0 and rows[i].difference is None for i in (200, 201, 202))
    likeness = [rows[i].difference for i in range(120)]
    assert sum(likeness[1::2]) / 60 < sum(likeness[::2]) / 60 - 0.1


def test_no_targets_repeated_ids_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b a"), (None, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    rows = cross_entropy.scored(docs, none).collect()
    assert len(rows) == 3 and all(abs(r.difference) < 1e-6 for r in rows)
    assert cross_entropy.scored(docs.where("false"), none).count() == 0


def test_query_separates_by_quality(spark, folder):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op10_cross_entropy"](spark, folder).collect()
    mean = [[r.difference for r in rows if labels.get(r.doc_id) == q] for q in (0, 1)]
    assert sum(mean[0]) / len(mean[0]) > sum(mean[1]) / len(mean[1])
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_rare_words_count_as_themselves(spark, monkeypatch):
    # 3,000 words, all beyond the commonest: documents differ in rare words alone.
    monkeypatch.setattr(cross_entropy, "BLOCK", 4000)
    draw = random.Random(3)
    common = [f"c{i}" for i in range(1100)]
    rare = [f"r{i}" for i in range(2000)]
    docs = [(i, " ".join(common)) for i in range(6)]
    docs += [(100 + i, " ".join(draw.choices(rare[i % 2::2], k=40))) for i in range(200)]
    targets = {i for i, _ in docs if i >= 100 and i % 2}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(i,) for i in targets], "doc_id long")
    rows = {r.doc_id: r for r in cross_entropy.scored(frame, wanted).collect()}
    for i, (target, background) in plain_scores(docs, targets).items():
        assert rows[i].target_loss == pytest.approx(target, rel=1e-9)
        assert rows[i].background_loss == pytest.approx(background, rel=1e-9)
    assert max(rows[i].difference for i in targets) < min(
        rows[i].difference for i, _ in docs if i >= 100 and i not in targets)


def area(low, high):
    return sum((a < b) + (a == b) / 2 for a in low for b in high) / (len(low) * len(high))


def test_being_a_target_is_not_what_the_score_says(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    half = set(random.Random(4).sample(ids, len(ids) // 2))
    rows = cross_entropy.scored(docs, spark.createDataFrame([(i,) for i in half], "doc_id long"))
    rows = [r for r in rows.collect() if r.tokens]
    inside, outside = ([r.difference for r in rows if (r.doc_id in half) == side]
                       for side in (True, False))
    assert 0.4 < area(inside, outside) < 0.6


def test_unseen_good_documents_score_like_seen_ones(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = sorted(i for i, q in labels.items() if q == 1)
    known = set(good[::2])
    rows = cross_entropy.scored(docs, spark.createDataFrame([(i,) for i in known], "doc_id long"))
    by_id = {r.doc_id: r.difference for r in rows.collect() if r.tokens}
    seen = [by_id[i] for i in good if i in known and i in by_id]
    unseen = [by_id[i] for i in good if i not in known and i in by_id]
    bad = [by_id[i] for i, q in labels.items() if q == 0 and i in by_id]
    assert 0.35 < area(seen, unseen) < 0.65
    assert area(unseen, bad) > 0.6


def test_punctuation_is_words_of_its_own(spark):
    docs = spark.createDataFrame([(1, "Ant!!  bee, «Cat»\n…"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r.text for r in cross_entropy._texts(docs).collect()}
    assert found == {1: "ant !! bee , « cat » …", 2: None}
