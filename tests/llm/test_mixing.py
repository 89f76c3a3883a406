import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ebbtide.llm import mixing
from ebbtide.llm.queries import QUERIES
from pyspark.sql import functions as F


def plain_size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(words):
    """Share by weight, stop at twice the words, reshare the excess, until none is above."""
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(words, 0.0), set(words), 1.5 * sum(words.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - 2 * words[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 2 * words[s]:
                target[s] = 2 * words[s]
                open_.discard(s)
    return target


def check_mix(rows, docs, near=0.01):
    """rows: doc_id, size, source_size, target, taken; docs: doc_id, text, source."""
    words, taken, target = Counter(), Counter(), {}
    for _, text, source in docs:
        words[source] += plain_size(text)
    source_of = {d[0]: d[2] for d in docs}
    text_of = {d[0]: d[1] for d in docs}
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in docs)
    want = plain_targets(dict(words))
    for r in rows:
        s = source_of[r.doc_id]
        assert r.size == plain_size(text_of[r.doc_id]) and r.source_size == words[s]
        assert r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        target[s] = r.target
    for s in words:
        assert abs(taken[s] - target[s]) <= max(near * target[s], 3), (s, taken[s], target[s])


def test_query_takes_what_the_targets_say(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet")
            .select("doc_id", "text", "source").collect()]
    rows = QUERIES["op3_mixing"](spark, folder).collect()
    check_mix(rows, docs, near=0.05)
    again = {r.doc_id: r for r in QUERIES["op3_mixing"](spark, folder).collect()}
    assert all(again[r.doc_id] == r for r in rows)


def test_a_hot_source_refined_cells_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 8)
    monkeypatch.setattr(mixing, "POOL", 20)
    monkeypatch.setattr(mixing, "FINER", 4)
    docs = [(i, "w " * (1 + i * 7 % 90), "hot" if i % 3 else f"s{i % 11}") for i in range(2500)]
    docs += [(9000, None, None), (9001, "", None), (9002, "a b\x0bc\x85d é", None),
             (9003, None, "empty"), (9004, "one", "\U0001f600"), (9005, "one two", "￿")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = [r for r in mixing.drawn(frame, ["doc_id"]).withColumnRenamed("id", "doc_id")
            .withColumnRenamed("words", "source_size").withColumn(
                "taken", F.expr("size * (nvl2(base, 1, 0) + nvl2(extra, 1, 0))")).collect()]
    check_mix(rows, docs)


def test_draws_are_spread_by_exact_quotas(spark):
    plan = spark.createDataFrame([(0, 700), (1, 41), (2, 0), (3, 260)], "number int, drawn long")
    rows = mixing.quotas(plan, 16, 3).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        assert r.quota >= 0
        by_source[r.number] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == {0: 700, 1: 41, 2: 0, 3: 260}
    assert set(by_shard) == set(range(16)) and max(by_shard.values()) - min(by_shard.values()) <= 2


def test_the_draws_follow_the_hypergeometric_law(spark):
    plan = spark.createDataFrame([(0, 30), (1, 50)], "number int, drawn long")
    got = [r.quota for seed in range(40) for r in mixing.quotas(plan, 2, seed)
           .where("number = 0 AND shard = 0").collect()]
    draw = np.random.default_rng(1).hypergeometric(30, 50, 40, 100_000)
    assert abs(np.mean(got) - draw.mean()) < 5 * draw.std() / len(got) ** 0.5
    assert 0.5 < np.std(got) / draw.std() < 1.6


def test_mixed_rows_keep_their_columns_and_go_to_the_shards(spark):
    docs = [(i, "word " * (i % 9), f"s{i % 4}", "x") for i in range(400)]
    docs += [(None, "a b", None, "y")] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, shard string")
    found = mixing.mixed(frame)
    assert found.columns == ["doc_id", "text", "source", "shard", "position"]
    rows, text = found.collect(), {d[0]: d[1] for d in docs}
    assert all(r.text == text[r.doc_id] and 0 <= r.shard < 16 for r in rows)
    per = defaultdict(int)
    for r in rows:
        per[r.doc_id] += 1
    assert max(n for i, n in per.items() if i is not None) == 2
    assert mixing.mixed(frame.where("false")).count() == 0
    same = mixing.repeated(frame)
    assert same.columns == frame.columns
    assert sorted(map(repr, same.collect())) == sorted(
        repr(r) for r in spark.createDataFrame(
            [(r.doc_id, r.text, r.source, "y" if r.doc_id is None else "x") for r in rows],
            frame.schema).collect())


def test_no_python_on_the_main_path(spark, folder, capsys):
    QUERIES["op3_mixing"](spark, folder).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_repeats_of_one_row_and_null_ids_come_near_the_target(spark):
    docs = [(None, "five words are in here", "a")] * 3000 + [(3, "three words here", "b")] * 3000
    docs += [(None, "w " * (1 + i % 7) + str(i), "c") for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    taken, target, shards = Counter(), {}, defaultdict(set)
    for r in mixing.drawn(frame, ["source"]).collect():
        taken[r.row.source] += r.size * ((r.base is not None) + (r.extra is not None))
        target[r.row.source] = r.target
        shards[r.row.source] |= {r.base, r.extra}
    want = plain_targets({s: sum(plain_size(d[1]) for d in docs if d[2] == s) for s in "abc"})
    for s in "abc":
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 0.01 * target[s], (s, taken[s], target[s])
        assert len(shards[s] - {None}) == 16
    assert mixing.repeated(frame).where("doc_id IS NULL AND source = 'a'").count() * 5 == taken["a"]
