from collections import Counter

import corpus_pipeline
from ebbtide.llm import decontaminate, simhash, toxicity
from test_mixing import plain_size, plain_targets
from test_simhash import plain_fingerprint, plain_roots, signed


def test_every_stage_does_its_work_on_what_the_one_before_kept(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        tables.append(docs.collect())
        assert docs.columns[:5] == columns
    calm, lone, own, mix, placed = tables
    # Toxicity: a subset, by the model's own verdict.
    every = spark.read.parquet(f"{folder}/documents.parquet")
    chain = toxicity.fit(every, spark.read.parquet(f"{folder}/labels.parquet"))
    verdict = {r.doc_id: r.toxic for r in toxicity.scored(every, chain).collect()}
    assert {r.doc_id for r in calm} == {i for i, bad in verdict.items() if not bad}
    assert 0 < sum(verdict.values()) < 0.2 * len(verdict)
    # Near copies: the smallest id of each group that brute force finds.
    prints = {r.doc_id: signed(plain_fingerprint(r.text)) for r in calm}
    roots = plain_roots(sorted(set(prints.values())), 3)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert sorted(r.doc_id for r in lone) == sorted(least.values())
    # Benchmark: no kept document contains an item's words, and few others went.
    items = [" " + " ".join(plain_words(r.text)) + " " for r in
             spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in lone
             if any(i in " " + " ".join(plain_words(r.text)) + " " for i in items)}
    gone = {r.doc_id for r in lone} - {r.doc_id for r in own}
    assert dirty <= gone and len(gone - dirty) <= 2
    # Mixing: whole rows, none more than twice, near the targets.
    words, taken = Counter(), Counter()
    for r in own:
        words[r.source] += plain_size(r.text)
    for r in mix:
        taken[r.source] += plain_size(r.text)
    copies = Counter(tuple(r) for r in mix)
    assert max(copies.values()) <= 2 and set(copies) <= {tuple(r) for r in own}
    for s, target in plain_targets(dict(words)).items():
        # What is missing is less than any document that could still be added.
        often = {tuple(r): copies[tuple(r)] for r in own if r.source == s}
        left = [plain_size(r[1]) for r, n in often.items() if n == min(often.values())]
        assert abs(taken[s] - target) <= min(left)
    # Sharding: the same rows.
    assert Counter(tuple(r)[:5] for r in placed) == Counter(map(tuple, mix))
    slots = Counter(r.shard for r in placed)
    assert Counter((r.shard, r.slot) for r in placed) == Counter(
        (s, i) for s, n in slots.items() for i in range(n))


def plain_words(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def test_run_is_the_stages_one_after_the_other(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns[-2:] == ["shard", "slot"] and found.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_copies", "decontamination", "mixing", "sharding"]


def test_an_empty_table_passes_through(spark, folder, tmp_path):
    from pyspark.sql import types as T
    docs = spark.createDataFrame([], T.StructType(
        spark.read.parquet(f"{folder}/documents.parquet").schema.fields))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
    assert decontaminate.GRAM == 3 and simhash.SEED == 42
