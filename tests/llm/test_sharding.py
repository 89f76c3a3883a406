import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from ebbtide.llm import sharding
from ebbtide.llm.queries import QUERIES


def check_places(rows, docs):
    """Every row once, sizes and digests as defined, slots without gaps."""
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in docs)
    text = dict(docs)
    slots = defaultdict(list)
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(40))


def test_query_places_every_document(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet")
            .select("doc_id", "text").collect()]
    check_places(QUERIES["op8_sharding"](spark, folder).collect(), docs)


def test_a_third_of_all_rows_in_one_group_is_split_and_small_groups_stay(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FINE", 16)
    monkeypatch.setattr(sharding, "BIN", 700)
    monkeypatch.setattr(sharding, "CELL", 7)
    texts = ["the same words again " * 20] * 1500 + [
        f"text {i // 2} " * (1 + i // 2 % 60) for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sharding.placed(docs, ["doc_id"]).collect()
    size, slots, shard = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r.shard] += r.bytes
        slots[r.shard].append(r.slot)
        shard[texts[r.id]].add(r.shard)
    assert sum(map(len, slots.values())) == 4500
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) < 1.05 * min(size.values())
    counts = [len(s) for s in slots.values()]
    assert max(counts) < 1.2 * min(counts)
    assert all(len(s) == 1 for t, s in shard.items() if t != texts[0])
    assert len(shard[texts[0]]) > 10


def test_items_go_where_the_dot_product_is_highest():
    items = pd.DataFrame({"key": [b"a", b"b", b"c"], "piece": [0, 0, 0], "bytes": [9, 1, 5],
                          "tokens": [1, 9, 5], "rows": [1, 1, 1]})
    room = np.array([[10.0, 2.0, 3.0], [2.0, 10.0, 3.0]])
    assert sharding.pack(items, room, np.ones(3)).tolist() == [0, 1, 0]


def test_nulls_repeats_clashing_columns_and_no_rows(spark):
    rows = [(1, None, "a"), (None, "x", "b"), (None, "x", "b"), (2, "", "c"), (2, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn(
        "row", docs_column()).withColumn("bytes", docs_column())
    found = sharding.sharded(docs)
    assert found.columns == ["doc_id", "text", "row", "bytes", "shard", "slot"]
    assert sorted((r.doc_id or 0, r.text or "") for r in found.collect()) == sorted(
        (r[0] or 0, r[1] or "") for r in rows)
    assert sharding.sharded(docs.where("false")).count() == 0


def docs_column():
    from pyspark.sql import functions as F
    return F.lit("clash")


@pytest.mark.parametrize("columns", [["doc_id"], ["doc_id", "text", "extra"]])
def test_rows_of_one_null_or_repeated_id_and_text_are_cut(spark, monkeypatch, columns):
    monkeypatch.setattr(sharding, "CELL", 50)
    text = "one text for all of them"
    rows = [(None, text, i) for i in range(1500)] + [(7, text, i) for i in range(500)] + [
        (None, f"text number {i:05d} of no id", i) for i in range(500)] + [
        (i, f"text number {i:05d} with an id", i) for i in range(1000, 2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(6)
    found = sharding.placed(docs, columns).collect()
    assert len(found) == 4000
    size, slots, pairs = Counter(), defaultdict(list), Counter()
    for r in found:
        size[r.shard] += r.bytes
        slots[r.shard].append(r.slot)
        if "extra" in columns:
            pairs[r.row.doc_id, r.row.text, r.row.extra] += 1
    if "extra" in columns:
        assert pairs == Counter(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 40
    assert max(size.values()) < 1.02 * mean and min(size.values()) > 0.97 * mean
