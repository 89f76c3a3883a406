import random
import re
from itertools import permutations

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from checks.run_queries import compare
from ebbtide.llm import interactions
from ebbtide.llm.oracles import ORACLES
from ebbtide.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """The audit by its definition, document by document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    marked = []
    for i, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text
                                       for j, t, *_ in docs)}
        marked.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    rows = []
    for part in {m[0] for m in marked}:
        own = [m[1:] for m in marked if m[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before, upto = set(order[:step]), set(order[:step + 1])
                removed = [m for m in own if f in m[0] and not m[0] & before]
                shapley[f] += len(removed)
                rows.append([part, "".join(order), step + 1, sum(not m[0] & upto for m in own),
                             len(removed), sum(f in m[0] and bool(m[0] & before) for m in own),
                             sum(m[0] == {f} for m in own), sum(m[1] for m in removed),
                             sum(m[2] for m in removed)])
        rows = [[*r, shapley[r[1][r[2] - 1]]] if r[0] == part else r for r in rows]
    return sorted(tuple(r) for r in rows)


def test_query_equals_its_sql(spark, folder):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES["op11_filter_audit"](spark, folder)
    cursor = con.execute(ORACLES["op11_filter_audit"])
    names = [d[0] for d in cursor.description]
    assert compare((df.columns, [tuple(r) for r in df.collect()]), (names, cursor.fetchall())) is None


@pytest.mark.parametrize("bits", [2, 16])
def test_odd_rows(spark, documents, monkeypatch, bits):
    monkeypatch.setattr(interactions, "BITS", bits)
    monkeypatch.setattr(interactions, "RANGE", 1 << bits)
    draw = random.Random(11)
    long = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", "  \t\n ", "SHORT CAPS", "a # b", long, long + " | x", "same " * 150,
             " " * 3, "W" + long, "é" * 40, "tok " * 30_000, "A" + "b" * 9, "AB" + "c" * 8]
    rows = [(draw.choice([None, draw.randrange(30)]), draw.choice(texts),
             draw.choice([None, "", "en", "de"])) for _ in range(60)]
    labels = [(draw.choice([None, draw.randrange(30)]), draw.choice([None, 0, 1]),
               draw.choice([None, 0, 1])) for _ in range(40)]
    docs = documents(rows).selectExpr("*", "1 AS part", "2 AS row", "'x' AS digest", "3 AS good")
    known = spark.createDataFrame(labels, LABELS).selectExpr("*", "'y' AS text", "4 AS row")
    found = interactions.audit(docs.repartition(3), known)
    assert sorted(map(tuple, found.collect())) == plain(rows, labels)


def test_no_documents_no_labels(spark, documents):
    empty = spark.createDataFrame([], LABELS)
    assert interactions.audit(documents([]), empty).count() == 0
    rows = [(1, "one", "en"), (2, "one", "en")]
    assert sorted(map(tuple, interactions.audit(documents(rows), empty).collect())) == plain(rows, [])


def test_other_filters(documents, spark):
    filters = {"X": lambda text, words: text.contains("x")}
    found = interactions.audit(documents([(1, "x", None), (2, "y", None), (3, "x", None)]),
                               spark.createDataFrame([], LABELS), filters).collect()
    assert {(r.filter_order, r.step): (r.removed, r.redundant, r.unique_fails) for r in found} == {
        ("XE", 1): (2, 0, 1), ("XE", 2): (0, 1, 0), ("EX", 1): (1, 0, 0), ("EX", 2): (1, 1, 1)}
    with pytest.raises(ValueError):
        interactions.audit(documents([]), spark.createDataFrame([], LABELS), {"E": filters["X"]})


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sets(st.integers(0, 60)), min_size=1, max_size=5))
def test_merge_counts_every_set_of_lists(sets):
    found = interactions.merged([sorted(s) for s in sets])
    wanted = {}
    for x in set().union(*sets):
        mask = sum(1 << i for i, s in enumerate(sets) if x in s)
        wanted[mask] = wanted.get(mask, 0) + 1
    assert found == wanted


@settings(deadline=None)
@given(st.sets(st.integers(0, 200), min_size=1), st.integers(0, 210), st.data())
def test_gallop_finds_the_first_place(ids, target, data):
    ids = sorted(ids)
    at = data.draw(st.integers(0, len(ids) - 1))
    assert interactions.gallop(ids, at, target) == next(
        (i for i in range(at, len(ids)) if ids[i] >= target), len(ids))
