import itertools
import random

import numpy as np
import xxhash

from ebbtide.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a, b in itertools.combinations(values, 2):
        if ((a ^ b) & simhash.FULL).bit_count() <= radius:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {v: find(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_pair_within_the_radius_shares_a_bucket():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(list(range(64)), radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(64), radius):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_fingerprints_and_groups_equal_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet")
            .select("doc_id", "text").collect()]
    rows += [(900_000, None), (900_001, ""), (900_002, " \t\n"), (900_003, "one Two"),
             (900_004, "One two"), (900_005, "a\x0bb c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in simhash.groups(docs).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r.fp & simhash.FULL for i, r in found.items()} == prints
    roots = plain_roots(sorted({signed(p) for p in prints.values()}), 3)
    least = {}
    for i, p in prints.items():
        root = roots[signed(p)]
        least[root] = min(i, least.get(root, i))
    assert {i: r.component_id for i, r in found.items()} == {
        i: least[roots[signed(p)]] for i, p in prints.items()}


def test_crowded_buckets_are_split_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 6)
    draw = random.Random(5)
    values = set()
    for _ in range(6):
        base = draw.getrandbits(64)
        for _ in range(60):
            value = base
            for _ in range(draw.randrange(7)):
                value ^= 1 << draw.randrange(64)
            values.add(signed(value))
    from ebbtide.llm.components import components
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.links(prints, 3)
    found = dict(map(tuple, components(links).collect()))
    assert {v: found.get(v, v) for v in values} == plain_roots(sorted(values), 3)


def test_negative_values_count_their_bits():
    assert simhash._connected(np.array([-1, 0], dtype=np.int64), 3) == []
    assert simhash._connected(np.array([-1, -2], dtype=np.int64), 3) == [(-2, -1)]


def test_one_document_of_each_group_stays(spark):
    a, b = "the quick brown fox jumps", "over the lazy dog again and again"
    rows = [(2, a, "x"), (1, a, "y"), (1, a, "y"), (3, b, "z"), (None, a, "n"),
            (None, "alone without an id", "n"), (None, "alone without an id", "m"),
            (None, "another one without id", "m"), (4, None, "q"), (5, "", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = [tuple(r) for r in simhash.deduplicated(docs).collect()]
    assert sorted((r[0], r[1]) for r in found if r[0]) == [(1, a), (3, b), (4, None)]
    assert sorted(r[1] for r in found if r[0] is None) == [
        "alone without an id", "another one without id"]
    assert simhash.deduplicated(docs.where("false")).count() == 0


def test_one_id_on_texts_of_two_groups(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    # Id 1 is the smallest of the groups of a and b; id 2 of that of c alone.
    rows = [(1, a), (5, a), (1, b), (6, b), (2, c), (2, a), (1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.deduplicated(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (1, b), (2, c)]
