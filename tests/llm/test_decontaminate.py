import random

import numpy as np

from ebbtide.llm import decontaminate


def plain_alignment(item, text):
    best, h = 0, [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a == b else -1), h[i - 1][j] - 1,
                          h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_one():
    draw = np.random.default_rng(2)
    items = [draw.integers(0, 4, draw.integers(1, 12)) for _ in range(60)]
    texts = [draw.integers(0, 4, draw.integers(1, 25)) for _ in range(60)]
    score, first, end = decontaminate.align(items, texts)
    for s, a, b, item, text in zip(score, first, end, items, texts):
        assert s == plain_alignment(list(item), list(text))
        # The stretch alone gives the same score.
        assert s == 0 or plain_alignment(list(item), list(text[a:b])) == s


def edited(draw, words, share):
    return [draw.choice(VOCABULARY) if draw.random() < share else w for w in words]


VOCABULARY = [a + b + c for a in ("ba", "ce", "do", "fi", "gu") for b in ("lan", "mer", "nis")
              for c in ("t", "rk", "sh", "p", "o", "el", "and")]


def test_copies_are_found_and_others_left_alone(spark):
    draw = random.Random(4)
    make = lambda n: [draw.choice(VOCABULARY) for _ in range(n)]
    items = [make(draw.randrange(15, 50)) for _ in range(30)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)]
    bench += [(30, None), (31, ""), (32, "two words"), (None, " ".join(make(20))), (0, bench[0][1])]
    common = " ".join(items[7])
    docs, want = [], set()
    for d in range(300):
        text = make(draw.randrange(30, 400))
        if d % 3 == 0:
            i = draw.randrange(30)
            copy = edited(draw, items[i], 0.1) if d % 2 else items[i]
            at = draw.randrange(len(text))
            text[at:at] = copy
            if plain_alignment(items[i], copy) >= 0.7 * len(items[i]):
                want.add((d, i))
        docs.append((d, ", ".join(w.capitalize() for w in text)))
        if d % 2:
            docs[-1] = (d, docs[-1][1] + "\n" + common)
            want.add((d, 7))
    docs += [(1000, None), (1001, ""), (None, bench[-2][1] + " and more"), (None, "clean text"),
             (1002, bench[3][1]), (1002, bench[3][1]), (1003, " ".join(["word"] * 30_000))]
    want |= {(1002, 3), (None, None)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items_frame = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.contaminated(frame, items_frame).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(found) == len(got)
    assert want <= got
    text_of = {d: decontaminated_words(t) for d, t in docs}
    for r in found:
        if r.item_id is not None:
            stretch = text_of[r.doc_id][r.first_word:r.last_word + 1]
            assert r.score * len(items[r.item_id]) == plain_alignment(items[r.item_id], stretch)
    kept = decontaminate.clean(frame.selectExpr("*", "1 AS mark", "2 AS score"), items_frame)
    assert kept.columns == ["doc_id", "text", "mark", "score"]
    ids = [r.doc_id for r in kept.collect()]
    assert {1000, 1001, 1003} <= set(ids) and ids.count(None) == 1
    assert not {d for d, _ in got if d is not None} & set(ids)
    assert set(ids) | {d for d, _ in got} == {d for d, _ in docs}


def decontaminated_words(text):
    return [] if text is None else text.lower().replace(",", " ").split()


def test_no_items_or_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0
    assert decontaminate.contaminated(docs, bench).count() == 1
    assert decontaminate.clean(docs, bench.where("false")).count() == 1


def test_common_grams_are_not_seeds_where_rarer_ones_are_near(spark):
    grams = spark.createDataFrame([(0, i, 100 + i) for i in range(6)],
                                  "number long, offset int, gram long")
    counts = spark.createDataFrame([(100, 9), (101, 1), (102, 9), (103, 9), (104, 9), (105, 2)],
                                   "gram long, docs long")
    assert {r.gram for r in decontaminate.seeds(grams, counts).collect()} == {101, 105}


def test_regularly_spaced_edits_are_found_beside_a_verbatim_copy(spark):
    item = [f"w{i}" for i in range(36)]
    spaced = ["x" if i % 6 == 5 else w for i, w in enumerate(item)]
    assert plain_alignment(item, spaced) >= 0.5 * len(item)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    around = " ".join(f"a{i}" for i in range(50))
    docs = [(1, f"{around} {' '.join(spaced)} {around}"), (3, around)]
    verbatim = (2, f"{around} {' '.join(item)}")
    for some in (docs, [*docs, verbatim]):
        frame = spark.createDataFrame(some, "doc_id long, text string")
        rows = {r.doc_id: r for r in decontaminate.contaminated(frame, bench).collect()}
        assert set(rows) == {d for d, _ in some} - {3}
        assert rows[1].score * 36 == plain_alignment(item, spaced)
        assert (rows[1].first_word, rows[1].last_word) == (50, 84)


def test_seeds_are_ngrams_that_documents_have(spark):
    grams = spark.createDataFrame([(0, i, 100 + i) for i in range(8)],
                                  "number long, offset int, gram long")
    counts = spark.createDataFrame([(101, 2), (102, 3), (105, 50), (106, 40), (107, 60)],
                                   "gram long, docs long")
    assert {r.gram for r in decontaminate.seeds(grams, counts).collect()} == {101, 102, 106, 107}
    rare = decontaminate.seeds(grams, counts, 3)
    assert {r.gram for r in rare.collect()} == {101, 102, 106, 107}
    assert decontaminate.seeds(grams, counts, 60).count() == 5


def test_short_items_match_as_a_whole(spark):
    bench = spark.createDataFrame([(1, "alpha"), (2, "beta, gamma"), (3, "one two three")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, "an Alpha here"), (2, "beta x gamma"), (3, "the beta gamma"),
                                  (4, "beta"), (5, "one two three four")], "doc_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.first_word, r.last_word) for r in found} == {
        (1, 1, 1, 1), (3, 2, 1, 2), (5, 3, 0, 2)}
