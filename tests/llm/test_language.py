import zlib
from collections import Counter

import numpy as np

from ebbtide.llm import language
from ebbtide.llm.queries import QUERIES


def plain_grams(text):
    found, line = Counter(), f" {text} "
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            gram = line[i:i + n]
            if gram != " " and " " not in gram[1:-1]:
                found[gram] += 1
    return found


def gram_text(code):
    chars = ""
    while code:
        chars, code = chr(code % (1 << 21)) + chars, code >> 21
    return chars


def plain_ranked(grams, size):
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:size]


def test_grams_and_ranks_equal_plain_counting(monkeypatch):
    for piece in (1 << 20, 5, 7):
        monkeypatch.setattr(language, "PIECE", piece)
        for text in ("a", "ab c", "the then their \U0001d4d0 ß", "aaaa aaa aa a", "x" * 40):
            codes, counts = language.gram_counts(text)
            assert {gram_text(int(c)): n for c, n in zip(codes, counts.tolist())} == plain_grams(text)
            assert [gram_text(int(c)) for c in language.ranked(text, 9)] == plain_ranked(
                plain_grams(text), 9)


def test_distances_are_out_of_place():
    profiles = language.Profiles(["x", "y"], np.array(sorted([97, 98, 99])),
                                 np.array([[0, 1, 2], [2, -1, 0]], dtype=np.int32))
    own = language.ranked("aab", 300)
    assert gram_text(int(own[0])) == "a"
    apart, most = language.distances("aab", profiles)
    rest = 300 * (len(own) - 2)
    assert apart.tolist() == [0 + 0 + rest, 2 + 300 + rest] and most == 300 * len(own)


def test_query_tells_held_out_documents(spark, folder):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op6_language"](spark, folder).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {
        i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_and_no_training(spark):
    rows = [(1, "the cat and the dog", "en"), (3, "die Katze und der Hund", "de"), (4, None, "en"),
            (5, "", "de"), (6, "123 …", "en"), (7, "ТЕКСТ", None), (None, "the dog", "xx"),
            (8, "the the the " * 200_000, None), (9, "́", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "1 AS score", "2 AS gram")
    found = {r.doc_id: r for r in language.identified(docs).collect()}
    assert len(found) == len(rows)
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (4, 5, 6, 9))
    assert found[8].lang_pred == found[None].lang_pred == "en"
    assert not found[None].held_out and found[7].score == 0.0
    empty = language.learn(docs.where("false"))
    assert empty.languages == []
    one = docs.select(language.prediction(docs["text"], empty).alias("p")).first()["p"]
    assert (one.lang, one.score) == ("und", 0.0)
    assert language.identified(docs.where("false")).count() == 0
