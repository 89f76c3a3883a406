import numpy as np
import pyarrow as pa

from ebbtide.llm import words


def test_words_of_a_batch_equal_split(monkeypatch):
    texts = ["the cat sat", None, "", "the", "a b c a b", "é" * 40 + " the"]
    for segment in (1 << 20, 8, 3):
        monkeypatch.setattr(words, "SEGMENT", segment)
        array = pa.array(["skipped", *texts])[1:]
        rows, hashes, heads = zip(*words.segments(array, (2,)))
        rows, hashes, heads = map(np.concatenate, (rows, hashes, [h for h, in heads]))
        assert all((a == b).all() for a, b in zip(words.words(array), (rows, hashes)))
        flat = [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
        assert rows.tolist() == [i for i, _ in flat]
        same = {}
        for (_, w), h in zip(flat, hashes.tolist()):
            assert same.setdefault(w, h) == h
        assert len(set(same.values())) == len(same)
        assert [h == 0 for h in heads.tolist()] == [len(w.encode()) < 2 for _, w in flat]
        assert heads[0] == heads[3] != heads[1]


def test_grams_stay_within_a_text():
    rows, hashes = words.words(pa.array(["a b c", "d", "a b c d"]))
    at, found = words.grams(rows, hashes, 3)
    assert at.tolist() == [0, 4, 5]
    assert found[0] == found[1] != found[2]
    assert len(words.grams(rows[:2], hashes[:2], 3)[0]) == 0


def test_words_of_nothing():
    rows, hashes = words.words(pa.array([None, ""], pa.string()))
    assert len(rows) == len(hashes) == 0
    assert words.first_words(rows, 2).tolist() == [0, 0, 0]
    assert words.signed(np.array([2**64 - 1], np.uint64))[0] == -1


def test_rows_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 6)
    texts = pa.array(["abc", None, "de", "long text", "", "x", "y" * 6, "z"])
    found = list(words.spans(texts))
    assert [texts.slice(a, n).to_pylist() for a, n in found] == [
        ["abc", None, "de"], ["long text"], ["", "x"], ["yyyyyy"], ["z"]]
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    assert [t for b in words.pieces(iter([batch])) for t in b.column(0).to_pylist()] == texts.to_pylist()
    assert list(words.spans(pa.array([], pa.string()))) == []
