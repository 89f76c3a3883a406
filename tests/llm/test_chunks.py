import random

import numpy as np

from ebbtide.llm import chunks
from ebbtide.llm.queries import QUERIES


def plain_ends(raw):
    """The rule, place by place."""
    word = lambda i: raw[i] not in b"\t\n\x0b\x0c\r " and (i == 0 or raw[i - 1] in b"\t\n\x0b\x0c\r ")
    spots = [i for i in range(len(raw)) if word(i) or raw[i] >= 0xE0]
    value = {i: sum(int(chunks.GEAR[b]) << (2 * (15 - j)) for j, b in enumerate(raw[i:i + 16])) % 2**32
             for i in spots}
    ends = [i for i in spots if i and all(
        value[j] < value[i] if j < i else value[j] <= value[i]
        for j in spots if j != i and abs(i - j) <= chunks.APART)]
    found, before = [], 0
    for end in [*ends, len(raw)]:
        at = before + chunks.LONGEST
        while at < end:
            cut = at
            while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                cut += 1
            if cut < end:
                found.append(cut)
            at += chunks.LONGEST
        found.append(end)
        before = end
    return sorted(set(found))


def ends_of(text):
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    return chunks.chunk_ends(data, chunks.places(data)[0]).tolist()


def words(draw, n):
    return [draw.choice("abcdefghijklm") * draw.randrange(2, 4) + draw.choice("nopqrstuvw") * draw.randrange(6)
            for _ in range(n)]


def test_chunks_follow_the_rule(monkeypatch):
    monkeypatch.setattr(chunks, "LONGEST", 60)
    draw = random.Random(1)
    texts = [" ".join(words(draw, 300)), "a", "  a b\n", "word " * 100, "x" * 500, "語" * 100,
             "é" * 100 + " 中文 text", " "]
    for text in texts:
        assert ends_of(text) == plain_ends(text.encode())
        for end in ends_of(text):
            text.encode()[:end].decode()


def test_chunks_return_after_an_insertion():
    draw = random.Random(2)
    text = " ".join(words(draw, 500))
    before, after = set(pieces(text)), set(pieces("Some more words. " + text[:900] + "and " + text[900:]))
    assert len(before & after) > 0.9 * len(before)


def pieces(text):
    raw, at, found = text.encode(), 0, []
    for end in ends_of(text):
        found.append(raw[at:end])
        at = end
    assert b"".join(found) == raw
    return found


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    draw = random.Random(3)
    passages = [" ".join(words(draw, 51 + i)) for i in range(20)]
    line = " ".join(words(draw, 14))
    docs = []
    for i in range(400):
        body = words(draw, draw.randrange(20, 300))
        if i < 200:
            body.insert(draw.randrange(len(body)), passages[i % 20])
        docs.append((i, "\n".join([line, " ".join(body), line] if i % 2 else [" ".join(body)])))
    docs += [(1000, None), (1001, ""), (None, passages[0]), (None, "short"), (1002, "a " * 90_000),
             (1003, passages[0]), (1003, passages[0]), (7, docs[7][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr(
        "*", "1 AS start", "2 AS words")
    found = chunks.repeats(frame).collect()
    text = {d: t for d, t in docs if d is not None}
    assert {r.doc_id for r in found} == {*range(200), None, 1003}
    for r in found:
        if r.doc_id is not None:
            part = text[r.doc_id].encode()[r.start:r.end].decode()
            assert len(part.split()) == r.words >= chunks.LEAST_WORDS
            assert any(part.strip() in p or p in part or line in part for p in passages) or r.doc_id < 200
    cut = chunks.without_repeats(frame)
    assert cut.columns == frame.columns
    rows = cut.collect()
    assert len(rows) == len(docs)
    # Each passage stays once; the others lose nearly all of it, and nothing else.
    for i, passage in enumerate(passages):
        whole = [r for r in rows if r.text and passage in r.text]
        assert {r.doc_id for r in whole} == ({None} if i == 0 else {i})
    assert {r.doc_id: r.text for r in rows if (r.doc_id or 0) in range(200, 1003)} == {
        i: t for i, t in text.items() if i in range(200, 1003)}


def test_no_rows_and_the_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert chunks.repeats(docs.where("false")).count() == 0
    assert chunks.without_repeats(docs.where("false")).count() == 0
    copies = {r.doc_id for r in docs.collect()
              if len((r.text or "").split()) > 60 and r.text in repeated_texts(docs)}
    assert copies <= {r.doc_id for r in QUERIES["op7_substrings"](spark, folder).collect()}


def repeated_texts(docs):
    return {r.text for r in docs.groupBy("text").count().where("count > 1").collect()}
