"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. All n-grams of the test items are counted in the corpus. A bit table of fixed largest
   size drops nearly all other n-grams inside the tasks; an exact join drops the rest.
2. Every n-gram of an item that some document has is a seed, if it is rare: in at most
   ``RARE`` documents, or one document in ``ONE_IN`` if that is more. Of the common ones, the
   rarest of every few neighbours is a seed. N-grams that no document has are no seeds.
3. Documents with a seed give their words around it (as hashes). Seeds are joined to items
   by an exact join, which gives each pair of region and item the stretch to look at.
4. The item is aligned with that stretch: match +1, mismatch or gap -1. A document is
   contaminated where the best score reaches ``share`` of the item's words, and at least
   ``LEAST`` words or the whole item.

Words are runs of letters, marks and digits, lower-cased. Null or empty texts match nothing,
and an item with fewer words than an n-gram matches where all its words stand in a row.
Repeated rows and items give the same pair, which is reported once. No documents or no items:
no pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from ebbtide.llm import words as W
from ebbtide.llm.bits import bit_table, in_table
from ebbtide.llm.scratch import keep_rows, mark, stored
from pyspark.sql import DataFrame, Window, functions as F

GRAM = 3
APART = 4
#: Documents that a rare n-gram is in at most, or one of so many if that is more.
RARE, ONE_IN = 1_000, 1_000
SHARE = 0.5
LEAST = 8
#: Bytes of texts whose n-grams a task holds at once, if no single text is longer.
PIECE = 1 << 20
#: Cells of one row of alignments that are computed together.
CELLS = 1 << 18
ONE = np.int64(1 << 32)


def _items(benchmark: DataFrame) -> DataFrame:
    """``(item_id, words, grams)``: hashes of the words and of the n-grams, by place. An item
    with fewer words than an n-gram is one shorter n-gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = W.words(batch.column(1))
            n = batch.num_rows
            ends = W.first_words(rows, n)
            at, grams, size = _grams(rows, hashes, range(1, GRAM + 1))
            own = size == np.minimum(np.diff(ends), GRAM)[rows[at]]
            at, grams = at[own], grams[own]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), _lists(W.signed(hashes), ends),
                _lists(W.signed(grams), W.first_words(rows[at], n))],
                names=["item_id", "words", "grams"])

    text = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"),
                            W.normalised(benchmark["text"]).alias("text"))
    return text.mapInArrow(run, "item_id long, words array<long>, grams array<long>").where(
        "size(grams) > 0").distinct()


def _grams(rows: np.ndarray, hashes: np.ndarray, sizes: Iterable[int]
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first word, hash and size of every n-gram of the sizes, by the index."""
    found = [(*W.grams(rows, hashes, n), n) for n in sizes]
    at = np.concatenate([a for a, _, _ in found])
    order = np.argsort(at, kind="stable")
    return (at[order], np.concatenate([g for _, g, _ in found])[order],
            np.concatenate([np.full(len(a), n) for a, _, n in found])[order])


def _known(texts: pa.Array, sizes: Iterable[int], bits: int, table: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every word; index of the first word and hash of every n-gram that the
    bit table has, by the index. The others are dropped size by size."""
    rows, hashes = W.words(texts)
    places, grams = [], []
    for n in sizes:
        at, found = W.grams(rows, hashes, n)
        kept = in_table(found, bits, table)
        places.append(at[kept])
        grams.append(found[kept])
    at = np.concatenate(places)
    order = np.argsort(at, kind="stable")
    return rows, hashes, at[order], np.concatenate(grams)[order]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _document_counts(texts: DataFrame, bits: int, table: np.ndarray, sizes: list[int]
                     ) -> DataFrame:
    """``(gram, docs)``: in how many documents of a batch an n-gram of the table occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, most=PIECE):
            rows, _, at, grams = _known(batch.column(0), sizes, bits, table)
            pairs = np.unique(np.stack([grams, rows[at].astype(np.uint64)]), axis=1)
            gram, docs = np.unique(pairs[0], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(W.signed(gram)), pa.array(docs.astype(np.int64))], names=["gram", "docs"])

    return texts.select("text").mapInArrow(run, "gram long, docs long").groupBy("gram").agg(
        F.sum("docs").alias("docs"))


def _regions(texts: DataFrame, bits: int, table: np.ndarray, sizes: list[int], reach: int
             ) -> DataFrame:
    """``(doc_id, mark, start, words, at, grams)``: the words up to ``reach`` words from a
    seed, the place of the first, and the seeds with their places in the document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, most=PIECE):
            rows, hashes, at, grams = _known(batch.column(2), sizes, bits, table)
            ends = W.first_words(rows, batch.num_rows)
            row = rows[at]
            start = np.maximum(at - reach, ends[row])
            stop = np.minimum(at + GRAM + reach, ends[row + 1])
            # A seed whose words begin after those of the one before opens a region.
            opens = np.ones(len(at), dtype=bool)
            opens[1:] = (row[1:] != row[:-1]) | (start[1:] >= stop[:-1])
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(at))
            begin, end = start[first], stop[last - 1] if len(first) else stop[:0]
            length = end - begin
            bounds = np.concatenate(([0], np.cumsum(length)))
            taken = np.repeat(begin - bounds[:-1], length) + np.arange(bounds[-1])
            of = pa.array(row[first])
            seeds = np.append(first, len(at))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(of), batch.column(1).take(of),
                pa.array(begin - ends[row[first]]),
                _lists(W.signed(hashes[taken]), bounds),
                _lists(at - ends[row], seeds), _lists(W.signed(grams), seeds)],
                names=["doc_id", "mark", "start", "words", "at", "grams"])

    return texts.select("doc_id", "mark", "text").mapInArrow(
        run, "doc_id long, mark long, start long, words array<long>, at array<long>, "
             "grams array<long>")


def align(items: list[np.ndarray], texts: list[np.ndarray]
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item with its text: score, first and last place + 1.

    Scores and the place where an alignment starts are one number, so that a maximum takes
    both. A gap in the item is a running maximum along the row.
    """
    n, wide = len(items), max(map(len, texts))
    words = np.zeros((n, wide), np.int64)
    real = np.zeros((n, wide), bool)
    for i, t in enumerate(texts):
        words[i, :len(t)], real[i, :len(t)] = t, True
    lengths = np.array([len(i) for i in items])
    column = np.arange(wide + 1, dtype=np.int64)
    before = np.tile(column, (n, 1))
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at in range(lengths.max()):
        word = np.array([i[at] if at < len(i) else 0 for i in items], np.int64)
        same = (words == word[:, None]) & real
        now = np.tile(column, (n, 1))
        now[:, 1:] = np.maximum(now[:, 1:], before[:, :-1] + np.where(same, ONE, -ONE))
        now = np.maximum(now, before - ONE)
        now = np.maximum.accumulate(now + ONE * column, axis=1) - ONE * column
        top = now.argmax(axis=1)
        value = now[np.arange(n), top]
        better = (at < lengths) & (value >> 32 > best >> 32)
        best, end = np.where(better, value, best), np.where(better, top, end)
        before = now
    return best >> 32, best & 0xFFFFFFFF, end


def _aligned(pairs: DataFrame, share: float) -> DataFrame:
    """``(doc_id, mark, item_id, score, first_word, last_word)`` of contaminated stretches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = ([x.values.to_numpy() for x in batch.column(c)] for c in ("item", "words"))
            start = batch.column("start").to_numpy()
            order = sorted(range(len(items)), key=lambda i: len(texts[i]))
            kept, scores, firsts, lasts = [], [], [], []
            while order:
                take = max(1, min(len(order), CELLS // (1 + len(texts[order[0]]))))
                while take > 1 and take * len(texts[order[take - 1]]) > CELLS:
                    take //= 2
                some, order = order[:take], order[take:]
                score, first, end = align([items[i] for i in some], [texts[i] for i in some])
                for i, s, a, b in zip(some, score.tolist(), first.tolist(), end.tolist()):
                    length = len(items[i])
                    if s >= max(share * length, min(length, LEAST)):
                        kept.append(i)
                        scores.append(s / length)
                        firsts.append(int(start[i]) + a)
                        lasts.append(int(start[i]) + b - 1)
            of = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(of) for c in ("doc_id", "mark", "item_id")],
                 pa.array(scores, pa.float64()), pa.array(firsts, pa.int64()),
                 pa.array(lasts, pa.int64())],
                names=["doc_id", "mark", "item_id", "score", "first_word", "last_word"])

    return pairs.mapInArrow(run, "doc_id long, mark long, item_id long, score double, "
                                 "first_word long, last_word long")


def seeds(grams: DataFrame, counts: DataFrame, rare: int = 0) -> DataFrame:
    """``(gram, number, offset)``: the n-grams that at most ``rare`` documents have, and of each
    ``APART`` neighbouring ones of the others the rarest. N-grams without documents go."""
    counted = grams.join(counts, "gram").withColumn("c", F.struct("docs", "offset", "gram"))
    ahead = Window.partitionBy("number").orderBy("offset").rangeBetween(0, APART - 1)
    common = counted.where(F.col("docs") > rare).select("number", F.min("c").over(ahead).alias("c"))
    few = counted.where(F.col("docs") <= rare).select("number", "c")
    return few.unionAll(common).select(
        F.col("c.gram").alias("gram"), "number", F.col("c.offset").alias("offset")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``(doc_id, mark, item_id, score, first_word, last_word)``: one row per document and
    test item it contains a copy of, with the best copy's place."""
    items = stored(_items(benchmark).withColumn("number", F.monotonically_increasing_id()), "items")
    grams = stored(items.select("number", F.posexplode("grams").alias("offset", "gram")),
                   "item-grams")
    reach = items.agg(F.max(F.size("words"))).first()[0] or 0
    # At most GRAM rows.
    sizes = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(GRAM)))
                   .distinct().collect()) or [GRAM]
    texts = docs.select(docs["doc_id"].alias("doc_id"), mark(docs).alias("mark"),
                        W.normalised(docs["text"]).alias("text"))
    every = grams.select("gram").distinct()
    known = bit_table(every.withColumnRenamed("gram", "hash"))
    counts = stored(_document_counts(texts, *known, sizes).join(every, "gram"), "counts")
    rare = stored(seeds(grams, counts, max(RARE, docs.count() // ONE_IN)), "seeds")
    wanted = bit_table(rare.select(F.col("gram").alias("hash")).distinct())
    found = stored(_regions(texts, *wanted, sizes, reach)
                   .withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = found.select("region", F.explode(F.arrays_zip("grams", "at")).alias("h")).select(
        "region", F.col("h.grams").alias("gram"), F.col("h.at").alias("at"))
    shift = F.col("at") - F.col("offset")
    pairs = hits.join(rare, "gram").groupBy("region", "number").agg(
        F.min(shift).alias("low"), F.max(shift).alias("high"))
    length = F.size("item")
    low = F.greatest(F.col("low") - length, F.col("start"))
    high = F.col("high") + 2 * length
    stretch = (pairs.join(found.select("region", "doc_id", "mark", "start", "words"), "region")
               .join(items.select("number", "item_id", F.col("words").alias("item")), "number")
               .select("doc_id", "mark", "item_id", "item", low.alias("start"),
                       F.slice("words", (low - F.col("start") + 1).cast("int"),
                               F.greatest(high - low, F.lit(1)).cast("int")).alias("words")))
    best = _aligned(stretch, share).groupBy("doc_id", "mark", "item_id").agg(
        F.max(F.struct("score", (-F.col("first_word")).alias("f"),
                       F.col("last_word").alias("l"))).alias("b"))
    return best.select("doc_id", "mark", "item_id", F.col("b.score").alias("score"),
                       (-F.col("b.f")).alias("first_word"), F.col("b.l").alias("last_word"))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents without a copy of a test item; all columns stay."""
    found = stored(contaminated(docs, benchmark, share).select("doc_id", "mark").distinct(),
                   "contaminated")
    return keep_rows(docs, found, "left_anti")
