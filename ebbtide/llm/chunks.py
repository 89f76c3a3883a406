"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text. Places where a chunk may end are word starts
(and, in scripts without spaces, characters). A chunk ends at a place whose hash is the
largest of all such places within ``APART`` bytes, so whether it ends depends on some forty
bytes around and nothing else: after an insertion the same chunks return. Chunks are whole
words of about 45 bytes on average; only where no place stands out, as in one word repeated
over and over, is a chunk cut at ``LONGEST`` bytes.

Chunks are compared by a 64-bit digest. A digest that two documents have is repeated; a run
of neighbouring repeated chunks is a repeated passage. Of a passage that two documents share
the run lacks at most what lies before the first and after the last chunk end inside it, some
dozen words together; with ``LEAST_WORDS`` of 28 passages of more than 50 words are reported
and common lines are not. Digests alone decide, but a false run needs several wrong
neighbours at once.

A document is a doc_id with its text: rows that repeat both are one document. Documents
without doc_id are told apart by their text. Null and empty texts have no chunks. Texts are
processed whole. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from ebbtide.llm.bits import bit_table, in_table
from ebbtide.llm.scratch import mark, stored
from ebbtide.llm.words import pieces
from pyspark.sql import DataFrame, Window, functions as F

APART = 16
LONGEST = 1024
LEAST_WORDS = 28
#: Bytes a hash looks at; each further byte moves it by 2 of its 32 bits.
REACH, SHIFT = 16, 2
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
CHUNK = "doc_id long, mark long, number long, start long, end long, words int, digest long"


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash of the ``REACH`` bytes from each byte on."""
    h, width = GEAR[data], 1
    while width < REACH:
        ahead = np.zeros_like(h)
        ahead[:-width] = h[width:] if width < len(h) else 0
        h = (h << np.uint32(SHIFT * width)) + ahead
        width *= 2
    return h


def chunk_ends(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks end: ascending byte positions, the last is the length.

    ``starts`` are the places where a chunk may begin.
    """
    value = rolling(data)[starts]
    top = np.ones(len(starts), dtype=bool)
    # Places are two bytes apart at least.
    for k in range(1, APART // 2 + 1):
        near = starts[k:] - starts[:-k] <= APART
        if not near.any():
            break
        later = value[k:] > value[:-k]
        top[:-k] &= ~(near & later)
        top[k:] &= ~near | later
    ends = np.append(starts[top & (starts > 0)], len(data))
    before = np.concatenate(([0], ends[:-1]))
    if (ends - before).max() <= LONGEST:
        return ends
    forced = [np.arange(a + LONGEST, b, LONGEST) for a, b in zip(before, ends) if b - a > LONGEST]
    forced = np.concatenate(forced)
    for _ in range(3):  # Not within a character.
        inner = (data[np.minimum(forced, len(data) - 1)] & 0xC0) == 0x80
        forced = forced + inner
    return np.unique(np.concatenate([ends, forced[forced < len(data)]]))


def places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks may begin, and where words begin."""
    space = SPACES[data]
    words = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if (data >= 0xE0).any():
        return np.union1d(words, np.flatnonzero(data >= 0xE0)), words
    return words, words


def chunked(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark, bytes, words, digests)``: the chunks of each text, in order, by their
    length, the words that begin in them, and their digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts, sizes, words, digests = [0], [], [], []
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                can, starts = places(data)
                ends = chunk_ends(data, can)
                begins = np.concatenate(([0], ends[:-1]))
                counts.append(len(ends))
                sizes.append(ends - begins)
                words.append(np.diff(np.searchsorted(starts, ends), prepend=0))
                digests += [xxhash.xxh3_64_intdigest(raw[a:b])
                            for a, b in zip(begins.tolist(), ends.tolist())]
            bounds = pa.array(np.cumsum(counts), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (
                    np.concatenate(sizes).astype(np.int32), np.concatenate(words).astype(np.int32),
                    np.array(digests, np.uint64).view(np.int64))]],
                names=["doc_id", "mark", "bytes", "words", "digests"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), mark(docs).alias("mark"),
                        docs["text"].alias("text")).where("text != ''")
    return texts.mapInArrow(run, "doc_id long, mark long, bytes array<int>, words array<int>, "
                                 "digests array<long>")


def _likely(every: DataFrame, bits: int, table: np.ndarray) -> DataFrame:
    """One row per chunk whose digest may be repeated: its number, place and digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column(4).flatten().to_numpy()
            counts = np.diff(batch.column(4).offsets.to_numpy())
            row = np.repeat(np.arange(len(counts)), counts)
            first = np.cumsum(counts) - counts
            ends = np.cumsum(batch.column(2).flatten().to_numpy(), dtype=np.int64)
            before = np.concatenate(([0], ends))[first]
            hit = np.flatnonzero(in_table(digests.view(np.uint64), bits, table))
            at, end = row[hit], ends[hit] - before[row[hit]]
            of = pa.array(at)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(of), batch.column(1).take(of), pa.array(hit - first[at]),
                pa.array(end - batch.column(2).flatten().to_numpy()[hit]), pa.array(end),
                pa.array(batch.column(3).flatten().to_numpy()[hit]), pa.array(digests[hit])],
                names=[c.split()[0] for c in CHUNK.split(", ")])

    return every.mapInArrow(run, CHUNK)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """The chunks whose digest another document has, a row for each."""
    every = stored(chunked(docs), "chunks")
    # A document is known by a hash here: what moves is two numbers for each chunk.
    each = every.select(F.xxhash64("doc_id", "mark").alias("doc"), F.explode("digests").alias("digest"))
    shared = stored(each.groupBy("digest").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
                    .where("a != b").select("digest"), "repeated")
    # Most chunks that are not repeated stay in their task; the join settles the rest.
    likely = _likely(every, *bit_table(shared.withColumnRenamed("digest", "hash")))
    return likely.join(shared, "digest")


def runs(repeated: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, mark, start, end, words)``: neighbouring chunks as passages."""
    inside = Window.partitionBy("doc_id", "mark").orderBy("number")
    # Rows that are repeated whole give a chunk more than once.
    apart = F.col("number") - F.lag("number").over(inside)
    opens = F.coalesce((apart > 1).cast("int"), F.lit(1))
    numbered = repeated.withColumn("opens", opens).withColumn(
        "words", F.when(apart == 0, 0).otherwise(F.col("words"))).withColumn(
        "run", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "mark", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.sum("words").alias("words")).where(F.col("words") >= least_words).drop("run")


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every passage that documents share, in each of them, by its bytes from start to end."""
    return runs(repeated_chunks(docs), least_words)


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents; a repeated passage stays in the first document that has it and is cut
    out of all others. All columns stay."""
    repeated = stored(repeated_chunks(docs), "repeated-chunks")
    firsts = repeated.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    later = repeated.join(firsts, "digest").where(
        "NOT (doc_id <=> first.doc_id AND mark <=> first.mark)")
    cuts = stored(runs(later, least_words).groupBy("doc_id", "mark").agg(F.sort_array(
        F.collect_list(F.struct("start", "end"))).alias("spans")), "cuts")
    found = cuts.select(*[F.col(c).alias(f"__{c}") for c in cuts.columns])

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        result = []
        for text, out in zip(texts.to_pylist(), spans.to_pylist()):
            if out and text is not None:
                raw, at, parts = text.encode(), 0, []
                for span in out:
                    parts.append(raw[at:span["start"]])
                    at = span["end"]
                text = b"".join([*parts, raw[at:]]).decode()
            result.append(text)
        return pa.array(result, pa.string())

    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["__doc_id"])
                       & (mark(docs) == found["__mark"]), "left")
    return joined.select(*[cut(docs["text"], found["__spans"]).alias("text") if c == "text"
                           else docs[c] for c in docs.columns])
