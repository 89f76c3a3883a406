"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A language's profile is its most frequent character n-grams of all its training texts, in
order. A document's most frequent n-grams, also in order, are compared with every profile:
the out-of-place distance sums how far each n-gram's rank is from its rank there, and the
largest possible distance for those the profile lacks. The nearest language is predicted.

N-grams of 1 to 3 characters are taken from lower-cased letters and marks, words padded with
a space on both sides, and never across two words. Ties in frequency go by length, then by
code points; ties between languages go to the smaller name.

The score is 1 - distance / largest distance. Null texts and texts without a letter, or no
profile at all: ``und`` with score 0. Only text and lang of the training rows are learned from.
Documents without doc_id take no part in training and are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ebbtide.llm.scratch import stored
from pyspark.sql import Column, DataFrame, Window, functions as F

LONGEST = 3
PROFILE = 300
UNKNOWN = "und"
#: More values of lang than this are not languages.
MOST_LANGUAGES = 5_000
#: Characters that are counted together.
PIECE = 1 << 20
BASE = np.int64(1 << 21)
SPACE = 32


@dataclass
class Profiles:
    """The languages, all n-grams of their profiles in order, and their rank in each."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray


def letters(text: Column) -> Column:
    """Lower-cased words of letters and marks; empty where there is no letter."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))
    return F.when(clean.rlike(r"\p{L}"), clean).otherwise("")


def _codes(points: np.ndarray) -> np.ndarray:
    """All n-grams as numbers in base 2 ** 21."""
    space, code, found = points == SPACE, points, [points[points != SPACE]]
    for n in range(2, LONGEST + 1):
        code = code[:-1] * BASE + points[n - 1:]
        inner = np.zeros(len(code), dtype=bool)
        for i in range(1, n - 1):
            inner |= space[i:i + len(code)]
        found.append(code[~inner])
    return np.concatenate(found)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """N-grams in order, and how often each occurs."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    parts = []
    for at in range(0, len(points), PIECE):
        piece = points[at:at + PIECE + LONGEST - 1]
        if at + PIECE >= len(points):
            parts.append(np.unique(_codes(piece), return_counts=True))
            break
        # What begins in this piece: everything but what the overlap holds alone.
        tail = _codes(piece[PIECE:])
        every = np.unique(np.concatenate([_codes(piece), tail]), return_counts=True)
        twice = dict(zip(*np.unique(tail, return_counts=True)))
        less = np.array([2 * twice.get(c, 0) for c in every[0]])
        parts.append((every[0], every[1] - less))
    return merged([c for c, _ in parts], [n for _, n in parts])


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts by n-gram, without those that are 0."""
    if len(codes) == 1:
        return codes[0], counts[0]
    grams, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(grams)).astype(np.int64)
    return grams[total > 0], total[total > 0]


def ranked(text: str, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    grams, counts = gram_counts(text)
    return grams[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of all languages, from every row with a text and a lang."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = found.setdefault(lang, [[], []])
                grams, counts = gram_counts(text)
                parts[0].append(grams)
                parts[1].append(counts)
                if len(parts[0]) == 500:
                    grams, counts = merged(*parts)
                    found[lang] = [[grams], [counts]]
            for lang, parts in found.items():
                grams, counts = merged(*parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts.astype(np.int64))],
                    names=["lang", "gram", "n"])

    texts = docs.select(docs["lang"].alias("lang"), letters(docs["text"]).alias("text")).where(
        "lang IS NOT NULL AND text != ''")
    counts = texts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = stored(counts.withColumn("rank", F.row_number().over(order) - 1)
                 .where(F.col("rank") < size).select("lang", "gram", "rank"), "profiles")
    if top.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    rows = top.collect()
    languages = sorted({r["lang"] for r in rows})
    grams = np.array(sorted({r["gram"] for r in rows}), dtype=np.int64)
    ranks = np.full((len(languages), len(grams)), -1, dtype=np.int32)
    number = {lang: i for i, lang in enumerate(languages)}
    for r in rows:
        ranks[number[r["lang"]], np.searchsorted(grams, r["gram"])] = r["rank"]
    return Profiles(languages, grams, ranks)


def distances(text: str, profiles: Profiles, size: int = PROFILE) -> tuple[np.ndarray, int]:
    """The out-of-place distance to each language, and the largest possible."""
    own = ranked(text, size)
    at = np.searchsorted(profiles.grams, own)
    known = at < len(profiles.grams)
    known[known] = profiles.grams[at[known]] == own[known]
    there = profiles.ranks[:, at[known]]
    apart = np.where(there < 0, size, np.abs(there - np.flatnonzero(known)))
    return apart.sum(axis=1) + size * int((~known).sum()), size * len(own)


def prediction(text: Column, profiles: Profiles, size: int = PROFILE) -> Column:
    """A struct column of language and score."""
    @F.arrow_udf("struct<lang: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for text in texts.to_pylist():
            lang, score = UNKNOWN, 0.0
            if text and profiles.languages:
                apart, most = distances(text, profiles, size)
                best = int(apart.argmin())
                lang, score = profiles.languages[best], 1 - float(apart[best]) / most
            langs.append(lang)
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)],
                                          names=["lang", "score"])

    return run(letters(text))


def held_out(docs: DataFrame) -> Column:
    """Whether the CRC-32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per document, learned from those not held out."""
    profiles = learn(docs.where(docs["doc_id"].isNotNull() & ~held_out(docs)))
    found = docs.select(docs["doc_id"].alias("doc_id"), held_out(docs).alias("held_out"),
                        prediction(docs["text"], profiles).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"),
                        F.col("p.score").alias("score"))
