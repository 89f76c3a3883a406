"""Filter interaction audit: what every filter removes, in every order of the filters.

1. One pass over the texts gives each document a row number, its part and the filters that
   it fails. A filter that looks at other documents (the same text under a smaller id) adds
   its failing rows by a join on a digest of the text; labels by a join on the id.
2. Failing rows become posting lists: per part, range of row numbers and filter a sorted list
   of row numbers. A range has ``RANGE`` rows at most, however large its part is.
3. A task merges the lists of one part and range. The k-way merge visits rows in ascending
   order; where one list alone has rows up to the next head of the others, it finds the end
   of that stretch by galloping (doubling steps, then bisection) and counts it at once. So
   every failing row is counted once, under the set of lists that hold it, and the sizes of
   all unions and differences of lists are sums of these numbers.
4. The numbers of all ranges add up to one row per part, which gives the result of every
   order and step.

A null text is empty, a null part is the empty part. A null id is neither smaller than
another nor labelled; repeated rows count each. An id counts as labelled where any row of
``labels`` says so. No documents: no rows. Only the columns named are looked at, whatever
else the tables hold.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import permutations

import numpy as np
import pyarrow as pa

from ebbtide.llm.scratch import stored
from ebbtide.llm.words import WORD
from pyspark.sql import Column, DataFrame, functions as F

#: Row numbers of one posting list lie within so many: 2 ** BITS.
BITS = 16
RANGE = 1 << BITS
#: There are n! orders of n filters.
MOST_FILTERS = 6

Filter = Callable[[Column, Column], Column]


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 100


def repetitive(text: Column, words: Column) -> Column:
    return F.lit(100) * F.size(F.array_distinct(words)) < F.lit(80) * F.size(words)


def shouting(text: Column, words: Column) -> Column:
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return F.lit(100) * capitals > F.lit(10) * F.length(text)


def symbols(text: Column, words: Column) -> Column:
    return F.rlike(text, F.lit(r"[#$%&*|]"))


#: Filters that look at one text; true where it fails.
FILTERS: dict[str, Filter] = {"A": few_words, "B": repetitive, "C": shouting, "D": symbols}
#: The filter for texts that a smaller id has too.
REPEATED = "E"
LABELS = {"good": "quality = 1", "toxic": "toxic = 1"}


def flagged(docs: DataFrame, filters: dict[str, Filter], part: str) -> DataFrame:
    """``(row, doc_id, part, fails, digest)``: the places of the filters each text fails."""
    words = docs.select(
        docs["doc_id"].alias("doc_id"), F.coalesce(docs[part], F.lit("")).alias("part"),
        F.coalesce(docs["text"], F.lit("")).alias("text")).withColumn(
        "words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    fails = [F.when(fails(F.col("text"), F.col("words")), F.lit(i))
             for i, fails in enumerate(filters.values())]
    return words.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "part",
        F.array_compact(F.array(*fails)).alias("fails"),
        F.unhex(F.sha2("text", 256)).alias("digest"))


def _repeats(rows: DataFrame) -> DataFrame:
    """Rows whose text another row with a smaller id has."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"),
                                       F.max("doc_id").alias("last"))
    first = stored(first.where("first < last").select("digest", "first"), "first-texts")
    return rows.join(first, "digest").where("doc_id > first")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``(row, part, lists)``: rows with a label that counts, and the names of those."""
    known = labels.groupBy(labels["doc_id"].alias("doc_id")).agg(
        *[F.coalesce(F.bool_or(F.expr(rule)), F.lit(False)).alias(name)
          for name, rule in LABELS.items()])
    known = stored(known.where(" OR ".join(LABELS)).where("doc_id IS NOT NULL"), "labels")
    return rows.join(known, "doc_id")


def postings(rows: DataFrame, names: Sequence[str], labels: DataFrame) -> DataFrame:
    """``(part, range, <list>...)``: the sorted row numbers, within the range, of every list.

    ``rows`` are a stored result of ``flagged``; the lists are those of ``names``, of the
    repeated texts, and of the labels.
    """
    at = (F.shiftrightunsigned("row", BITS).alias("range"),
          F.col("row").bitwiseAND(F.lit(RANGE - 1)).cast("int").alias("id"))
    n = len(names)
    own = rows.select("part", *at, F.explode("fails").alias("list"))
    repeats = _repeats(rows).select("part", *at, F.lit(n).alias("list"))
    marks = _labelled(rows, labels)
    marks = marks.select("part", *at, F.explode(F.array_compact(F.array(
        *[F.when(F.col(name), F.lit(n + 1 + i)) for i, name in enumerate(LABELS)]))).alias("list"))
    lists = [*names, REPEATED, *LABELS]
    return own.unionAll(repeats).unionAll(marks).groupBy("part", "range").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("list") == i, F.col("id")))).alias(name)
        for i, name in enumerate(lists)])


def gallop(ids: Sequence[int], at: int, target: int) -> int:
    """The first place from ``at`` on that has ``target`` or more."""
    step, low = 1, at
    while low + step < len(ids) and ids[low + step] < target:
        low += step
        step *= 2
    return bisect_left(ids, target, low, min(low + step, len(ids)))


def merged(lists: Sequence[Sequence[int]]) -> Counter[int]:
    """How many ids are in exactly the lists of a set; sets are bit masks."""
    heads = [(ids[0], i) for i, ids in enumerate(lists) if ids]
    heapify(heads)
    at, found = [0] * len(lists), Counter()
    while heads:
        low, i = heappop(heads)
        members = [i]
        while heads and heads[0][0] == low:
            members.append(heappop(heads)[1])
        if len(members) > 1:
            end = at[i] + 1
        else:
            end = gallop(lists[i], at[i], heads[0][0]) if heads else len(lists[i])
        found[sum(1 << m for m in members)] += end - at[i]
        for m in members:
            at[m] = end if m == i else at[m] + 1
            if at[m] < len(lists[m]):
                heappush(heads, (lists[m][at[m]], m))
    return found


def _sizes(lists: DataFrame) -> DataFrame:
    """``(part, members, n)``: what each part and range has in exactly these lists."""
    names = lists.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = merged([batch.column(name)[i].values.to_pylist() for name in names])
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("part")[i].as_py()] * len(found), pa.string()),
                    pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())],
                    names=["part", "members", "n"])

    return lists.mapInArrow(run, "part string, members long, n long")


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: In place of a set of lists: all documents of the part.
ALL = -1


def _outcomes(sizes: np.ndarray, total: int, names: Sequence[str]) -> dict[str, list]:
    """Rows of every order and step from a part's size for each set of lists."""
    n = len(names)
    sets = np.arange(len(sizes))
    fails = sets & ((1 << n) - 1)
    found: dict[str, list] = {c: [] for c in ("filter_order", "step", *COUNTS)}
    shares: Counter[str] = Counter()
    letters = []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order):
            bit = 1 << f
            removed = np.where((fails & bit > 0) & (fails & before == 0), sizes, 0)
            gone = int(sizes[fails & (before | bit) > 0].sum())
            row = {
                "filter_order": "".join(names[x] for x in order), "step": step + 1,
                "kept": total - gone, "removed": int(removed.sum()),
                "redundant": int(sizes[(fails & bit > 0) & (fails & before > 0)].sum()),
                "unique_fails": int(sizes[fails == bit].sum()),
                "good_lost": int(removed[sets & (1 << n) > 0].sum()),
                "toxic_lost": int(removed[sets & (2 << n) > 0].sum()), "shapley": 0}
            for c, value in row.items():
                found[c].append(value)
            letters.append(names[f])
            shares[names[f]] += row["removed"]
            before |= bit
    found["shapley"] = [shares[letter] for letter in letters]
    return found


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] = FILTERS,
          part: str = "lang") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley)``: one row per part, order of the filters and step.

    ``filters`` are one-letter names of conditions on a text and its words, true where it
    fails; ``E`` stands for the text of a smaller id. ``removed`` fail the step's filter and
    none before, ``redundant`` also one before, ``unique_fails`` no other at all; ``shapley``
    is what the filter removes in all orders together.
    """
    if REPEATED in filters or len(filters) >= MOST_FILTERS or any(len(f) != 1 for f in filters):
        raise ValueError(f"up to {MOST_FILTERS - 1} filters with one-letter names but {REPEATED}")
    names = [*filters, REPEATED]
    rows = stored(flagged(docs, filters, part), "flags")
    lists = stored(postings(rows, list(filters), labels), "postings")
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.lit(ALL).cast("long").alias("members"), "n")
    sizes = _sizes(lists).unionAll(totals).groupBy("part", "members").agg(F.sum("n").alias("n"))
    # At most one entry for every set of lists.
    parts = sizes.groupBy("part").agg(F.collect_list("members").alias("members"),
                                      F.collect_list("n").alias("n"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    sets = 1 << (len(names) + len(LABELS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                known = dict(zip(one["members"], one["n"]))
                total = known.pop(ALL)
                sizes = np.zeros(sets, np.int64)
                sizes[list(known.keys())] = list(known.values())
                found = _outcomes(sizes, total, names)
                n = len(found["step"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one["part"]] * n, pa.string()), pa.array(found["filter_order"]),
                     pa.array(found["step"], pa.int32()),
                     *[pa.array(found[c], pa.int64()) for c in COUNTS]],
                    names=["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, schema)
