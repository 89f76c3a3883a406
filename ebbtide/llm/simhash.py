"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for each of 64 majority votes over the XXH64 hashes of a text's
word shingles. Bit masks are built from a linear code (Pagh, 2016): with radius r, bit i
gets a nonzero vector a(i) of r + 1 bits, and mask v keeps the bits whose a(i) has odd
overlap with v. The a(i) of any r bits span at most r dimensions, so some v overlaps
evenly with all of them: that mask ignores all r bits, and both fingerprints fall into one
bucket of its table. No pair within the radius is missed.

Only distinct fingerprints are compared. A bucket of many of them is split again by the
same construction on the bits its mask ignores; as these at least halve, no bucket stays
large. Of a bucket come only links to the smallest member that is reached, never all pairs.

Texts: null or without words: fingerprint zero. Fewer words than a shingle: the whole
sequence. Rows without doc_id are linked like any other; a group without any id has a null
component_id. Repeated rows give repeated results. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from ebbtide.llm.components import components
from ebbtide.llm.scratch import drop, keep_rows, mark, narrow, stored
from pyspark.sql import Column, DataFrame, functions as F

BITS = 64
FULL = (1 << BITS) - 1
SEED = 42
#: Distinct fingerprints of one bucket that a task compares; more are split by finer masks.
CROWD = 512
PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit fingerprint, unsigned."""
    words = [] if text is None else text.encode().lower().split()
    if not words:
        return 0
    votes, n = np.zeros(BITS, dtype=np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, PIECE):
        piece = words[at:at + PIECE + shingle - 1]
        grams = map(b" ".join, zip(*(piece[i:] for i in range(shingle)))) \
            if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprint_udf(shingle: int):
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return of


def fingerprints(docs: DataFrame, shingle: int = 3, marked: bool = False) -> DataFrame:
    """``(doc_id, fp)`` per row, with ``mark`` if asked; fp is the fingerprint as a signed long."""
    rows = narrow(docs, ["doc_id", "text"])
    return rows.select("doc_id", _fingerprint_udf(shingle)("text").alias("fp"),
                       *[mark(rows).alias("mark")] * marked)


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions; any ``radius`` of them are ignored by some mask."""
    size = 1 << (radius + 1)
    vector = {bit: 1 + i % (size - 1) for i, bit in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, size)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _deeper(masks: list[int], radius: int) -> list[tuple[int, int, int]]:
    """(table, finer table, finer mask): what each mask ignores is covered once more."""
    found = []
    for at, mask in enumerate(masks):
        rest = [b for b in range(BITS) if not mask >> b & 1]
        found += [(at, finer | mask) for finer in covering_masks(rest, radius)]
    return [(at, i, _signed(finer)) for i, (at, finer) in enumerate(found)]


def _connected(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """For each value that chains of pairs within the radius connect to a smaller one: the
    smallest such, and the value."""
    values = np.sort(values)
    left, links, bits = np.ones(len(values), dtype=bool), [], values.view(np.uint64)
    for start in range(len(values)):
        if not left[start]:
            continue
        left[start] = False
        ahead = [start]
        while ahead:
            at = ahead.pop()
            others = np.flatnonzero(left)
            near = others[np.bitwise_count(bits[others] ^ bits[at]) <= radius]
            left[near] = False
            ahead.extend(near.tolist())
            links += [(int(values[start]), int(values[x])) for x in near]
    return links


def _links_of_buckets(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0).to_pylist():
                if len(members) == 2:
                    x, y = members
                    pairs = [(x, y)] if ((x ^ y) & FULL).bit_count() <= radius else []
                else:
                    pairs = _connected(np.array(members, dtype=np.int64), radius)
                a += [x for x, _ in pairs]
                b += [y for _, y in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``(a, b)`` that connect what chains of pairs within the radius connect.

    ``prints`` has distinct fingerprints in a column ``fp``. Of each bucket, the members
    that are connected within it are linked to the smallest of them.
    """
    spark = prints.sparkSession
    masks = covering_masks(list(range(BITS)), radius)
    cells = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for i, m in enumerate(masks)])).alias("c")).select("fp", "c.table", "c.key")
    found = None
    while True:
        sizes = cells.groupBy("table", "key").count().where("count > 1")
        shared = stored(cells.join(sizes, ["table", "key"]), "buckets")
        few = (shared.where(F.col("count") <= CROWD).groupBy("table", "key")
               .agg(F.collect_list("fp").alias("members")).select("members"))
        part = stored(_links_of_buckets(few, radius).distinct(), "pairs")
        found = part if found is None else found.unionAll(part)
        crowds = shared.where(F.col("count") > CROWD).select("table", "fp")
        if crowds.isEmpty():
            drop(shared)
            return found
        finer = _deeper(masks, radius)
        masks = [m & FULL for _, _, m in finer]
        # (2 ** (radius + 1) - 1) ** depth rows: a size that no table changes.
        steps = spark.createDataFrame(finer, "table int, finer int, mask long")
        cells = crowds.join(F.broadcast(steps), "table").select(
            "fp", F.col("finer").alias("table"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3, marked: bool = False
           ) -> DataFrame:
    """``(doc_id, fp, root, component_id)`` per row of the documents, with ``mark`` if asked.

    component_id is the smallest doc_id that chains of fingerprints within the radius
    reach, root the smallest such fingerprint.
    """
    prints = stored(fingerprints(docs, shingle, marked), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = stored(nodes.join(linked, "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(member, "fp").select("doc_id", "fp", "root", "component_id",
                                            *["mark"] * marked)


def hexadecimal(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One document of each group: the one with the smallest doc_id; all columns stay.

    Of a group's rows that repeat that doc_id one stays. Another group's rows of that id are
    told apart by their texts. A group without any id keeps one row.
    """
    found = stored(groups(docs, shingle, radius, marked=True), "groups")
    kept = (found.where("doc_id = component_id").groupBy("root", "doc_id", "mark").count()
            .groupBy("root", "doc_id").agg(F.min(F.struct("mark", "count")).alias("r"))
            .select("doc_id", "r.mark", F.col("r.count").alias("rows")))
    often = kept.where("rows > 1").select("doc_id", "mark")
    result = keep_rows(docs, kept.where("rows = 1").select("doc_id", "mark"))
    if not often.isEmpty():
        result = result.unionByName(keep_rows(docs, often).dropDuplicates(["doc_id", "text"]))
    nameless = found.where("component_id IS NULL").select(
        F.col("fp").alias("__fp"), F.col("root").alias("__root")).distinct()
    if not nameless.isEmpty():
        lone = (docs.where(docs["doc_id"].isNull())
                .withColumn("__fp", _fingerprint_udf(shingle)(docs["text"]))
                .join(nameless, "__fp").dropDuplicates(["__root"]).select(*docs.columns))
        result = result.unionByName(lone)
    return result
