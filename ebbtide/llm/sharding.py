"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts form a group. Groups are placed one after the other, the largest
first, each into the shard where the dot product of its demand and the shard's residual
capacity is highest (Panigrahy et al., 2011), of those shards that have room for it in every
measure; where none has, into the one with the most room in bytes. Each measure is taken as
a share of its total.

- A group above half a shard's capacity in any measure is cut into pieces of at most about
  a quarter, by a hash of doc_id, so that no group decides a shard's size. There are at
  most 6 such groups per shard. Rows that repeat one text and doc_id (also a null one) so
  often that the hash could not cut them are numbered, and cut and dealt by that number.
- Items of at least 1/``FINE`` of a shard in any measure number at most 3 * FINE per shard;
  one task places them all.
- All others are sorted into classes of similar size (a factor of two), and each class is
  dealt by hash into bins of about ``BIN`` items. Each bin is packed by its own task into its
  proportional share of what the large items have left free. A bin that is one of many has
  thousands of similar items for each shard, so that all bins together stay balanced.

Slots count the rows of a shard from 0 without gaps: rows are numbered inside cells of a
shard, and cells are offset by the counts of those before. A cell is a hash of doc_id, text
and number, so that neither a hot text nor a hot or null doc_id makes a large one.

Null text: no bytes, no tokens, one row; such rows are one group. Null or repeated doc_ids
and repeated rows are rows like any other. No rows: no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from ebbtide.llm.scratch import stored
from ebbtide.llm.words import word_count
from pyspark.sql import DataFrame, Window, functions as F

SHARDS = 40
OVERHEAD = 16
FINE = 128
BIN = 50_000
CELL = 20_000
#: Rows of one text and doc_id are numbered above this share of a shard, if their text is cut.
HEAVY = 1 / 16
#: Up to so many (text, doc_id) pairs that repeat heavily are broadcast, 40 bytes each.
FEW_PAIRS = 100_000
MEASURES = ["bytes", "tokens", "rows"]
ITEM = "key binary, piece int, shard int"


def _rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    text = docs["text"]
    return docs.select(
        F.struct(*[docs[c] for c in keep]).alias("row"),
        docs["doc_id"].alias("id"),
        F.unhex(F.coalesce(F.md5(text.cast("binary")), F.lit(""))).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("bytes"),
        word_count(text).alias("tokens"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
    )


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"),
                                 F.count(F.lit(1)).alias("rows"))


def _shares(total: dict, shards: int) -> list:
    """Each measure as a share of one shard's capacity."""
    return [F.col(m) * (shards / max(total[m], 1)) for m in MEASURES]


def pack(items: pd.DataFrame, room: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The shard of each item; ``room`` has a row per shard and is used up.

    ``unit`` scales the measures. The order is by largest demand, then key and piece.
    """
    demand = items[MEASURES].to_numpy(dtype=float) / unit
    room = room / unit
    order = sorted(range(len(items)), key=lambda i: (-demand[i].max(), items["key"].iat[i],
                                                     items["piece"].iat[i]))
    shard = np.zeros(len(items), dtype=np.int32)
    for i in order:
        left = room - demand[i]
        fits = left.min(axis=1) >= -1e-9
        match = np.where(fits, room @ demand[i], -np.inf) if fits.any() else left[:, 0]
        best = int(np.argmax(match))
        shard[i] = best
        room[best] = left[best]
    return shard


def _large(items: DataFrame, total: dict, shards: int) -> DataFrame:
    capacity = np.array([max(total[m], 1) / shards for m in MEASURES])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        room = np.tile(capacity, (shards, 1))
        return group.assign(shard=pack(group, room, capacity))[["key", "piece", "shard", *MEASURES]]

    return items.groupBy(F.lit("all").alias("one")).applyInPandas(
        run, ITEM + ", bytes long, tokens long, rows long")


def _small(items: DataFrame, used: np.ndarray, total: dict, shards: int) -> DataFrame:
    capacity = np.array([max(total[m], 1) / shards for m in MEASURES])
    free = capacity - used
    left = np.maximum(free.sum(axis=0), 1e-9)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group[MEASURES].to_numpy(dtype=float).sum(axis=0)
        return group.assign(shard=pack(group, free * (own / left), capacity))[
            ["key", "piece", "shard"]]

    # A share is above 2 ** -63, so there are at most 63 classes.
    share = F.greatest(*_shares(total, shards))
    items = items.withColumn("class", F.floor(-F.log2(share)).cast("int"))
    bins = {r["class"]: -(-r["count"] // BIN) for r in items.groupBy("class").count().collect()}
    count = F.lit(1)
    for size, n in bins.items():
        count = F.when(F.col("class") == size, n).otherwise(count)
    return items.withColumn("bin", F.pmod(F.xxhash64("key", "piece"), count)).groupBy(
        "class", "bin").applyInPandas(run, ITEM)


def _pieces(rows: DataFrame, cut: DataFrame) -> DataFrame:
    piece = F.coalesce(F.pmod("number", F.col("pieces")),
                       F.pmod(F.xxhash64(F.lit(8), "id"), F.col("pieces")))
    return rows.join(F.broadcast(cut), "key", "left").withColumn(
        "piece", F.coalesce(piece, F.lit(0)).cast("int"))


def _groups(rows: DataFrame, shards: int) -> tuple[DataFrame, dict, DataFrame]:
    """The sums of each group and of all, and which groups are cut into how many pieces."""
    groups = stored(_sums(rows, "key"), "groups")
    total = groups.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]).first().asDict()
    share = F.greatest(*_shares(total, shards))
    # At most 6 groups per shard exceed half of it in one of three measures.
    cut = stored(groups.where(share > 0.5)
                 .select("key", F.ceil(share * 4).cast("int").alias("pieces")), "cut")
    return groups, total, cut


def _heavy(rows: DataFrame, groups: DataFrame, cut: DataFrame, total: dict,
           shards: int) -> DataFrame:
    """``(of, by)``: the (key, id) pairs whose rows are to be numbered.

    Only groups that are cut or have more rows than a cell can have one, so only their rows
    are counted by pair.
    """
    share = F.greatest(*_shares(total, shards))
    many = groups.join(F.broadcast(cut), "key", "left").where(
        (F.col("rows") > CELL) | F.col("pieces").isNotNull()).select("key", "pieces")
    if many.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS:
        many = F.broadcast(many)
    pairs = _sums(rows.join(many, "key"), "key", "id", "pieces")
    heavy = (F.col("rows") > CELL) | (F.col("pieces").isNotNull() & (share > HEAVY))
    return stored(pairs.where((F.col("rows") > 1) & heavy).select(
        F.col("key").alias("of"), F.col("id").alias("by")), "heavy")


def _numbered(rows: DataFrame, narrow: DataFrame, heavy: DataFrame) -> list[DataFrame]:
    """Both tables with a ``number``: null but for the rows of the heavy pairs, which are
    written once so that both have the same numbers."""
    few = heavy.count()
    pairs = F.broadcast(heavy) if few <= FEW_PAIRS else heavy

    def side(df: DataFrame, how: str) -> DataFrame:
        same = (df["key"] == pairs["of"]) & df["id"].eqNullSafe(pairs["by"])
        return df.join(pairs, same, how)

    none = F.lit(None).cast("long").alias("number")
    if not few:
        return [df.select("*", none) for df in (rows, narrow)]
    hot = stored(side(rows, "left_semi").select(
        "*", F.monotonically_increasing_id().alias("number")), "hot")
    return [side(df, "left_anti").select("*", none).unionByName(hot.select(*df.columns, "number"))
            for df in (rows, narrow.drop("row"))]


def _items(rows: DataFrame, groups: DataFrame, total: dict, cut: DataFrame,
           shards: int) -> DataFrame:
    """The shard of each (key, piece)."""
    whole = groups.join(F.broadcast(cut), "key", "left_anti").select(
        "key", F.lit(0).alias("piece"), *MEASURES)
    parts = _sums(_pieces(rows, cut).where("pieces IS NOT NULL"), "key", "piece")
    items = stored(whole.unionByName(parts), "items")
    is_large = F.greatest(*_shares(total, shards)) * FINE >= 1
    large = stored(_large(items.where(is_large), total, shards), "large")
    used = np.zeros((shards, len(MEASURES)))
    for r in large.groupBy("shard").agg(*[F.sum(m).alias(m) for m in MEASURES]).collect():
        used[r["shard"]] = [r[m] for m in MEASURES]
    small = _small(items.where(~is_large), used, total, shards)
    return stored(large.select("key", "piece", "shard").unionByName(small), "placed")


def placed(docs: DataFrame, keep: list[str], shards: int = SHARDS) -> DataFrame:
    """``(row, id, bytes, crc, shard, slot)`` per row; ``row`` has the columns to keep.

    Everything is decided on narrow rows. What is kept is read once more and moved twice:
    to its shard, and within it. Rows that are numbered are written once besides.
    """
    narrow = stored(_rows(docs, ["doc_id"]), "rows")
    groups, total, cut = _groups(narrow, shards)
    rows = narrow if keep == ["doc_id"] else _rows(docs, keep)
    heavy = _heavy(narrow, groups, cut, total, shards)
    rows, narrow = _numbered(rows, narrow, heavy)
    items = _items(narrow, groups, total, cut, shards)
    cells = max(1, -(-total["rows"] // (shards * CELL)))

    def dealt(rows: DataFrame) -> DataFrame:
        cell = F.pmod(F.xxhash64(F.lit(9), "id", "key", "number"), F.lit(cells)).cast("int")
        return _pieces(rows, cut).join(items, ["key", "piece"]).withColumn("cell", cell)

    counts = dealt(narrow).groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("shard", "cell", F.coalesce(
        F.sum("count").over(before), F.lit(0)).alias("offset")), "offsets")
    inside = Window.partitionBy("shard", "cell").orderBy("id", "crc", "bytes")
    return (dealt(rows).withColumn("place", F.row_number().over(inside))
            .join(offsets, ["shard", "cell"])
            .select("row", "id", "bytes", "crc", "shard",
                    (F.col("offset") + F.col("place") - 1).alias("slot")))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with their ``shard`` and ``slot``, ready to be written by shard.

    Columns of the documents that are called shard or slot are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed(docs, keep, shards).select(
        *[F.col("row")[c].alias(c) for c in keep], "shard", "slot")
