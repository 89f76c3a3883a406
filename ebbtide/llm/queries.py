"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from ebbtide.llm import (
    chunks,
    cross_entropy,
    decontaminate,
    html_main,
    interactions,
    language,
    mixing,
    nearest,
    secret_scan,
    sharding,
    simhash,
    toxicity,
    whitening,
)
from ebbtide.llm.scratch import table
from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents"), shingle=3, radius=3)
    return found.select("doc_id", simhash.hexadecimal(found["fp"]).alias("fingerprint"),
                        "component_id")


@query
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.placed(table(spark, folder, "documents"), ["doc_id"])
    return found.select(
        F.col("id").alias("doc_id"), F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.drawn(table(spark, folder, "documents"), ["doc_id"])
    copies = F.nvl2("base", F.lit(1), F.lit(0)) + F.nvl2("extra", F.lit(1), F.lit(0))
    return found.select(
        F.col("id").alias("doc_id"), "size", F.col("words").alias("source_size"), "target",
        (F.col("size") * copies).alias("taken"), copies.alias("copies"), "base", "extra")


@query
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"),
                                       table(spark, folder, "benchmark"))
    return found.drop("mark")


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query
def op5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.neighbours(table(spark, folder, "embeddings"))


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(table(spark, folder, "documents"))


@query
def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.repeats(table(spark, folder, "documents")).drop("mark")


@query
def op10_cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").where("quality = 1")
    return cross_entropy.scored(table(spark, folder, "documents"), good)


@query
def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_main.extracted(table(spark, folder, "pages"))


@query
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return interactions.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


@query
def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, folder, "documents"), ["doc_id"])
    fixed = F.filter("spans", lambda s: s["kind"] != "random")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "row.doc_id", *[number(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.listed(fixed), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"))
