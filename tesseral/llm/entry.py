"""The queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lm, minhash, mixing, pii, quality, tokens, urls, warc
from .common import crc32_of_id, read_table
from .sql import ORACLES


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_iban", "n_nid")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(7)) == 2
    model = lm.fit(docs.where(~held_out), F.col("text"))
    return lm.score(docs, model, F.col("doc_id"), held_out, F.col("text"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    trusted = quality.trusted_ids(read_table(spark, sf_dir, "labels"), "doc_id", quality.Params())
    return quality.judge(docs, quality.fit(docs, trusted))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(tokens.token_lengths(read_table(spark, sf_dir, "documents")))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(3)) == 1
    profiles = langid.fit(docs.where(~held_out), F.col("lang"), F.col("text"))
    return langid.predict(docs, profiles, F.col("doc_id"), held_out, F.col("text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_minhash, op2_pii, op3_lm, op4_urls, op5_quality, op6_mixing, op7_tokens, op8_langid, op9_decontamination, op10_warc)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
