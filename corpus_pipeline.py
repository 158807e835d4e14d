"""Documents to training mix: quality rules, near-dedup, benchmark decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of documents, the last one with the mix's own behind them.
Rows whose doc_id is null, repeated rows and extra columns pass every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm import decontaminate, minhash, mixing, pii, quality
from tesseral.llm.common import materialize, read_table, split_by, stored


#: Texts whose sets of five-word shingles have a similarity of 0.8 or more are near copies; 40 bands of 5 rows miss 1.3e-7 of the pairs at 0.8.
NEAR = minhash.Params(shingle=5, percent=80, bands=40, rows=5)


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, as the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the likelihood ratio reject go."""
    trusted = quality.trusted_ids(read_table(spark, sf_dir, "labels"), "doc_id", quality.Params())
    return quality.keep_good(docs, quality.fit(docs, trusted))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one of the smallest id; of repeated rows of it, one.

    Only rows whose id goes or repeats are joined; the others pass by a filter of fixed size and are not shuffled.
    """
    gone = materialize(minhash.near_duplicates(docs, params=NEAR).where("not kept").select("doc_id").distinct(), "gone")
    twice = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    asked, others = split_by(docs, "doc_id", materialize(gone.unionByName(twice), "asked"), "doc_id")
    left = asked.join(gone.select(F.col("doc_id").alias("__gone")), F.col("doc_id") == F.col("__gone"), "left_anti")
    return others.unionByName(left.dropDuplicates(["doc_id"]))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a whole window of eight benchmark words go, or windows of two items: op9's verdict, and no weaker for a long passage of one item. One short item alone takes no document away."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    return _with_length(pii.redact(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drawn copies with their shard and place."""
    return mixing.mix(docs)


STAGES = [("quality rules", quality_stage), ("near-dedup", dedup_stage), ("decontamination", decontaminate_stage), ("personal data", pii_stage), ("mixing", mixing_stage)]
#: The likelihood ratio is learnt by hashed n-grams, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage stored on its way is removed, and so is its input but for the documents."""
    docs = read_table(spark, sf_dir, "documents")
    with stored(spark) as keep_last:
        for k, (_, stage) in enumerate(STAGES):
            with stored(spark) as keep:
                docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
                keep(docs)
        keep_last(docs)
    return docs
