"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import contamination, mixing, near, quality, substring
from textloom.llm.common import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express the first, second and third stage; tests/llm/test_rest.py holds each stage against brute force.
ORACLE_SQL = None


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier calls good stay.

    Null and empty texts are scored as such, equal rows fare alike; without usable labels, and for an empty table, all stay."""
    return quality.classify(docs.select(*COLUMNS), _read(spark, sf_dir, "labels")).where("good").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least doc_id stays.

    Null texts are equal to empty ones; a null doc_id comes after all others. Of rows that share doc_id and text one
    stays: the least by lang, source and n_chars."""
    key = [F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id")]  # joined and numbered by the same columns: one shuffle
    first = near.near_duplicates(docs).where("first").select(*key, F.col("same").alias("_same")).distinct()
    same = F.substring(F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)), 1, 16)
    row = docs.select(*COLUMNS, *key, same.alias("_same")).join(first, ["_none", "_id", "_same"], "left_semi")
    one = F.row_number().over(Window.partitionBy("_none", "_id", "_same").orderBy("lang", "source", "n_chars"))
    return row.withColumn("_n", one).where("_n = 1").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings go from the texts; a document of which nothing but blanks is left goes too.

    A text without repeats stays as it is, and a null text becomes an empty one. n_chars is that of the new text."""
    cut = substring.dedup_bytes(docs.select(*COLUMNS), with_text=True, columns=("lang", "source", "n_chars"))
    gone = F.col("n_removed") > 0
    kept = cut.where(~gone | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(gone, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts stay, equal rows fare alike."""
    return contamination.decontaminate(docs.select(*COLUMNS), _read(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is there as often as the mix takes it; copy counts from 0. A null source is a source of its own."""
    got = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return got.select("row.*", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("suffix_array_dedup", suffix_array_dedup), ("decontamination", decontamination), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`. Their files lie in the shared folder; an empty table passes through every stage."""
    sc = spark.sparkContext
    folder = f"{shared_folder(sc).rstrip('/')}/pipeline-{sc.applicationId}-{sc._jvm.java.util.UUID.randomUUID()}"
    docs = _read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
