"""A training corpus from `documents`: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last give the columns of documents.

Nulls: a document without text is rejected by the first stage. A document whose lines are all repeats of
earlier ones goes in the second. n_chars follows the text where a stage changes it. Hit words of benchmark
items condemn the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, common, decontaminate, language, line_dedup, near_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' own languages; undetermined and uncertain ones go."""
    found = language.identify(docs.select(COLUMNS), language.train(docs))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("lang_score") >= language.CERTAIN)).select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines of repeated three-line windows; a document of which nothing is left goes."""
    out = line_dedup.dedup_lines(docs.select(COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.trim("text") == "")
    return out.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least doc_id stays."""
    drop = near_dedup.near_groups(docs).where("not kept").select("doc_id", "text_hash").distinct()
    return docs.select(COLUMNS).withColumn("text_hash", F.xxhash64("text")).join(drop, ["doc_id", "text_hash"], "left_anti").select(COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    hit = decontaminate.contamination(docs, common.table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id", "text_hash").distinct()
    clean = docs.withColumn("text_hash", F.xxhash64("text")).join(hit, ["doc_id", "text_hash"], "left_anti")
    return clean.select(COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to it."""
    out = bpe.encode_decode(docs.select(COLUMNS), bpe.tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "lang", "source", "n_chars", F.col("bpe_ids").alias("ids"), F.size("bpe_ids").cast("long").alias("n_tokens"), F.col("bpe_decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("BPE", bpe_stage),
]

#: SQL can express neither the network's predictions nor the BPE ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
