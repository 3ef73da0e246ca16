"""Cleaning a corpus for training: stages over ``documents``, each written and read again.

Every stage but the last returns the columns of ``documents`` (doc_id, text, lang,
source, n_chars) of the documents it keeps; columns beside these are not carried.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, decontamination, language_id, line_dedup, simhash
from tidegrid.session import scratch_path, write_and_read

VOCABULARY = "byte_bpe_50k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on; texts without a letter and uncertain ones go."""
    docs = docs.select(*COLUMNS)
    return language_id.accepted(docs, language_id.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document only; ``n_chars`` is counted anew, no document goes."""
    kept = line_dedup.dedup_lines(docs, scratch_path(spark, "pipeline-index"), carry=("lang", "source"))
    return kept.select(
        "doc_id", "text", "carried.lang", "carried.source", F.char_length("text").cast("long").alias("n_chars")
    )


def _row() -> Column:
    """Tells rows apart that differ in any column, also those of one id or without one."""
    return F.xxhash64(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays (by the texts' hash among rows of one id).

    Rows of one id or of null ids are documents of their own; equal rows are one.
    """
    rows = docs.select(*COLUMNS, _row().alias("_row"))
    groups = simhash.near_duplicates(rows, shingle=3, max_bits=2, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    # the hash of the text orders rows of one id, as texts are too long to be carried along
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("text"), "_row")
    own = rows.select("_row", place.alias("place")).join(groups.distinct(), "_row")
    stay = own.groupBy("component_id").agg(F.min("place").alias("first")).select("first._row")
    return rows.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, each row judged for itself."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(*COLUMNS, _row().alias("_row"))
    hits = decontamination.contaminations(rows, benchmark, id_col="_row")
    hits = write_and_read(hits.select(F.col("doc_id").alias("_row")).distinct(), "pipeline-hits")
    return rows.join(hits, "_row", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of what is left, and the digest of the text they decode to."""
    path = public_tokenizers.path(VOCABULARY)
    tokens = bpe.encode_and_decode(docs, path)
    return tokens.select(
        "doc_id", bpe.token_count(), "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SQL can express neither the trained classifier nor BPE; the tests hold a run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
