"""The training-data pipeline: five stages, each over all the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), with ``docs`` the table the
stage before left, and all but the last return the columns of ``documents``. SQL cannot express
the stages, so ``ORACLE_SQL`` is None; ``tests/llm/test_pipeline.py`` holds them against plain versions, the quality model's verdicts aside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.llm import decontamination, hamming_dedup, quality_ranking, source_mixing, suffix_dedup
from eventloom.llm.storage import ship_package, stored

ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """(row, text): the other columns in one, so that no name clashes with a result's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")


def unpacked(frame: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The columns again, some of them changed."""
    known = {"text": F.col("text")} | changed
    return frame.select(*[known.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality_ranking.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(quality_ranking.quality_scores(packed(docs), model).filter("predicted = 1"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    return hamming_dedup.without_near_duplicates(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 200 bytes go from the texts; a document of which nothing is left stays,
    with an empty text."""
    cleaned = suffix_dedup.without_repeats(packed(docs), "row")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return unpacked(cleaned, docs.columns, text=text, n_chars=F.char_length(text).cast("long"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return source_mixing.mixed_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
