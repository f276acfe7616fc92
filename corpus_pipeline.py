"""A training corpus from raw documents: language, near duplicates, benchmark passages, personal values, sequences."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.llm import decontam, langid, near_dup, packing, pii
from termflow.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; models learn from the rows that have a language."""
    model = langid.train(docs)
    return langid.identify(docs, model, names=("_lang", "_score", "_accepted")).where("_accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class."""
    return near_dup.keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    found = decontam.flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits="_hits")
    return found.where(F.size("_hits") == 0).select(*docs.columns)


def personal_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal values; n_chars follows the text."""
    out = pii.pseudonymise(docs, spans=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence each is in and its place there."""
    return packing.with_text(packing.pack(packing.items_of(docs)), docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("pii", personal_values),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The stages' models and recursions are beyond SQL; tests compare them with brute force.
ORACLE_SQL: str | None = None
