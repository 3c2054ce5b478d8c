"""The corpus pipeline: toxicity, exact dedup, near dedup, source mixing, packing, over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.exact_dedup import exact_dedup
from fieldglass.llm.mixing import mix_sources
from fieldglass.llm.near_dedup import near_dedup
from fieldglass.llm.packing import pack
from fieldglass.llm.queries import word_tokenizer
from fieldglass.llm.shared import written
from fieldglass.llm.toxicity import learn, without_toxic


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labelled documents but the held-out third, doesn't reject."""
    return without_toxic(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), parts=3, part=1))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    taken = mix_sources(docs, rows_too=True).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences."""
    return pack(docs, word_tokenizer(), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("near_dedup", unlike),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the signatures and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
