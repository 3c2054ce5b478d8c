"""Exact deduplication: groups by 128-bit content hash, with bytes compared inside groups. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.shared import lookup, renamed, written

SPACES = r"[\x20\x09-\x0D]+"


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = squeezed,
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row for every input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are one group if their normalised texts are equal byte for byte: rows are grouped by the content hash together
    with the text itself, so a hash collision makes two groups. Each map task sends one row for each text it has seen,
    however many copies there are. Groups are told apart afterwards by SHA-256; if two different texts ever had the same,
    the query fails instead of merging them. The row with the longest original text and then the
    smallest id stays; null ids count as larger than any id, and of repeated rows that tie in both, all have
    kept = (doc_id is keep_id). Null and empty texts are one group. Other columns of docs are ignored. An empty table
    gives an empty result.
    """
    rows = renamed(docs, doc_id=F.col(id_col), text=normalise(F.col(text_col)), size=F.length(F.coalesce(F.col(text_col), F.lit(""))))
    keyed = rows.select("doc_id", "size", "text", F.unhex(content_hash(F.col("text"))).alias("hash"))
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best")
    by_text = keyed.groupBy("hash", "text").agg(F.count("*").alias("n"), best)
    named = by_text.select(F.unhex(F.sha2("text", 256)).alias("key"), "n", "best")
    groups = written(
        named.groupBy("key").agg(F.count("*").alias("texts"), F.max("n").alias("group_size"), F.min("best").alias("best")).select(
            "key",
            F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts have the same SHA-256"))).alias("group_size"),
            F.col("best.doc_id").alias("keep_id"),
        ),
        "groups",
    )
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    light = rows.select("doc_id", F.sha2("text", 256).alias("text_sha256")).withColumn("key", F.unhex("text_sha256"))
    joined = lookup(light, groups.withColumn("_n", F.col("group_size")), "key", "_n", total)
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, that stay; one of rows that agree in id and text.

    Null and empty texts are one group, of which one row stays; an empty table gives an empty result.
    """
    kept = exact_groups(docs, id_col, text_col).filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times"))
    once = written(kept, "kept")
    rows = docs.select(F.struct("*").alias("all"), F.col(id_col).alias("id"), F.sha2(squeezed(F.col(text_col)), 256).alias("sha"))
    left = rows.join(once, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256")), "left_semi")
    if once.filter("times > 1").limit(1).count():
        left = left.dropDuplicates(["id", "sha"])
    return left.select("all.*")
