"""Mixing sources to target weights: Efraimidis-Spirakis keys, whole epochs before a weighted fraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.shared import lookup, renamed, written

#: Rows of one source that are put in order in one task.
BUCKET_ROWS = 200


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of the whole text; 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def letter_share(text: Column, size: Column) -> Column:
    """A document's quality weight, from 0.5 to 1.5: near 1.5 where words are as long as in prose, less for tables and junk."""
    mean = F.length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    return F.lit(0.5) + F.least(mean, F.lit(8.0)) / F.lit(8.0)


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sources (source_key, source_size, n) with `target`: share of all words, dealt by weight, none above most * its size.

    The level at which all sources but the full ones stand is found by one pass over the sources in order of
    most * size / weight: those below it are full, the others share what is left by weight.
    """
    order = Window.orderBy("source_key")
    weighed = sources.withColumn("_w",
        F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")))
    filled = weighed.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "source_key")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    leveled = filled.withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(everything)).withColumn(
        "_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    )
    # A source is full if the level that it and the later ones would get is at or above its own cap.
    full = F.col("_level") * F.col("_w") >= F.col("_cap")
    first_open = F.first(F.when(~full, F.col("_level")), True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("_open", first_open).select(
        *sources.columns, F.when(full, F.col("_cap")).otherwise(F.col("_open") * F.col("_w")).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
    quality: Column | None = None,
    rows_too: bool = False,
) -> DataFrame:
    """One row for every input row: doc_id, size, source_size, target, copies, taken (and with rows_too, the whole row as row).

    Sources in code point order, null last, weigh `weights` in turn. Their targets share `share` of all words, none above
    `most` times its source's words. A document is taken floor(target / source_size) times (complete epochs); the rest of
    the target goes to the documents with the least keys -ln(u) / quality, u an MD5 of seed, id and size, up to the one
    with which the sum comes nearest the target. Whole documents are taken. taken is in words, repeats counted. quality
    is any expression of docs's columns (by default letter_share of the text); weights of null or at most 0 count as 1e-9. Null and empty texts have size 0 and are taken 0 words. Equal keys
    are told apart by id and size; repeated rows that tie in everything are interchangeable. Reruns agree. An empty table
    gives an empty result.

    A source may hold any share of the rows: its keys are cut into buckets of about BUCKET_ROWS rows by a monotone map of
    the key, buckets are summed, and only the bucket in which the target falls is put in order.
    """
    text, keep = F.col(text_col), ["row"] if rows_too else []
    # The caller's columns are read here and nowhere below.
    weight = quality if quality is not None else letter_share(text, word_count(text))
    source = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    sized = docs.select(
        *([F.struct("*").alias("row")] if rows_too else []), F.col(id_col).alias("doc_id"), source.alias("source_key"),
        word_count(text).alias("size"),
        F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-9)).alias("weight"),
    )
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    rows = written(
        sized.select(
            *keep,
            "doc_id",
            "source_key",
            "size",
            (-F.log(uniform) / F.col("weight")).alias("key"),
        ),
        "sizes",
    )
    sources = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.avg(F.log("key")).alias("mean"),
        F.stddev_pop(F.log("key")).alias("sd"))
    plan = written(
        source_targets(sources, weights, share, most)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS))),
        "plan",
    )
    total = plan.agg(F.sum("n")).first()[0] or 0
    # A logistic curve of the key's logarithm, which a few keys that are huge, of weights near 0, hardly move.
    place = 1 / (1 + F.exp(-1.7 * (F.log("key") - F.col("mean")) / F.greatest("sd", F.lit(1e-9))))
    dealt = lookup(rows, plan, "source_key", "n", total).withColumn(
        "bucket", F.least(F.floor(place * F.col("buckets")), F.col("buckets") - 1)
    )
    sums = dealt.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    running = F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket"))
    edge = written(
        sums.withColumn("_before",
        running - F.col("words")).filter((F.col("_before") <= F.col("left")) & (F.col("_before") + F.col("words") > F.col("left")))
        .groupBy("source_key").agg(F.min(F.struct("bucket", "_before")).alias("e")).select("source_key", F.col("e.bucket").alias("edge"),
        F.col("e._before").alias("before")),
        "edge",
    )
    n_rows = plan.select("source_key", "n")
    placed = lookup(dealt, written(edge.join(n_rows, "source_key"), "edges"), "source_key", "n", total)
    at_edge = placed.filter(F.col("bucket") == F.col("edge"))
    within = Window.partitionBy("source_key").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding,
        Window.currentRow)
    ordered = at_edge.withColumn("_sum", F.col("before") + F.sum("size").over(within)).withColumn("more",
        (F.col("_sum") - F.col("size") / 2 <= F.col("left")).cast("long"))
    others = placed.filter(~F.col("bucket").eqNullSafe(F.col("edge"))).withColumn(
        "more", F.coalesce(F.col("bucket") < F.col("edge"), F.col("left") > 0).cast("long")
    )
    columns = [*keep, "doc_id", "size", "source_size", "target", "epochs", "more"]
    both = ordered.select(columns).unionByName(others.select(columns))
    copies = F.when(F.col("size") > 0, F.least(F.col("epochs") + F.col("more"), F.lit(int(most)))).otherwise(0).cast("long")
    return both.select(*keep, "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"),
        (copies * F.col("size")).alias("taken"))
