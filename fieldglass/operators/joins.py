"""Joins beyond equality: as-of, interval, positional, nearest, and merges in which one side wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row of each key: the first in the order given. Only the columns' struct is aggregated, so copies combine before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    ranked = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*ranked, *others)).alias("_first"))
    return picked.select(*keys, *(F.col("_first")[c].alias(c) for c in others)).select(df.columns)


def label_merge(left: DataFrame, right: DataFrame, left_key: str, right_key: str, labels: Sequence[str], text: str, source: str = "labels_source",
    source_name: str = "merged") -> DataFrame:
    """Left join of labels: the left's own columns of those names go, the right's text is preferred and the left's is kept
    as <text>_original, and `source` is set where the first label is known. NULL right keys match nothing; repeated
    right keys repeat the row."""
    own = left.drop(*(c for c in labels if c in left.columns))
    told = right.filter(F.col(right_key).isNotNull()).select(F.col(right_key).alias("_key"), *labels, F.col(text).alias("_text"))
    joined = own.join(told, F.col(left_key) == F.col("_key"), "left")
    kept = [c for c in own.columns if c != text]
    return joined.select(*kept, F.col(text).alias(f"{text}_original"), F.coalesce("_text", text).alias(text), *labels,
        F.when(F.col(labels[0]).isNotNull(), source_name).alias(source))


def alias_table(df: DataFrame, id_col: str, *names: str) -> DataFrame:
    """(alias, id): each entity under each of its names, lower-cased; and the pair of the first two, 'a b'."""
    forms = F.array(*(F.lower(F.trim(F.col(n).cast("string"))) for n in names),
        *([F.lower(F.concat_ws(" ", names[0], names[1]))] if len(names) > 1 else []))
    return df.select(F.explode(F.array_distinct(F.array_compact(forms))).alias("alias"), F.col(id_col).alias("id")).filter("alias <> ''")


def resolve(df: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """df with `resolved` (the id, if exactly one entity has the name) and `hits` (how many have)."""
    known = aliases.groupBy("alias").agg(F.countDistinct("id").alias("hits"), F.min("id").alias("_id"))
    joined = df.join(known, F.lower(F.trim(F.col(name))) == F.col("alias"), "left").drop("alias")
    return joined.select(*df.columns, F.when(F.col("hits") == 1, F.col("_id")).alias("resolved"),
        F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def zip_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str, strict: bool = False) -> DataFrame:
    """The n-th row of either side of each key together (`ordinal` from 1). strict: an error unless the counts agree."""
    def numbered(df: DataFrame, order: str, count: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        return df.withColumn("ordinal", F.row_number().over(w.orderBy(order)).cast("long")).withColumn(count, F.count("*").over(w))

    joined = numbered(left, left_order, "_n_left").join(numbered(right, right_order, "_n_right"), [*keys, "ordinal"], "full" if strict else "inner")
    if strict:
        joined = joined.filter(
            F.when(F.col("_n_left").eqNullSafe(F.col("_n_right")), True).otherwise(F.raise_error(F.lit("the two sides differ in number"))))
    return joined.drop("_n_left", "_n_right")


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: float,
    first_by: Sequence[str] = (), point_key: Sequence[str] = ()) -> DataFrame:
    """Each point with the spans [start, end) of its key that hold it. Spans are cut into cells of `width`, so that the join
    is on equality and each pair of point and span meets in one cell. first_by and point_key: only a point's first span by that order."""
    cell = lambda c: F.floor(c / F.lit(width))
    last = F.greatest(cell(F.col(start)), F.ceil(F.col(end) / F.lit(width)) - 1)
    spread = spans.filter(F.col(end) > F.col(start)).withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), last)))
    joined = points.withColumn("_cell", cell(F.col(at))).join(spread,
        [*keys, "_cell"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")
    return first_rows(joined, list(point_key), *(F.col(c) for c in first_by)) if first_by else joined


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, values: Sequence[str], forward: bool = False,
    strict: bool = False) -> DataFrame:
    """Each left row with the values of the right's nearest row of its key at or before it (forward: at or after; strict: not
    at the same time). One sort of both sides together, so nothing multiplies; of right rows at one time the last (forward:
    first) by values stands."""
    payload = F.struct(F.col(right_at).alias("_at"), *values)
    mine = left.select(*left.columns, F.col(left_at).alias("_time"),
        F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_p"), F.lit(1).alias("_side"))
    theirs = right.select(*(F.col(k) if k in keys else F.lit(None).cast(left.schema[k].dataType).alias(k) for k in left.columns),
        F.col(right_at).alias("_time"), payload.alias("_p"), F.lit(0).alias("_side"))
    # At equal times the right comes first unless the match is to be strict.
    order = Window.partitionBy(*keys).orderBy(F.desc("_time") if forward else F.asc("_time"), F.desc("_side") if strict else F.asc("_side"),
        F.desc("_p") if forward else F.asc("_p"))
    seen = F.last("_p", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return mine.unionByName(theirs).withColumn("_m", seen).filter("_side = 1").select(*left.columns, F.col("_m._at").alias(f"matched_{right_at}"),
        *(F.col("_m")[v].alias(v if v not in left.columns else f"matched_{v}") for v in values))


def unseen(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key isn't among those done."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """New rows stand in for old ones of the same key; the rest stays. In order only if one is asked for."""
    both = old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
    return both.orderBy(*order) if order else both


def overlay(df: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with the columns' values from other where it has them."""
    told = other.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return df.join(told, list(keys), "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns))


def layered(df: DataFrame, keys: Sequence[str], layer: str, ranks: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row for each key: each field from the highest layer that has it, ranks from lowest to highest (say live, post, human)."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(layer))
    return df.withColumn("_rank",
        rank).groupBy(*keys).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("_rank"))).alias(f) for f in fields))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], distance: Column, by: Sequence[str], id_col: str) -> DataFrame:
    """For each left row (named by `by`) the right row of its keys at the least distance, ties by id: nearest_id, distance."""
    pairs = left.join(right, list(keys)).withColumn("_d", distance)
    return pairs.groupBy(*keys, *by).agg(F.min(F.struct(F.col("_d").alias("d"), F.col(id_col).alias("id"))).alias("m")).select(*keys, *by,
        F.col("m.id").alias("nearest_id"), F.col("m.d").alias("distance"))
