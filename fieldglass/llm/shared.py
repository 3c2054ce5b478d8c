"""Shared storage, size-checked lookups and distributed connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 10_000
#: A key with more than 1 / HOT_SHARE of all rows is hot; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
SALTS = 64
#: Edges of a graph that one task contracts.
TASK_EDGES = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one, but only if the master is local."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.fieldglass.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="fieldglass-")
        spark.conf.set("spark.fieldglass.shared.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fieldglass/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def renamed(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the named expressions, so extra columns of any name can't clash with an operator's own."""
    return df.select(*(c.alias(k) for k, c in columns.items()))


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """Join left to right, which has one row for each non-null key and in `weight` the number of left's rows with it.

    right is read several times, so it should be a written table. If it has up to BROADCAST_ROWS rows, as counted, it is
    broadcast. Beyond that, keys with over total / HOT_SHARE rows
    (fewer than HOT_SHARE of them) are salted, so that no task gets a whole hot key. The salt is a hash of left's row, so
    a task that is run again deals its rows in the same way.
    """
    limit = max(1, total // HOT_SHARE)
    rows, hot_rows = right.agg(F.count("*"), F.count_if(F.col(weight) > limit)).first()
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(weight)), key, how)
    if not hot_rows:
        return left.join(right.drop(weight), key, how)
    # Maps and variants can't be hashed.
    own = [f.name for f in left.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    hot = right.filter(F.col(weight) > limit)
    salted = left.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*own), F.lit(SALTS)).cast("int")).otherwise(0)
    )
    spread = F.when(F.col(weight) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    sides = right.select("*", F.explode(spread).alias("_salt")).drop(weight)
    return salted.join(sides, [key, "_salt"], how).drop("_hot", "_salt")


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """In each of `parts` partitions the edges (lo, hi) of a star for each component that the partition's own edges make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := home.setdefault(x, x)) != x:
                home[x] = home.setdefault(up, up)
                x = home[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                home[max(a, b)] = min(a, b)
        nodes = [x for x in home if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["lo", "hi"])

    return edges.select("lo", "hi").coalesce(parts).mapInArrow(run, "lo long, hi long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), bigint: one row (node, component) for each node, component the least node.

    Edges are contracted within partitions of about TASK_EDGES. If there are several, alternating large-star and small-star
    steps follow (Kiveris et al., 2014), each written to the shared folder; nothing is collected but sums. Empty edges give
    an empty result.
    """
    now = written(edges.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    size, before = now.count(), None
    if not size:
        return now.select(F.col("lo").alias("node"), F.col("hi").alias("component"))
    parts = -(-size // TASK_EDGES)
    now = written(_contracted(now, parts).distinct(), "edges")
    for _ in range(most_rounds if parts > 1 else 0):
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = lookup(both.filter("v > u"), written(least, "least"), "u", "n", size, "inner").select("m", "v").filter("m <> v").distinct()
        large = written(large, "large")
        down = large.groupBy("v").agg(F.min("m").alias("m"), F.count("*").alias("n"))
        small = lookup(large.withColumnRenamed("m", "w"), written(down, "down"), "v", "n", 2 * size, "inner")
        stepped = small.select(F.col("m").alias("lo"), F.col("v").alias("hi")).union(small.select(F.col("m").alias("lo"), F.col("w").alias("hi")))
        now = written(stepped.filter("lo <> hi").distinct(), "edges")
        after = now.agg(F.count("*"), F.sum("lo"), F.sum("hi"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"),
        F.col("lo").alias("component")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
