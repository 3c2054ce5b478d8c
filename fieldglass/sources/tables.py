"""Reading and writing of play tables, payloads and logs. Paths are any that Spark's readers open."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.plays import no_nan, play_summary
from fieldglass.operators.joins import first_rows, unseen

BASE_COLUMNS = ("game_key", "play_uid", "play_index", "is_scrimmage", "is_filmable", "play_id", "game_id", "qtr", "time", "down", "ydstogo", "yrdln",
    "yardline_100", "posteam", "defteam", "play_type", "desc", "yards_gained", "epa", "touchdown", "first_down", "interception", "sack", "shotgun",
    "no_huddle", "goal_to_go", "qb_scramble", "pass_location", "pass_length", "run_location", "run_gap")
LABEL_COLUMNS = ("offense_formation", "offense_personnel", "defense_personnel", "defenders_in_box")


class Paths:
    """Where each artifact lies below a root."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def of(self, kind: str, *parts: str) -> str:
        return "/".join([self.root, kind, *parts])


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as NULL in every float column."""
    return df.select(*(no_nan(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema))


def read_plays(spark: SparkSession, *paths: str) -> DataFrame:
    """Play files of any of the schemas, by column name; NaN as NULL."""
    return without_nan(spark.read.option("mergeSchema", True).parquet(*paths))


def union_tables(first: DataFrame, *others: DataFrame) -> DataFrame:
    out = first
    for df in others:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def one_game(season: DataFrame, game_id: str, wanted: Sequence[str] = (*BASE_COLUMNS, *LABEL_COLUMNS)) -> DataFrame:
    """The rows of one game with the wanted columns that there are; an error that names some games if it has none."""
    rows = season.filter(F.col("game_id") == game_id)
    if rows.isEmpty():
        known = [r[0] for r in season.select("game_id").distinct().orderBy("game_id").limit(40).collect()]
        raise ValueError(f"no game {game_id}; there are {known}")
    return rows.select(*(c for c in wanted if c in rows.columns))


def with_participation(game: DataFrame, participation: DataFrame, labels: Sequence[str] = LABEL_COLUMNS) -> DataFrame:
    """Labels of each play; of repeated plays the first by their values."""
    have = [c for c in labels if c in participation.columns]
    once = first_rows(participation.select("play_id", *have).filter(F.col("play_id").isNotNull()), ["play_id"], *(F.col(c) for c in have))
    return game.drop(*have).join(once, "play_id", "left")


def enriched(plays: DataFrame) -> DataFrame:
    """Plays from scrimmage with grouping, formation, front and package."""
    given = lambda c: F.col(c) if c in plays.columns else F.lit(None).cast("string")
    summary = play_summary(given("offense_personnel"), given("defense_personnel"), given("offense_formation"))
    return plays.filter("is_scrimmage").withColumn("_s", summary).select(*plays.columns, "_s.*")


def load_plays(spark: SparkSession, *paths: str, view: str = "plays") -> DataFrame:
    plays = enriched(read_plays(spark, *paths))
    plays.createOrReplaceTempView(view)
    return plays


def write_plays(plays: DataFrame, path: str) -> None:
    plays.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("game_key").parquet(path)


def strided(frames: DataFrame, start: int, end: int, step: int, at: str = "frame") -> DataFrame:
    """Every step-th frame of [start, end)."""
    return frames.filter((F.col(at) >= start) & (F.col(at) < end) & (F.pmod(F.col(at) - start, F.lit(step)) == 0))


def read_payload(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON payload of whole files; bad records are kept aside as NULL rows."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_payload(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def to_do(frames: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames that the log hasn't yet."""
    return unseen(frames, log, keys)


def registry(live: DataFrame | None, static: DataFrame) -> DataFrame:
    """Teams as the live payload has them, and the fixed ones that it lacks."""
    return static if live is None else live.unionByName(static.join(live.select("team_id"), "team_id", "left_anti"), allowMissingColumns=True)


def read_environment(text: str) -> dict[str, str]:
    """KEY=value lines; comments and blanks are left out, quotes go."""
    pairs = (line.partition("=") for line in map(str.strip, text.splitlines()) if line and not line.startswith("#") and "=" in line)
    return {k.strip().removeprefix("export ").strip(): v.strip().strip("'\"") for k, _, v in pairs}


def exported_lines(records: DataFrame, order: str) -> DataFrame:
    """One JSON document a row, in order of its key."""
    return records.orderBy(order).select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(records: DataFrame, path: str, order: str) -> None:
    """Text parts sorted by range: read in file order they are one sorted file, and no task has to hold them all."""
    exported_lines(records, order).write.mode("overwrite").text(path)


def training_lines(boxes: DataFrame, line: Column, split: Column, source: str) -> DataFrame:
    """split, frame and its lines of labels, to be written by split."""
    kept = boxes.withColumn("_line", line).filter(F.col("_line").isNotNull())
    return kept.groupBy(split.alias("split"),
        "frame").agg(F.array_join(F.array_sort(F.collect_list("_line")), "\n").alias("labels")).withColumn("source", F.lit(source))


def outline(df: DataFrame) -> str:
    from fieldglass.functions.nested import schema_outline

    return json.dumps(schema_outline(df.schema))


def held_out_frames(documents: DataFrame, *keys: str) -> DataFrame:
    """keys, frame: the frames that a review's documents (kept: frame and boxes; flagged; dropped) hold, each once."""
    listed = F.concat(F.coalesce(F.transform("kept", lambda k: k["frame"].cast("long")), F.lit(None).cast("array<long>"),
        F.array().cast("array<long>")),
                      *(F.coalesce(F.col(c).cast("array<long>"), F.array().cast("array<long>")) for c in ("flagged", "dropped")))
    return documents.select(*keys, F.explode(listed).alias("frame")).distinct()


def labelled_frames(documents: DataFrame, *keys: str) -> DataFrame:
    """keys, frame, boxes of a review's kept frames."""
    return documents.select(*keys, F.explode("kept").alias("_k")).select(*keys, F.col("_k.frame").cast("long").alias("frame"),
        F.col("_k.boxes").alias("boxes"))


def training_split(frames: DataFrame, samples: DataFrame, held: DataFrame, validation: Column, key: str = "play_uid") -> DataFrame:
    """Labelled frames that aren't held out, each with its play (from samples: frame, play) and `split`, val where `validation`, a
    condition on the play, holds. A frame of no play is an error."""
    joined = frames.join(held.select("frame").distinct(), "frame", "left_anti").join(samples.select("frame", key), "frame", "left")
    known = F.when(F.col(key).isNotNull(), F.when(validation, "val").otherwise("train")).otherwise(F.raise_error(F.lit("a frame of no play")))
    return joined.withColumn("split", known)


def write_records(records: DataFrame, path: str, key: str = "play_uid") -> None:
    """A JSON document for each record, in a folder named by its key."""
    body = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})
    records.select(key, body.alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_manifest(units: DataFrame, path: str) -> None:
    """The units of a manifest (stage, unit, ...) as JSON lines in order of their keys."""
    units.select("stage", "unit", *sorted(c for c in units.columns if c not in ("stage", "unit"))).orderBy("stage",
        "unit").coalesce(1).write.mode("overwrite").json(path)


def read_schema(spark: SparkSession, path: str) -> T.StructType:
    """A schema kept as JSON."""
    return T.StructType.fromJson(json.loads(spark.read.option("wholetext", True).text(path).first()["value"]))


def utc_stamp(at: Column) -> Column:
    """A time as 2024-10-14T00:00:00Z, with what it has beyond whole seconds as 00.250000Z; the session's time zone has to be UTC."""
    whole = F.date_trunc("second", at) == at
    return F.when(whole, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
