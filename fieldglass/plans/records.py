"""Play records: one nested document for each play, its checks, and its export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import plays as P

SCHEMA_VERSION, PIPELINE_VERSION = "0.1.0", "0.1.0"
#: Closed vocabularies of the sections that the checks read. Fixed values.
VOCABULARY = {
    "official.play_type": ("pass", "run", "punt", "field_goal", "extra_point", "kickoff", "qb_kneel", "qb_spike", "no_play"),
    "generated.pass": ("official", "live", "post"), "review.status": ("unreviewed", "reviewed", "corrected", "flagged"),
    "official.labels.source": ("official", "nflverse", "cv", "hosted_model", "human"),
}
REQUIRED = ("schema_version", "play_uid", "game", "situation", "official", "review", "generated")


def play_records(plays: DataFrame, game: dict, at: str, players: str | None = None) -> DataFrame:
    """The official sections of each numbered play, in order; the vision sections are NULL. Columns that plays lacks are NULL too."""
    have = lambda c, kind="string": F.col(c).cast(kind) if c in plays.columns else F.lit(None).cast(kind)
    lit = lambda k, kind="string": F.lit(game.get(k)).cast(kind)
    named = lambda **columns: F.struct(*(c.alias(k) for k, c in columns.items()))
    flag = lambda c: F.coalesce(P.no_nan(have(c, "double")) != 0, F.lit(False))
    whole = lambda c: P.no_nan(have(c, "double")).cast("int")
    desc, yards, distance = F.coalesce(have("desc"), F.lit("")), whole("yardline_100"), whole("ydstogo")
    los = (F.lit(10.0) + (100 - yards)).alias("los")
    grouping = P.record_personnel(have("offense_personnel"))
    labelled = F.coalesce(have("offense_formation"), have("offense_personnel"), have("defense_personnel")).isNotNull()
    digit = lambda k: F.substring(grouping, k, 1).cast("int")
    null = F.lit(None).cast("string")
    offense = named(grouping=grouping, rb=digit(1), te=digit(2), wr=5 - digit(1) - digit(2), source=F.lit("nflverse"), confidence=F.lit(1.0),
        **{"pass": F.lit("official")})
    defense = named(package=null, dl=F.lit(None).cast("int"), lb=F.lit(None).cast("int"), db=F.lit(None).cast("int"), source=F.lit("nflverse"),
        confidence=F.lit(None).cast("double"), **{"pass": F.lit("official")})
    players_ = F.col(players) if players else F.array().cast("array<string>")
    rows = plays.filter("play_uid is not null").select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "play_uid",
        named(game_key=lit("game_key"), season=lit("season", "int"), week=lit("week", "int"), away=lit("away"), home=lit("home"),
        nfl_game_id=lit("nfl_game_id"), nfl_play_id=whole("nfl_play_id"), gsis_id=lit("gsis_id")).alias("game"),
        named(quarter=whole("qtr"), clock=F.coalesce(have("time"), P.clock_of(desc)), down=whole("down"), distance=distance,
        possession=have("posteam"), yardline_100=yards, yrdln=have("yrdln"), los_x=los,
              first_down_x=F.when(los.isNotNull() & distance.isNotNull(), F.least(F.lit(110.0), los + distance)), direction_of_attack=F.lit("right"),
              hash=null, score=null).alias("situation"),
        named(play_type=have("play_type"), description=P.without_clock(desc), yards_gained=whole("yards_gained"), first_down=flag("first_down"),
        touchdown=flag("touchdown"), turnover=flag("interception"), players_involved=players_,
              labels=named(offense_formation=have("offense_formation"), offense_personnel=F.coalesce(grouping, have("offense_personnel")),
              defense_personnel=have("defense_personnel"), source=F.when(labelled, "nflverse").otherwise("official"))).alias("official"),
        null.alias("film"), F.when(grouping.isNotNull(), named(offense=offense, defense=defense)).alias("personnel"),
        *(null.alias(c) for c in ("pre_snap", "at_snap", "live", "post_snap")),
        F.array().cast("array<string>").alias("players"), null.alias("tracking"),
        named(note=F.lit("official sections only; vision analysis pending")).alias("quality"),
        named(status=F.lit("unreviewed"), by=null, at=null).alias("review"), F.array().cast("array<string>").alias("corrections"),
        named(pipeline_version=F.lit(PIPELINE_VERSION), at=F.lit(at), **{"pass": F.lit("official")}).alias("generated"),
        have("play_index", "int").alias("_o"))
    return rows.orderBy(F.asc_nulls_last("_o"), "play_uid").drop("_o")


def problems(records: DataFrame, required: Sequence[str] = REQUIRED) -> Column:
    """What is wrong with each record, as messages."""
    have = set(records.columns)
    missing = [F.when(F.col(c).isNull() if c in have else F.lit(True), F.lit(f"{c} is missing")) for c in required]
    words = [F.when(F.col(path).isNotNull() & ~F.col(path).isin(*values), F.concat(F.lit(f"{path} is "), F.col(path))) for path,
        values in VOCABULARY.items() if path.split(".")[0] in have]
    shape = F.when(~F.rlike("play_uid", F.lit(r"^\d{4}_wk\d{2}_[A-Z]{2,3}-[A-Z]{2,3}_p\d{3,}$")), F.concat(F.lit("play_uid is "), F.col("play_uid")))
    return F.array_compact(F.array(*missing, *words, shape))


def checked(records: DataFrame) -> DataFrame:
    """The records; reading them fails at the first that isn't right."""
    wrong = problems(records)
    return records.filter(F.when(F.size(wrong) > 0, F.raise_error(F.concat_ws("; ", F.col("play_uid"), wrong))).otherwise(True))


def game_document(plays: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """One nested document for each game, its plays in order."""
    listed = F.array_sort(F.collect_list(F.struct(order, *(c for c in columns if c != order))))
    return plays.groupBy(*keys).agg(F.to_json(listed).alias("plays"), F.count("*").alias("n"))
