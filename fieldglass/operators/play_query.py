"""The two query tools over a table of plays: filter and count, and group and rank."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: filter name -> (column, how the value is read). Fixed values of the query interface.
EQUAL = {
    "off_grouping": ("off_grouping", str), "off_formation": ("off_formation", str.upper), "def_package": ("def_package", str),
    "def_front": ("def_front", str), "play_type": ("play_type", str),
    "pass_location": ("pass_location", str.lower), "pass_length": ("pass_length", str.lower), "run_location": ("run_location", str.lower),
    "run_gap": ("run_gap", str.lower),
    "down": ("down", int), "quarter": ("qtr", int),
}
TEAMS = {"offense": "posteam", "defense": "defteam"}
FLAGS = ("shotgun", "no_huddle", "goal_to_go", "first_down", "sack", "interception", "touchdown", "qb_scramble")
FILTERS = {*EQUAL, *TEAMS, *FLAGS, "distance_min", "distance_max", "red_zone"}
QUERY_ARGUMENTS, AGGREGATE_ARGUMENTS = FILTERS | {"count_only", "limit"}, FILTERS | {"group_by", "sort_by", "min_plays", "limit"}
RETURNED = ("play_uid", "qtr", "down", "ydstogo", "yrdln", "posteam", "defteam", "play_type", "off_formation", "off_grouping", "offense_personnel",
    "def_package", "def_front", "yards_gained", "epa")
DIMENSIONS = {**{x: x
    for x in ("off_grouping", "off_formation", "def_package", "def_front", "play_type", "down", "posteam", "defteam", "shotgun", "pass_location",
    "run_gap")}, "quarter": "qtr"}
METRICS = ("n", "epa_per_play", "success_rate", "yards_per_play", "explosive_rate")
RED_ZONE, EXPLOSIVE = 20, 15


def allowed(arguments: Mapping[str, Any], names: set[str]) -> dict[str, Any]:
    """The arguments that a tool knows."""
    return {k: v for k, v in arguments.items() if k in names}


def present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that there are, in their order."""
    return df.select(*(c for c in wanted if c in df.columns))


def predicate(columns: Sequence[str], filters: Mapping[str, Any]) -> Column:
    """All filters together; those on absent columns and teams that aren't 2 or 3 letters are left out."""
    found: list[Column] = []

    def add(column: str, condition: Column) -> None:
        if column in columns:
            found.append(condition)

    given = {k: v for k, v in filters.items() if v is not None}
    for name, column in TEAMS.items():
        if re.fullmatch("[A-Za-z]{2,3}", str(given.get(name, ""))):
            add(column, F.col(column) == str(given[name]).upper())
    for name, (column, read) in EQUAL.items():
        if name in given:
            add(column, F.col(column) == F.lit(read(given[name])))
    if "distance_min" in given:
        add("ydstogo", F.col("ydstogo") >= int(given["distance_min"]))
    if "distance_max" in given:
        add("ydstogo", F.col("ydstogo") <= int(given["distance_max"]))
    if isinstance(given.get("red_zone"), bool):
        add("yardline_100", F.col("yardline_100") <= RED_ZONE if given["red_zone"] else F.col("yardline_100") > RED_ZONE)
    for name in FLAGS:
        if isinstance(given.get(name), bool):
            add(name, F.col(name) == int(given[name]))
    return reduce(lambda a, b: a & b, found, F.lit(True))


def clamp(value: int | None, default: int, most: int) -> int:
    """0 and None mean the default."""
    return max(1, min(int(value or default), most))


def matching_plays(plays: DataFrame, limit: int | None = None, **filters: Any) -> DataFrame:
    """The first plays that match, by play_index (NULL last), with the columns that are returned."""
    order = [F.asc_nulls_last(c) for c in ("play_index", "play_uid") if c in plays.columns]
    rows = plays.filter(predicate(plays.columns, filters))
    return present(rows.orderBy(*order).limit(clamp(limit, 25, 100)) if order else rows.limit(clamp(limit, 25, 100)), RETURNED)


def query_plays(plays: DataFrame, count_only: bool = False, limit: int | None = None, **filters: Any) -> dict:
    """{count}, or {count, returned, plays}; count is of all matches."""
    count = plays.filter(predicate(plays.columns, filters)).count()
    if count_only:
        return {"count": count}
    rows = [r.asDict(recursive=True) for r in matching_plays(plays, limit, **filters).collect()]
    return {"count": count, "returned": len(rows), "plays": rows}


def group_metrics(df: DataFrame, dims: Sequence[str], value: str | None, amount: str | None, big: float = EXPLOSIVE) -> DataFrame:
    """n; the mean of value and the share above 0; the mean of amount and the share of at least `big`. NULL counts in a
    share's denominator and not in a mean, and NULL dimensions are a group."""
    share = lambda c: F.avg(F.when(c, F.lit(1.0)).otherwise(F.lit(0.0)))
    metrics = [F.count("*").alias("n")]
    if value:
        metrics += [F.round(F.avg(value), 3).alias("epa_per_play"), F.round(share(F.col(value) > 0), 3).alias("success_rate")]
    if amount:
        metrics += [F.round(F.avg(amount), 2).alias("yards_per_play"), F.round(share(F.col(amount) >= big), 3).alias("explosive_rate")]
    return df.groupBy(*dims).agg(*metrics)


def ranked_groups(plays: DataFrame, group_by: Sequence[str], sort_by: str = "epa_per_play", min_plays: int = 1, limit: int | None = None,
    **filters: Any) -> DataFrame:
    """The groups of at least min_plays, best metric first (NULL last), ties by dimension; ValueError without a known dimension."""
    dims = [DIMENSIONS[d] for d in group_by or () if DIMENSIONS.get(d) in plays.columns]
    if not dims:
        raise ValueError("group_by must include at least one of: " + ", ".join(sorted(DIMENSIONS)))
    has = lambda c: c if c in plays.columns else None
    groups = group_metrics(plays.filter(predicate(plays.columns, filters)), dims, has("epa"),
        has("yards_gained")).filter(F.col("n") >= int(min_plays))
    metric = next(m for m in ((sort_by if sort_by in METRICS else "epa_per_play"), "yards_per_play", "n") if m in groups.columns)
    return groups.orderBy(F.desc_nulls_last(metric), *(F.asc_nulls_last(d) for d in dims)).limit(clamp(limit, 20, 50))


def aggregate_plays(plays: DataFrame, group_by: Sequence[str] | None = None, sort_by: str = "epa_per_play", min_plays: int = 1,
    limit: int | None = None, **filters: Any) -> dict:
    try:
        groups = ranked_groups(plays, group_by or (), sort_by, min_plays, limit, **filters)
    except ValueError as error:
        return {"error": str(error)}
    metric = next(m for m in ((sort_by if sort_by in METRICS else "epa_per_play"), "yards_per_play", "n") if m in groups.columns)
    return {"group_by": [d for d in group_by or () if DIMENSIONS.get(d) in plays.columns], "sort_by": metric,
        "groups": [r.asDict() for r in groups.collect()]}


def tool_schemas() -> list[dict]:
    """What a caller may pass to the two tools."""
    kind = {int: "integer", str: "string"}
    props = {n: {"type": kind.get(read, "string")} for n,
        (_, read) in EQUAL.items()} | {n: {"type": "string"} for n in TEAMS} | {n: {"type": "boolean"}
        for n in (*FLAGS, "red_zone")} | {n: {"type": "integer"} for n in ("distance_min", "distance_max")}
    tool = lambda name, more: {"name": name, "input_schema": {"type": "object", "properties": props | more}}
    return [
        tool("query_plays", {"count_only": {"type": "boolean"}, "limit": {"type": "integer"}}),
        tool("aggregate_plays",
        {"group_by": {"type": "array", "items": {"type": "string", "enum": sorted(DIMENSIONS)}},
        "sort_by": {"type": "string", "enum": list(METRICS)}, "min_plays": {"type": "integer"}, "limit": {"type": "integer"}}),
    ]


def number_set(spec: str) -> list[int]:
    """'1-10,12' -> [1, ..., 10, 12]."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        out.update(range(int(low), int(high or low) + 1))
    return sorted(out)
