"""Column functions over nested feed payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.plays import mapped


INVOLVED = "array<struct<playerInvolvedTypeId:int,playerInvolvedType:string,player:struct<playerId:int,firstName:string,lastName:string,uniform:string>>>"


def first_filled(*candidates: Column) -> Column:
    """The first that is neither NULL nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates))


def last_where(items: Column, keep) -> Column:
    return F.try_element_at(F.filter(items, keep), F.lit(-1))


def first_where(items: Column, keep) -> Column:
    return F.try_element_at(F.filter(items, keep), F.lit(1))


def side_team(teams: Column, side: str) -> Column:
    """The team id whose location type is `side`, the last if there are several."""
    return last_where(teams, lambda t: F.lower(t["teamLocationType"]["name"]) == side)["teamId"]


def event_teams(teams: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(teams, lambda t: t["teamId"].cast("int")), lambda x: x.isNotNull()))


def start_date(dates: Column, kind: str = "UTC") -> Column:
    """The date of a kind, else any, else an empty string."""
    return F.coalesce(first_where(dates, lambda d: d["dateType"] == kind)["full"], first_where(dates, lambda d: d["full"].isNotNull())["full"],
        F.lit(""))


def flat_players(involved: Column, roles: Mapping[int, str]) -> Column:
    """(role, player_id, name, uniform) of each player involved; a role without a name keeps the feed's own word."""
    return F.transform(
        F.coalesce(involved, F.array().cast(INVOLVED)),
        lambda p: F.struct(
            F.coalesce(mapped(roles, p["playerInvolvedTypeId"].cast("int")), p["playerInvolvedType"]).alias("role"),
            p["player"]["playerId"].alias("player_id"),
            F.array_join(F.filter(F.array(p["player"]["firstName"], p["player"]["lastName"]), lambda x: x.isNotNull() & (x != "")),
            " ").alias("name"),
            p["player"]["uniform"].alias("uniform"),
        ),
    )


def name_forms(first: Column, common: Column, last: Column, display: Column) -> Column:
    """The ways a player is written: display name, first and last, common and last, F.Last; each once, in that order."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    f, c, s, d = map(blank, (first, common, last, display))
    forms = F.array(d, F.concat_ws(" ", f, s), F.concat_ws(" ", c, s), F.concat(F.substring(F.coalesce(c, f), 1, 1), F.lit("."), s))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))


def schema_outline(schema: T.DataType, most_depth: int = 6) -> list[str]:
    """'path: type' for each field of a nested schema, lists as path[]."""
    out: list[str] = []

    def walk(path: str, kind: T.DataType, depth: int) -> None:
        if depth > most_depth:
            return
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                walk(f"{path}.{field.name}" if path else field.name, field.dataType, depth + 1)
        elif isinstance(kind, T.ArrayType):
            walk(f"{path}[]", kind.elementType, depth + 1)
        else:
            out.append(f"{path}: {kind.simpleString()}")

    walk("", schema, 0)
    return out


def found_arrays(schema: T.DataType, fields: Sequence[str], most_depth: int = 3) -> list[str]:
    """Paths of arrays of structs, not deeper than most_depth, that have one of the fields: candidates for a list whose place varies."""
    out: list[str] = []

    def walk(path: list[str], kind: T.DataType, depth: int) -> None:
        if isinstance(kind, T.StructType) and depth <= most_depth:
            for f in kind.fields:
                if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType,
                    T.StructType) and set(f.dataType.elementType.names) & set(fields):
                    out.append(".".join([*path, f.name]))
                walk([*path, f.name], f.dataType, depth + 1)

    walk([], schema, 0)
    return out


def exploded_candidates(df: DataFrame, fields: Sequence[str], most_depth: int = 3) -> DataFrame:
    """One row (item) for each element of the first array that found_arrays finds; an error if there is none."""
    paths = found_arrays(df.schema, fields, most_depth)
    if not paths:
        raise ValueError(f"no list with any of {list(fields)}")
    return df.select(F.explode(F.col(paths[0])).alias("item"))


def code_label(labels: Mapping[int, str], code: Column) -> Column:
    return F.coalesce(mapped(labels, code), F.format_string("statType %d", code))
