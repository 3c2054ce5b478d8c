"""The film room's list of plays: search words, tags, filters, which rows are on film, and their place on a timeline."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.plays import mapped, maybe_on_film, on_film

LONG, SHORT, RED_ZONE, EXPLOSIVE = 7, 3, 20, 15
# The patterns of the search words, the names of quarters, and the tags.
DOWN_WORDS = r"(\d)(?:st|nd|rd|th)?\s*(?:&|and)\s*(long|short|goal|\d+)"
ZONE_WORDS = r"red ?zone"
MINUTE_WORDS = r"two.?minute|2.?minute"
QUARTERS = {1: "Q1", 2: "Q2", 3: "Q3", 4: "Q4", 5: "OT"}
TAGS = ("featured", "td", "explosive", "shotgun", "motion", "pa")


def search(query: str) -> Column:
    """Whether a play fits the search, over columns down, ydstogo, yardline_100, qtr, clock, text, yrdln, posteam, formation.

    Anywhere in the search '3rd & long', '4 and 2' and the like ask for down and distance, else 'red zone' for the field's last
    20 yards, else 'two minute' for under 2:00 in the second or fourth quarter; else every word has to be in the play's text, spot,
    team, formation or quarter. NULL fits nothing that asks for it; an empty search fits all.
    """
    asked = query.strip().lower()
    if found := re.search(DOWN_WORDS, asked):
        yards, to_goal = F.col("ydstogo"), F.col("yardline_100")
        distance = {"long": yards >= LONG, "short": yards <= SHORT, "goal": to_goal <= yards}
        fits = (F.col("down") == int(found[1])) & (distance[found[2]] if found[2] in distance else yards == int(found[2]))
    elif re.search(ZONE_WORDS, asked):
        fits = F.col("yardline_100") <= RED_ZONE
    elif re.search(MINUTE_WORDS, asked):
        fits = F.col("qtr").isin(2, 4) & (F.split_part("clock", F.lit(":"), F.lit(1)).try_cast("int") < 2)
    else:
        parts = [F.col(c) for c in ("text", "yrdln", "posteam", "formation")] + [mapped(QUARTERS, F.col("qtr").cast("int"))]
        hay = F.lower(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)))
        fits = reduce(lambda a, b: a & b, (F.contains(hay, F.lit(w)) for w in asked.split()), F.lit(True))
    return F.coalesce(fits, F.lit(False))


def tag(name: str) -> Column:
    """Whether a play has a tag, over columns featured, touchdown, yards, formation, text, and motion and play_action as
    the play's record has them; an unknown tag fits all."""
    shotgun = F.coalesce(F.col("formation") == "SHOTGUN", F.lit(False)) | F.rlike(F.coalesce("text", F.lit("")), F.lit(r"(?i)\(shotgun"))
    told = {
        "featured": lambda: F.col("featured"), "td": lambda: F.col("touchdown"), "explosive": lambda: F.col("yards") >= EXPLOSIVE,
        "shotgun": lambda: shotgun,
        "motion": lambda: F.col("motion"), "pa": lambda: F.col("play_action"),
    }
    return F.coalesce(told[name](), F.lit(False)) if name in told else F.lit(True)


def visible(plays: DataFrame, quarter: int | None = None, kind: str | None = None, tags: Sequence[str] = (), search_text: str = "") -> DataFrame:
    """The plays of a quarter and a type (None: any) that have all tags and fit the search."""
    wanted = [search(search_text), *map(tag, tags)]
    if quarter is not None:
        wanted.append(F.col("qtr") == quarter)
    if kind is not None:
        wanted.append(F.col("play_type") == kind)
    return plays.filter(reduce(lambda a, b: a & b, wanted))


def with_featured(plays: DataFrame, records: DataFrame, key: str = "play_uid") -> DataFrame:
    """`featured`: whether the play has a record."""
    return plays.join(records.select(key, F.lit(True).alias("_f")).distinct(), key, "left").withColumn("featured",
        F.coalesce("_f", F.lit(False))).drop("_f")


def film_rows(plays: DataFrame, kind: str = "play_type", desc: str = "desc") -> DataFrame:
    """The rows that are or may be on film, with film_optional on those that may."""
    optional = maybe_on_film(F.col(kind), F.col(desc))
    return plays.filter(on_film(F.col(kind), F.col(desc)) | optional).withColumn("film_optional", optional)


def timeline(plays: DataFrame, keys: Sequence[str], spans: dict[str, tuple[str, str]], start: str = "start_s", end: str = "end_s",
    left: float = 40.0, right: float = 960.0, least: float = 1.0) -> DataFrame:
    """A bar for each play and lane on an axis from the first start to the last end of its keys: lane, x, width (to one digit, at
    least `least` wide). spans names each lane's two columns; plays without a span have no bar there."""
    ends = plays.groupBy(*keys).agg(F.min(start).alias("_a"), F.max(end).alias("_b"))
    at = lambda c: F.lit(left) + (c - F.col("_a")) / (F.col("_b") - F.col("_a")) * (right - left)
    lanes = F.array(*(F.struct(F.lit(n).alias("lane"), F.col(a).alias("a"), F.col(b).alias("b")) for n, (a, b) in spans.items()))
    bars = plays.join(ends, list(keys)).withColumn("_l", F.explode(lanes)).filter("_l.a is not null and _l.b is not null")
    width = F.greatest(at(F.col("_l.b")) - at(F.col("_l.a")), F.lit(least))
    return bars.withColumns({"lane": F.col("_l.lane"), "x": F.round(at(F.col("_l.a")), 1), "width": F.round(width, 1)}).drop("_a", "_b", "_l")
