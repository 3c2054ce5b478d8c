"""Column functions over play-by-play text, codes and keys. All native; NULL in gives NULL out unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: play types, aliases, codes and the patterns that classify narration

SCRIMMAGE_TYPES = ("pass", "run", "qb_kneel", "qb_spike")
FILMABLE_TYPES = ("pass", "run", "punt", "field_goal", "extra_point", "kickoff", "qb_kneel", "qb_spike")
FEED_SCRIMMAGE_TYPES = ("pass", "run")
FEED_TYPE_IDS = {1: "pass", 2: "pass", 3: "pass", 4: "run", 5: "kickoff", 7: "punt", 9: "pass", 10: "penalty", 11: "penalty",
    13: "two_minute_warning", 14: "fumble", 22: "extra_point", 42: "field_goal", 57: "timeout", 58: "timeout"}
FEED_ALIASES = {"LAR": "LA"}
LEAGUE_ALIASES = {"LAR": "LA", "WSH": "WAS", "JAC": "JAX", "ARZ": "ARI", "BLT": "BAL", "CLV": "CLE", "HST": "HOU"}
ADMIN_TYPES = ("GAME_START", "END_QUARTER", "END_HALF", "END_GAME", "TIMEOUT", "TWO_MINUTE_WARNING", "COMMENT")
NARRATION = (
    ("kickoff", r"\bkicks off\b|\bkickoff\b"),
    ("punt", r"\bpunts?\b"),
    ("field_goal", r"\bfield goal\b"),
    ("extra_point", r"\bextra point\b"),
    ("pass", r"\b(pass|sacked|scrambles|spike[sd]?)\b"),
    ("run", r"\b(rush(?:es|ed)?|run[s]?|kneel[s]?|up the middle)\b"),
)
ADMIN_MARKER = r"\btime\s?out\b|two[-\s]?minute warning|end of (quarter|half|game|regulation|period)|end quarter"
REAL_ACTION = r"\b(pass|rush|scramble|sack|punt|kick|field goal|kneel|spike|handoff|intercept|fumble|lateral)\b"
DEAD_BALL = r"^\s*penalty\s*:"
LEADING_TAGS = r"^(\s*\([^)]*\))+\s*"
CLOCK = r"^\((\d{1,2}:\d{2})\)\s*"
RUN_DIRECTION = r"\b(left|right) (end|tackle|guard)\b|up the middle"
KICK_CLASSES = {"kickoff": 1, "punt": 2, "field_goal": 3, "extra_point": 4}


def mapped(values: Mapping, key: Column) -> Column:
    """The value of key in a small constant mapping; NULL if it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def says(text: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(text, F.lit(f"(?i){pattern}")), F.lit(False))


def first_rule(*rules: tuple[Column, Column | str | None]) -> Column:
    """The value of the first rule that holds; order is meaning."""
    return F.coalesce(reduce(lambda later, rule: F.when(rule[0], rule[1] if isinstance(rule[1], Column) else F.lit(rule[1])).otherwise(later),
        reversed(rules), F.lit(None).cast("string")))


# --- keys


def game_key(season: Column, week: Column, away: Column, home: Column) -> Column:
    return F.format_string("%d_wk%02d_%s-%s", season.cast("int"), week.cast("int"), F.upper(away), F.upper(home))


def play_uid(key: Column, index: Column) -> Column:
    """Three digits at least; larger numbers widen."""
    return F.when(key.isNotNull() & index.isNotNull(), F.format_string("%s_p%03d", key, index.cast("int")))


def season_game_id(season: Column, week: Column, away: Column, home: Column) -> Column:
    return F.format_string("%d_%02d_%s_%s", season.cast("int"), week.cast("int"), F.upper(away), F.upper(home))


def parse_game_key(key: Column) -> Column:
    """(season, week, away, home); an error for anything else."""
    pattern = r"^(\d{4})_wk(\d{2})_([A-Z]{2,3})-([A-Z]{2,3})$"
    part = lambda k: F.regexp_extract(key, pattern, k)
    parsed = F.struct(part(1).cast("int").alias("season"), part(2).cast("int").alias("week"), part(3).alias("away"), part(4).alias("home"))
    return F.when(key.isNull() | F.rlike(key, F.lit(pattern)),
        F.when(key.isNotNull(), parsed)).otherwise(F.raise_error(F.concat(F.lit("not a game key: "), key)))


# --- what is on film


def is_one_of(column: Column, values) -> Column:
    return F.coalesce(column.isin(*values), F.lit(False))


def snapped(desc: Column) -> Column:
    """A description that, its leading tags aside, begins with something other than a penalty."""
    body = F.ltrim(F.regexp_replace(F.coalesce(desc, F.lit("")), LEADING_TAGS, ""))
    return (body != "") & ~F.startswith(F.upper(body), F.lit("PENALTY"))


def on_film(play_type: Column, desc: Column) -> Column:
    return is_one_of(play_type, FILMABLE_TYPES) | (play_type.eqNullSafe(F.lit("no_play")) & snapped(desc))


def maybe_on_film(play_type: Column, desc: Column) -> Column:
    foul = play_type.eqNullSafe(F.lit("no_play")) & ~snapped(desc) & F.contains(F.upper(F.coalesce(desc, F.lit(""))), F.lit("PENALTY"))
    return play_type.eqNullSafe(F.lit("qb_kneel")) | foul


def is_admin(text: Column, play_type: Column) -> Column:
    said = F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(play_type, F.lit("")))
    return says(said, ADMIN_MARKER) & ~says(said, REAL_ACTION)


# --- play types


def narrated_type(text: Column) -> Column:
    """The type that narration tells, by the first pattern that fits; NULL if none does."""
    return first_rule(*((says(text, pattern), kind) for kind, pattern in NARRATION))


def feed_type(type_id: Column, text: Column) -> Column:
    """(play_type, is_scrimmage) of a play of the statistics feed, whose ids of fumbles and penalties name outcomes."""
    known, told = mapped(FEED_TYPE_IDS, type_id.cast("int")), narrated_type(text)
    dead = (known == "penalty") & says(text, DEAD_BALL)
    kind = F.when(F.coalesce(dead, F.lit(False)), "penalty").when(known.isin("fumble", "penalty"), F.coalesce(told, known)).otherwise(known)
    return F.struct(kind.alias("play_type"), (is_one_of(kind, FEED_SCRIMMAGE_TYPES) & ~F.coalesce(dead, F.lit(False))).alias("is_scrimmage"))


def league_type(play_type: Column, desc: Column) -> Column:
    """The type of a play of the league's feed; NULL for administrative rows and for what isn't known."""
    d, t = F.lower(F.coalesce(desc, F.lit(""))), F.upper(F.coalesce(play_type, F.lit("")))
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(d, F.lit(w)) for w in words))
    return first_rule(
        (t.isin(*ADMIN_TYPES) | is_admin(desc, play_type), None),
        (has("no play") & has("penalty"), "no_play"),
        (has("kicks off", "kickoff") | F.contains(t, F.lit("KICK_OFF")) | (t == "KICKOFF"), "kickoff"),
        (has("punts") | (t == "PUNT"), "punt"),
        (has("field goal") | t.isin("FIELD_GOAL", "FG"), "field_goal"),
        (has("extra point") | t.isin("XP_KICK", "EXTRA_POINT", "PAT"), "extra_point"),
        (has("kneels"), "qb_kneel"),
        (has("spiked"), "qb_spike"),
        (has("two-point", "two point"), F.when(has("pass"), "pass").otherwise("run")),
        (has("scrambles"), "run"),
        (has("pass", "sacked") | t.isin("PASS", "SACK"), "pass"),
        (t.isin("RUSH", "RUN") | F.rlike(d, F.lit(RUN_DIRECTION)), "run"),
        ((t == "PENALTY") | has("penalty"), "no_play"),
    )


def type_class(play_type: Column) -> Column:
    """0 for plays from scrimmage, or the number of the kick."""
    return F.coalesce(mapped(KICK_CLASSES, play_type), F.lit(0))


# --- spots, teams, uniforms, time


def team_code(abbreviation: Column, aliases: Mapping[str, str] = LEAGUE_ALIASES) -> Column:
    upper = F.upper(F.nullif(abbreviation, F.lit("")))
    return F.coalesce(mapped(aliases, upper), upper)


def feed_yardline(spot: Column, possession: Column) -> Column:
    """'Chi37' and who has the ball -> yards to the goal attacked; NULL unless both are known and the spot is 0 to 50."""
    pattern = r"^([A-Za-z]+)\s*(\d{1,2})$"
    side, yard = F.regexp_extract(F.trim(spot), pattern, 1), F.try_to_number(F.regexp_extract(F.trim(spot), pattern, 2), F.lit("99")).cast("int")
    own = team_code(side, FEED_ALIASES) == F.upper(possession)
    return F.when((side != "") & yard.between(0, 50) & (possession != ""), F.when(own, 100 - yard).otherwise(yard))


def league_yardline(spot: Column, possession: Column) -> Column:
    """As feed_yardline, but with the league's aliases; '50' is midfield, and without possession the other side is taken."""
    pattern = r"^([A-Za-z]+)\s*(\d{1,2})$"
    trimmed = F.trim(spot)
    side, yard = team_code(F.regexp_extract(trimmed, pattern, 1)), F.try_to_number(F.regexp_extract(trimmed, pattern, 2), F.lit("99")).cast("int")
    own = F.coalesce(side == team_code(possession), F.lit(False))
    return F.when(trimmed == "50", 50).when(F.rlike(trimmed, F.lit(pattern)), F.when(own, 100 - yard).otherwise(yard))


def plain_uniform(number: Column) -> Column:
    """'04' -> '4', '0' -> '0'."""
    bare = F.regexp_replace(F.trim(number.cast("string")), "^0+", "")
    return F.when(bare == "", "0").otherwise(bare)


def team_of_logo(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "/logos/([A-Z]+)(?:[/?#]|$)", 1), F.lit(""))


def clock_of(desc: Column) -> Column:
    return F.nullif(F.regexp_extract(desc, CLOCK, 1), F.lit(""))


def without_clock(desc: Column) -> Column:
    return F.regexp_replace(desc, CLOCK, "")


def season_part(week: Column) -> Column:
    """(season type, week in it): 18 regular weeks, then the postseason."""
    return F.struct(F.when(week <= 18, "REG").otherwise("POST").alias("season_type"), F.when(week <= 18, week).otherwise(week - 18).alias("week"))


def half_of(quarter: Column) -> Column:
    return F.when(quarter <= 2, "first").otherwise("second")


def season_of_date(date: Column, season: Column | None = None) -> Column:
    """The season given, else the date's year; January and February belong to the year before."""
    day = F.try_to_timestamp(date)
    from_day = F.when(F.month(day) <= 2, F.year(day) - 1).otherwise(F.year(day))
    return F.coalesce(season.cast("int"), from_day) if season is not None else from_day


def no_nan(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


# --- personnel

BACKS, ENDS = ("RB", "FB", "HB"), ("TE",)
LINE, BACKERS, SECONDARY = ("DE", "DT", "NT", "DL", "EDGE"), ("ILB", "OLB", "MLB", "LB", "WLB", "SLB"), ("CB", "FS", "SS", "S", "DB", "NB")


def personnel_tokens(text: Column) -> Column:
    """'1 RB, 2 TE' -> [(RB, 1), (TE, 2)]; NULL if there are none."""
    pattern = r"(\d+)\s+([A-Za-z]+)"
    numbers, names = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    tokens = F.zip_with(numbers, names, lambda n, p: F.struct(F.upper(p).alias("position"), n.cast("int").alias("n")))
    return F.when(F.size(tokens) > 0, tokens)


def count_of(tokens: Column, positions) -> Column:
    """How many players of some positions; NULL tokens give NULL."""
    own = F.filter(tokens, lambda t: t["position"].isin(*positions))
    return F.aggregate(own, F.lit(0), lambda total, t: total + t["n"])


def offense_grouping(text: Column) -> Column:
    tokens = personnel_tokens(text)
    return F.concat(count_of(tokens, BACKS).cast("string"), count_of(tokens, ENDS).cast("string"))


def defense_front(text: Column) -> Column:
    """(dl, lb, db, front, package); each NULL if nothing is known."""
    tokens = personnel_tokens(text)
    dl, lb, db = (count_of(tokens, x) for x in (LINE, BACKERS, SECONDARY))
    package = F.when(db <= 4, "base").when(db == 5, "nickel").when(db == 6, "dime").when(db > 6, "quarter")
    front = F.concat_ws("-", dl.cast("string"), lb.cast("string"), db.cast("string"))
    return F.struct(dl.alias("dl"), lb.alias("lb"), db.alias("db"), F.when(dl.isNotNull(), front).alias("front"), package.alias("package"))


def play_summary(offense: Column, defense: Column, formation: Column) -> Column:
    tokens, front = personnel_tokens(offense), defense_front(defense)
    parts = {
        "off_grouping": offense_grouping(offense), "off_formation": F.upper(F.nullif(formation, F.lit(""))), "wr": count_of(tokens, ("WR",)),
        "te": count_of(tokens, ENDS), "rb": count_of(tokens, BACKS),
        "def_front": front["front"], "def_package": front["package"], "def_dl": front["dl"], "def_lb": front["lb"], "def_db": front["db"],
    }
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def record_personnel(text: Column) -> Column:
    """The grouping that play records carry: running backs and tight ends alone, the last token of a position standing."""
    parts = F.transform(F.split(text, ","),
        lambda s: F.struct(F.regexp_extract(s, r"^\s*(\d+)\s+([A-Z]+)", 2).alias("p"), F.regexp_extract(s, r"^\s*(\d+)\s+([A-Z]+)", 1).alias("n")))
    last = lambda p: F.try_element_at(F.transform(F.filter(parts, lambda t: t["p"] == p), lambda t: t["n"].cast("int").cast("string")),
        F.lit(-1))
    return F.when(last("RB").isNotNull() | last("TE").isNotNull(), F.concat(F.coalesce(last("RB"), F.lit("0")), F.coalesce(last("TE"), F.lit("0"))))


# --- hashes


def split_share(key: Column) -> Column:
    """0 to 1 from the first 8 hex digits of SHA-1: the same key always falls on the same side of a split."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") / F.lit(float(0xFFFFFFFF))


def fold_of(key: Column, folds: int) -> Column:
    """From the next 8 digits, so that folds don't depend on the split."""
    return F.pmod(F.conv(F.substring(F.sha1(key), 9, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def request_signature(key: Column, secret: Column, stamp: Column) -> Column:
    return F.sha2(F.concat(key, secret, stamp.cast("string")), 256)
