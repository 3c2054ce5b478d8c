"""URL filter: pattern rules indexed by their rarest literal token. DataFrame functions only.

A rule is (action, pattern). A pattern `host/path` fits the host and its subdomains if the URL's path starts with the
path. A pattern that starts with `~` is looked for anywhere in the lower-cased URL; there `*` stands for any characters
and `^` for an end of the URL or a character that is no letter or digit.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Mapping, Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOST_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: The method's own rules, for URLs that no host rule fits.
PATTERN_RULES = (
    ("block", "~^spam-farm^"),
    ("block", "~^casino^"),
    ("block", "~^click*bait^"),
    ("allow", "~^casino^museum^"),
)
#: Rules are planned into the query, so their number is checked.
MOST_RULES = 100_000
_ENTRY = "array<struct<token:string,regex:string,action:string,rule:string,whole:boolean>>"


def rules_of(table: DataFrame, action_col: str = "action", pattern_col: str = "pattern") -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(host rules, pattern rules) from a table of them, in order of their text; repeated ones once. Rows without an action or
    pattern are left out; over MOST_RULES rows, or another action than allow or block, are an error."""
    named = table.select(F.col(action_col).alias("action"), F.col(pattern_col).alias("pattern")).dropna().distinct()
    rows = sorted((r["action"], r["pattern"]) for r in named.limit(MOST_RULES + 1).collect())
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    if wrong := {a for a, _ in rows} - {"allow", "block"}:
        raise ValueError(f"a rule allows or blocks, not {sorted(wrong)}")
    return [r for r in rows if not r[1].startswith("~")], [r for r in rows if r[1].startswith("~")]


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that each URL fitting the pattern has as whole tokens: with a bound on either side, and no `*`."""
    body = pattern[1:] if pattern.startswith("~") else "/" + pattern
    inside = [m for m in re.finditer("[A-Za-z0-9]+", body) if 0 < m.start() and m.end() < len(body)]
    return sorted({m[0].lower() for m in inside if "*" not in (body[m.start() - 1], body[m.end()])})


def as_regex(pattern: str) -> str:
    """For host and path put together, or for the lower-cased URL where the pattern starts with `~`."""
    if pattern.startswith("~"):
        special = {"*": ".*", "^": "(?:^|$|[^a-z0-9])"}
        return "(?s)" + "".join(special.get(x) or re.escape(x) for x in pattern[1:])
    host, _, path = pattern.partition("/")
    return rf"(?s)^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce(url, F.lit(""))), F.lit("([a-z0-9]+)")))


def token_counts(pages: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url") -> dict[str, int]:
    """How many of all URLs have each token of the rules; as many rows at most as the rules have tokens."""
    wanted = sorted({t for _, pattern in rules for t in literal_tokens(pattern)})
    if not wanted:
        return {}
    known = F.broadcast(pages.sparkSession.range(1).select(F.explode(F.split(F.lit(" ".join(wanted)), " ")).alias("token")))
    found = pages.select(F.explode(url_tokens(F.col(url_col))).alias("token")).join(known, "token")
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rule_index(rules: Sequence[tuple[str, str]], counts: Mapping[str, int]) -> tuple[list[list[dict]], list[dict]]:
    """Hash buckets of rules by their rarest token, and the rules that have none and are run on every URL."""
    own = Counter(t for _, pattern in rules for t in literal_tokens(pattern))
    buckets: list[list[dict]] = [[] for _ in range(1 << max(3, (2 * len(rules)).bit_length()))]
    always: list[dict] = []
    for action, pattern in rules:
        tokens = literal_tokens(pattern)
        entry = {"token": None, "regex": as_regex(pattern), "action": action, "rule": pattern, "whole": pattern.startswith("~")}
        if tokens:
            entry["token"] = min(tokens, key=lambda t: (counts.get(t, 0), own[t], t))
            buckets[zlib.crc32(entry["token"].encode()) % len(buckets)].append(entry)
        else:
            always.append(entry)
    return buckets, always


def judge_urls(
    pages: DataFrame,
    host_rules: Sequence[tuple[str, str]] = HOST_RULES,
    pattern_rules: Sequence[tuple[str, str]] = PATTERN_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row for every input row: page_id, host, path, rule, verdict.

    The longest host rule that fits decides (of rules of the same length the blocking one). Otherwise the pattern rules
    do: a fitting allow rule allows, else a fitting block rule blocks, else the URL is allowed. A URL that is null or has
    no `://` has an empty host and path, which no host rule fits; pattern rules still see its text. Ids may be null or
    repeated and other columns are ignored; an empty table gives an empty result. No rows are moved between tasks: each
    URL's tokens fetch rules from hash buckets that are a constant of the plan, and only those run regular expressions.
    """
    rules = [*host_rules, *pattern_rules]
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
    if any("/" not in p for _, p in host_rules) or any(not p.startswith("~") for _, p in pattern_rules):
        raise ValueError("a host rule needs a /, a pattern rule starts with ~")
    buckets, always = rule_index(rules, token_counts(pages, rules, url_col))
    # One line for each bucket, empty where it has no rule: split once, and only the lines that a URL's tokens name are parsed.
    lines = F.split(F.lit("\n".join(json.dumps(x) if x else "" for x in buckets)), "\n")
    line_of = lambda t: F.get(lines, F.pmod(F.crc32(t), F.lit(len(buckets))).cast("int"))
    own = lambda t: F.filter(F.from_json(line_of(t), _ENTRY), lambda r: r["token"] == t)
    parts = pages.select(
        F.col(url_col).alias("url"), F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    fetched = F.flatten(F.transform(F.filter(url_tokens(F.col("url")), lambda t: line_of(t) != ""), own))
    if always:
        fetched = F.concat(F.from_json(F.lit(json.dumps(always)), _ENTRY), fetched)
    subject = lambda r: F.when(r["whole"], ascii_lower(F.coalesce("url", F.lit("")))).otherwise(F.concat("host", "path"))
    fitting = F.filter(fetched, lambda r: F.rlike(subject(r), r["regex"]))
    judged = parts.select("page_id", "host", "path", fitting.alias("fits"))
    ranked = F.transform(
        F.filter("fits", lambda r: ~r["whole"]),
        lambda r: F.struct(F.length(r["rule"]).alias("n"), r["action"].alias("action"), r["rule"].alias("rule"))
    )
    best = judged.select("page_id", "host", "path", F.array_max(ranked).alias("best"),
        F.transform(F.filter("fits", lambda r: r["whole"]), lambda r: r["action"]).alias("own"))
    fallback = F.when(F.array_contains("own", "allow") | ~F.array_contains("own", "block"), "allow").otherwise("block")
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), fallback).alias("verdict"))
