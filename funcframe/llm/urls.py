"""URL filters with DataFrame functions alone: rules are indexed by their rarest literal token.

A URL's tokens fetch the rules that are indexed under them, and only these run their regular expressions. The rarest
token of a rule is the one in the fewest URLs of the table at hand, so that common tokens fetch nothing.

Defined cases. A null URL, or one without ``://``, has empty host and path; no rule fits it and it is allowed. Repeated
rows are judged one by one; an empty table gives an empty result; other columns do not matter. Of base rules that fit,
the longest decides, then the one that sorts last. A rule without a literal token is a candidate for every URL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funcframe.llm.common import table

#: An index of at most so many tokens is a constant of the plan; a larger one is a table that is joined.
INLINE = 256


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host and path put together; ``name`` is set for base rules, which go before others."""

    pattern: str
    action: str
    tokens: tuple[str, ...]
    name: str | None = None


def base_rule(name: str, action: str) -> Rule:
    """Fits a host and its subdomains where the path starts with the rule's. A token that the end may cut is none."""
    host, slash, path = name.partition("/")
    body = slash + path
    whole = re.split("[^a-z0-9]+", name.lower())
    tokens = tuple(t for t in whole[: None if not name[-1:].isalnum() else -1] if t)
    return Rule(rf"^([^/]*\.)?{_quoted(host)}{_quoted(body)}", action, tokens, name)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


#: The base rules.
BASE = tuple(base_rule(n, a) for n, a in (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")))
#: Rules of the method, for URLs that no base rule fits.
PATTERNS = tuple(
    Rule(pattern, "block", tokens)
    for pattern, tokens in (
        (r"(^|[./-])casino([./-]|$)", ("casino",)),
        (r"(^|[./-])adult([./-]|$)", ("adult",)),
        (r"(^|\.)free-bets\.", ("free", "bets")),
        (r"(^|\.)spam-farm\.", ("spam", "farm")),
        (r"(^|[./-])payday-loans?([./-]|$)", ("payday",)),
        (r"/wp-login\.php$", ("wp", "login", "php")),
        (r"/cgi-bin/", ("cgi", "bin")),
        (r"\.exe$", ("exe",)),
        (r"\.apk$", ("apk",)),
        (r"(^|\.)warez\.", ("warez",)),
        (r"(^|[./-])porn([./-]|$)", ("porn",)),
        (r"(^|[./-])xxx([./-]|$)", ("xxx",)),
        (r"(^|[./-])torrents([./-]|$)", ("torrents",)),
    )
)
RULES = BASE + PATTERNS


def ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(F.concat(host, path)), "[^a-z0-9]+"))


def index(urls: DataFrame, rules: tuple[Rule, ...], url: str) -> dict[str, list[int]]:
    """Rules (their numbers) by their rarest token in ``urls``; counts come back for the rules' own tokens alone."""
    words = sorted({t for r in rules for t in r.tokens})
    u = F.col(f"`{url}`")
    found = urls.select(F.explode(tokens_of(host_of(u), path_of(u))).alias("token")).where(F.col("token").isin(words) if words else F.lit(False))
    counts = {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else "", []).append(i)
    return out


def _decided(subject: Column, candidates: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) by the candidates, an array of structs of pattern, size, name and action."""
    hits = F.filter(candidates, lambda r: F.rlike(subject, r["pattern"]))
    named = F.array_max(F.transform(F.filter(hits, lambda r: r["name"].isNotNull()), lambda r: F.struct(r["size"], r["name"], r["action"])))
    blocked = F.exists(hits, lambda r: r["name"].isNull() & (r["action"] == "block"))
    return named["name"], F.coalesce(named["action"], F.when(blocked, "block").otherwise("allow"))


def _struct(r: Rule) -> Column:
    return F.struct(F.lit(r.pattern).alias("pattern"), F.lit(len(r.name or "")).alias("size"), F.lit(r.name).cast("string").alias("name"), F.lit(r.action).alias("action"))


def judge(urls: DataFrame, keep: list[str], url: str = "url", rules: tuple[Rule, ...] = RULES, inline: int = INLINE) -> DataFrame:
    """``keep``, host, path, rule and verdict for every row."""
    u = F.col(f"`{url}`")
    by_token = index(urls, rules, url)
    always = by_token.pop("", [])
    constant = F.filter(F.array(*[_struct(rules[i]) for i in always] or [_struct(Rule("", "allow", ()))]), lambda r: F.lit(bool(always)))
    kept = [F.col(f"`{c}`") for c in keep]
    if len(by_token) <= inline:
        flat = urls.select(F.struct(*kept).alias("row"), host_of(u).alias("host"), path_of(u).alias("path"))
        found = constant
        if by_token:
            held = F.create_map(*[x for t, ids in sorted(by_token.items()) for x in (F.lit(t), F.array(*[_struct(rules[i]) for i in ids]))])
            fetched = F.transform(tokens_of(F.col("host"), F.col("path")), lambda t: F.try_element_at(held, t))
            found = F.concat(constant, F.flatten(F.filter(fetched, lambda r: r.isNotNull())))
        rule, verdict = _decided(F.concat("host", "path"), found, rules)
        return flat.select("row.*", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    spark = urls.sparkSession
    rows = [(t, r.pattern, len(r.name or ""), r.name, r.action) for t, ids in by_token.items() for r in (rules[i] for i in ids)]
    known = spark.createDataFrame(rows, "token string, pattern string, size int, name string, action string")
    distinct = urls.select(u.alias("url")).where(u.isNotNull()).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hits = distinct.select("url", F.concat("host", "path").alias("subject"), F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token")).join(known, "token")
    hits = hits.where(F.rlike(F.col("subject"), F.col("pattern"))).groupBy("url").agg(F.collect_set(F.struct("pattern", "size", "name", "action")).alias("found"))
    held = urls.select(F.struct(*kept).alias("row"), u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path")).join(hits, "url", "left")
    rule, verdict = _decided(F.concat("host", "path"), F.concat(constant, F.coalesce("found", constant)), rules)
    return held.select("row.*", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), ["page_id"])


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    base = sorted(BASE, key=lambda r: -len(r.name or ""))
    fits = [(f"(regexp_matches(host || path, {q(r.pattern)}))", r) for r in base]
    rule = " ".join(f"WHEN {t} THEN {q(r.name)}" for t, r in fits)
    verdict = " ".join(f"WHEN {t} THEN {q(r.action)}" for t, r in fits)
    method = " OR ".join(f"regexp_matches(host || path, {q(r.pattern)})" for r in PATTERNS)
    return f"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {method} THEN 'block' ELSE 'allow' END AS verdict
FROM p
"""


OP5_SQL = _sql()
