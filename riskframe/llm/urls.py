"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens
(maximal runs of ASCII letters and digits) that every URL it fits must hold.
The corpus says how many URLs hold each rule token; a rule is filed under its
rarest one (a rule without a literal token under the token every URL has).  The
distinct URLs' tokens fetch candidate rules by an equi-join and only those run
their expression; the verdicts are joined back to the rows.  DataFrame
functions only.

Defined results: null URLs and URLs without ``://`` have empty host and path
and take the default verdict unless a rule fits the empty string; equal URLs are
judged once; no rule: the default for every row; empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import broadcast_within, save

TOKEN = r"[A-Za-z0-9]+"
EVERY = ""      # the token of rules without a literal one; every URL holds it


@dataclass(frozen=True)
class Rule:
    """``listed`` rules outrank the others and are named in the result;
    among the rules that fit, the longest name wins (then the smaller name,
    then block before allow)."""
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    listed: bool = False


def host_rule(verdict: str, name: str) -> Rule:
    """``example.net/en/``: the host and all subdomains, paths that start with /en/."""
    host, slash, path = name.partition("/")
    path = slash + path
    # a run of letters at the very end of the path may go on in the URL: no token
    cut = re.sub(TOKEN + r"\Z", "", path) if path else ""
    return Rule(name, r"^(?:[^/]*\.)?" + re.escape(host) + (re.escape(path) if path else "(?:/|$)"),
                tuple(re.findall(TOKEN, host)) + tuple(re.findall(TOKEN, cut)), verdict, True)


def word_rule(word: str, verdict: str = "block") -> Rule:
    """The word stands alone in the host (``casino`` fits casino-win.example.com)."""
    return Rule(f"word:{word}", rf"^(?:[^/]*[.\-])?{re.escape(word)}(?:[.\-][^/]*)?(?:/|$)", tuple(re.findall(TOKEN, word)), verdict)


#: The listed rules of the contract.
LISTED = (host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"),
          host_rule("allow", "org/fr/"))
#: Words that mark unwanted hosts when they stand alone in a host name.
UNWANTED = ("adult", "porn", "casino", "bets", "pills", "spam", "ads", "warez")
RULES = LISTED + tuple(word_rule(w) for w in UNWANTED)


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as rows (name, pattern, tokens, verdict, listed)."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("name", "pattern")], F.array(F.lit("")).alias("tokens"),
                                     F.lit("").alias("verdict"), F.lit(False).alias("listed"))
    rows = [F.struct(F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"),
                     (F.array(*[F.lit(t) for t in sorted(set(r.tokens))]) if r.tokens else F.array(F.lit(EVERY))).alias("tokens"),
                     F.lit(r.verdict).alias("verdict"), F.lit(r.listed).alias("listed")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty where there is none."""
    whole = r"://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, whole, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, whole, 2), F.lit(""))


def judge(rows: DataFrame, rules: DataFrame, url_col: str = "url", keep: Sequence[str] = (), default: str = "allow") -> DataFrame:
    """``keep`` columns, host, path, rule (a listed rule's name or null), verdict."""
    host, path = host_path(F.col(f"`{url_col}`"))
    d = rows.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    subject = F.concat("host", "path")
    urls = save(d.select("host", "path").distinct(), "urls")
    held = urls.select("host", "path", F.explode(F.array_append(F.array_distinct(F.regexp_extract_all(subject, F.lit(f"({TOKEN})"), 1)),
                                                                F.lit(EVERY))).alias("token"))
    # how many distinct URLs hold each token that some rule has
    listed = save(rules.select("name", "pattern", "verdict", "listed", F.explode("tokens").alias("token")), "url-rule-tokens")
    ruled = broadcast_within(save(listed.select("token").distinct(), "url-tokens"))
    counts = held.join(ruled, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = save(listed.join(counts, "token", "left").groupBy("name", "pattern", "verdict", "listed").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")), "url-index")
    fits = held.join(broadcast_within(index), "token").where(F.expr("concat(host, path) RLIKE pattern"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        "listed", F.when(F.col("listed"), F.length("name")).otherwise(0).alias("len"), (F.col("verdict") == "block").alias("block"),
        "name", "verdict")).alias("b"))
    out = d.join(save(best, "url-verdicts"), ["host", "path"], "left")
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "host", "path",
                      F.when(F.col("b.listed"), F.col("b.name")).alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
