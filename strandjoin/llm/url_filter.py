"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over `host + path` (or the whole url) with the literal tokens
that any url it fits must hold. Each rule stands in the index under the one of its tokens that
is rarest in the urls at hand, counted over all of them. The tokens of a url fetch candidate
rules, and only those run their expression. Rules without a token stand under the empty token,
which every url has.

Two kinds of rules share the index: path rules (allow or block, by host suffix and path prefix;
the longest that fits decides) and patterns (block when no path rule fits).

Defined results: a null url, or one without `://`, has empty host and path and no tokens; no
path rule fits it and the verdict is allow unless a token-free pattern fits. Repeated rows are
judged alike, each with a row of its own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandjoin.llm.common import ascii_lower

#: Verdict and rule, as the contract of the query states them.
PATH_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Expressions over the lower-cased url that block it when no path rule fits, with the tokens
#: that each needs.
PATTERNS = (
    (r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    (r"://([^/?#]*\.)?casino-win\.", ("casino", "win")),
    (r"://[^?#]*/(login|signin|logout)([/?#.]|$)", ()),
    (r"://[^/?#]*\.(xxx|porn|adult)([:/?#]|$)", ()),
)
#: Up to so many bytes of rules are broadcast; a larger index is joined by shuffle.
BROADCAST_RULES = 100_000


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(text: Column) -> Column:
    """Distinct runs of letters and digits, lower case, and the empty token."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.concat(F.array(F.lit("")), found))


def path_rule(verdict: str, rule: str) -> tuple:
    """As a row of the rule table. Tokens: those of the host, and of the path those that end
    inside the rule; the last one may go on in the url."""
    name, slash, rest = rule.partition("/")
    expression = rf"^([^/]*\.)?{re.escape(name)}{re.escape(slash + rest)}"
    whole = re.findall("[a-z0-9]+(?=[^a-z0-9])", (name + slash + rest).lower())
    return rule, verdict, expression, True, len(rule), whole


def pattern_rule(expression: str, needs: Sequence[str]) -> tuple:
    return expression, "block", expression, False, 0, list(needs)


def rule_table(spark: SparkSession, path_rules=PATH_RULES, patterns=PATTERNS) -> DataFrame:
    rows = [path_rule(*r) for r in path_rules] + [pattern_rule(*p) for p in patterns]
    schema = "rule string, verdict string, expression string, by_path boolean, weight int, needs array<string>"
    return spark.createDataFrame(rows, schema)


def index_rules(rules: DataFrame, urls: DataFrame, small: bool) -> DataFrame:
    """Each rule under its rarest token, by the number of urls that hold the token."""
    needed = rules.select(F.explode("needs").alias("token")).distinct()
    held = urls.select(F.explode_outer("tokens").alias("token"))
    counts = held.join(F.broadcast(needed) if small else needed, "token").groupBy("token")
    counts = counts.agg(F.count(F.lit(1)).alias("urls"))
    wanted = rules.select("rule", F.explode_outer("needs").alias("token"))
    ranked = wanted.join(counts, "token", "left").select(
        "rule", F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), F.coalesce("token", F.lit("")).alias("token")).alias("t")
    )
    rarest = ranked.groupBy("rule").agg(F.min("t.token").alias("any"), F.min("t").alias("t"))
    return rules.drop("needs").join(rarest.select("rule", "t.token"), "rule")


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: page_id, url, host, path, rule (of the path rule that decides, or null), verdict."""
    keys = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    keys = keys.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    urls = keys.withColumn("tokens", tokens(F.col("url")))
    size = rules.agg(F.sum(F.length("expression") + 64)).first()[0] or 0
    small = size <= BROADCAST_RULES
    index = index_rules(rules, urls, small)
    probes = urls.select("page_id", "url", "host", "path", F.explode_outer("tokens").alias("token"))
    candidates = probes.join(F.broadcast(index) if small else index, "token")
    subject = F.when(F.col("by_path"), F.concat("host", "path")).otherwise(ascii_lower(F.col("url")))
    fits = candidates.where(F.regexp_like(subject, F.col("expression")))
    order = F.struct("by_path", "weight", "rule", "verdict")
    best = fits.groupBy(F.col("page_id").alias("_id"), F.col("url").alias("_url"))
    best = best.agg(F.max(order).alias("best"))
    match = F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url"))
    return keys.join(best, match, "left").select(
        "page_id",
        "url",
        "host",
        "path",
        F.when(F.col("best.by_path"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
    )
