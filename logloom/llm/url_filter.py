"""URLs judged by pattern rules, which an index of literal tokens finds.

A rule is a regular expression with the literal tokens that every URL it fits must have.
Each rule is filed under the one of its tokens that the fewest of the URLs have; the tokens of
a URL fetch its candidate rules by an equality join, and only candidates run their expression.
Rules without a sure token are filed under the empty token, which every URL has. The longest
fitting rule of a level wins; of equally long ones a blocking rule, then the alphabetically first.

A rule of a lower level beats all of higher ones: site rules have level 0, patterns 1.
Distinct URLs are judged and cut into tokens once, however many rows share one. A null URL, or one without `://`,
has an empty host and path; only rules on the whole URL can fit it. Rows are never dropped, all
columns stay, and those named `host`, `path`, `rule` or `verdict` are replaced. Empty tables of
URLs or rules are fine: without rules, every verdict is the default.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import ascii_lower, carried, restored
from logloom.session import settle

ALLOW, BLOCK = "allow", "block"
RULE_SCHEMA = "rule string, verdict string, regex string, tokens array<string>, level int"
#: Between host and path and the whole URL in the text that rules are run on. Neither host nor path holds one.
BETWEEN = "?"


@dataclass(frozen=True)
class Rule:
    """`rule` is its name, and its length its rank. `regex` is run on `judged_text`."""

    rule: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    level: int = 0


def words_of(literal: str) -> list[str]:
    return re.findall("[a-z0-9]+", literal.lower())


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and all its subdomains, where the path starts with `path`."""
    # What follows the path is open, so its last token may be the start of a longer one.
    whole = re.sub("[A-Za-z0-9]+$", "", path)
    regex = rf"^(?:[^/?]*\.)?{re.escape(host)}" + (re.escape(path) if path else "(?=[/?])")
    return Rule(host + path, verdict, regex, tuple(words_of(host) + words_of(whole)))


def pattern_rule(pattern: str, verdict: str) -> Rule:
    """Fits where the pattern occurs anywhere in the URL; `*` stands for any characters."""
    literals = pattern.lower().split("*")
    regex = r"(?s)^[^?]*\?.*" + ".*".join(re.escape(x) for x in literals)
    # Next to `*` or an end of the pattern a token may go on in the URL.
    inner = [re.sub("^[a-z0-9]+|[a-z0-9]+$", "", x) for x in literals]
    return Rule(pattern, verdict, regex, tuple(w for x in inner for w in words_of(x)), 1)


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """The rules as a table of literals, whose size is known when joins with it are planned."""

    def row(r: Rule) -> Column:
        tokens = F.array(*[F.lit(t) for t in sorted(set(r.tokens))]).cast("array<string>")
        values = {"rule": F.lit(r.rule), "verdict": F.lit(r.verdict), "regex": F.lit(r.regex), "tokens": tokens, "level": F.lit(r.level)}
        return F.struct(*[value.alias(name) for name, value in values.items()])

    rows = [row(r) for r in rules]
    if not rows:
        return spark.createDataFrame([], RULE_SCHEMA)
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged_text(url: Column) -> Column:
    """Host and path as they are compared, and the whole URL in lower case."""
    return F.concat(host_of(url), path_of(url), F.lit(BETWEEN), ascii_lower(F.coalesce(url, F.lit(""))))


def judge(urls: DataFrame, rules: DataFrame, url_column: str = "url", default: str = ALLOW) -> DataFrame:
    """`urls` with `host`, `path`, the winning `rule` or null, and its `verdict` or the default.

    `rules` has the columns of RULE_SCHEMA.
    """
    url = F.col(f"`{url_column}`")
    distinct = urls.select(F.coalesce(url, F.lit("")).alias("url")).distinct().withColumn("text", judged_text(F.col("url")))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))
    by_token = distinct.select("url", "text", F.explode(F.concat(tokens, F.array(F.lit("")))).alias("token"))

    filed = rules.select("rule", "verdict", "regex", "level", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    # Only tokens that rules have go on, and are written: they are counted, and looked up again.
    hits = settle(by_token.join(filed.select("token").distinct(), "token"))
    how_many = hits.groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    rarest = settle(
        filed.join(how_many, "token", "left")
        .groupBy("rule", "verdict", "regex", "level")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)), "token")).getField("token").alias("token"))
    )
    fitting = hits.join(rarest, "token").where(F.rlike(F.col("text"), F.col("regex")))
    # The smallest of (level, minus length, allow after block, name) wins; min keeps one row per URL.
    order = F.struct(
        F.col("level"), (-F.char_length("rule")).alias("length"), (F.col("verdict") != BLOCK).alias("allows"), F.col("rule"), F.col("verdict")
    )
    best = fitting.groupBy("url").agg(F.min(order).alias("best"))
    whole = carried(urls, url=F.coalesce(url, F.lit("")), host=host_of(url), path=path_of(url))
    return restored(
        whole.join(best, "url", "left"),
        urls.columns,
        host=F.col("host"),
        path=F.col("path"),
        rule=F.col("best")["rule"],
        verdict=F.coalesce(F.col("best")["verdict"], F.lit(default)),
    )
