"""Quality rules per document, and stricter ones for domains whose documents often fail.

Counts per text are columns of its row: nothing is exploded, so a document's windows never
leave its task. Rule failures are counted per domain in a partial aggregation, so a domain with
a third of all documents is a few rows before any shuffle. A domain's failure rate is shrunk
towards all domains' by a beta prior fitted to the domains (method of moments). Domains that stand out become
strict: their shrunk rate is above the prior's mean by DEVIATIONS standard deviations of their own posterior, so that
few documents can't make it by chance, and by SPREADS of the prior's, so that many documents don't make an ordinary domain
stand out. The documents of strict domains must pass the soft rules as well.
Verdicts come back to the documents by a join on the domain, one row each.

A document fails the hard rules if it has few words, mostly repeated windows of words, or many
symbols. Soft rules are about repeated lines and the length of words; on a domain that is not
strict they count for nothing, so a clean document is not lost for one odd trait.

Null or empty texts have no words and fail. Null domains are one domain. Other columns stay; those
with the names of NEW are replaced. An empty table gives an empty one, with the prior unused.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import SPACE_CLASS, SPACES, carried, restored
from logloom.session import settle

WINDOW = 8
MIN_WORDS = 20
#: Shares in percent, compared in whole numbers.
MAX_REPEATED, MAX_SYMBOLS, MAX_SAME_LINES = 30, 10, 30
MIN_WORD_CHARS, MAX_WORD_CHARS = 3, 10
#: A domain is strict if its shrunk share of failing documents exceeds the prior's mean by so many standard
#: deviations of its posterior, and by so many of the prior.
DEVIATIONS, SPREADS = 3.0, 1.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
NEW = [*COUNTS, "base_failed", "hard_failed", "soft_failed"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` worked out once even where `use` has it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words are in windows that occur twice or more."""

    def of_windows(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(by_hash, lambda s: let(repeats(s), covered))

    def repeats(s: Column) -> Column:
        """The sorted starts of windows that have an equal."""
        def twice(x: Column, i: Column) -> Column:
            near = [F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False)) for j in (i - 1, i + 1)]
            return F.when(near[0] | near[1], x["i"])

        return F.sort_array(F.array_compact(F.transform(s, twice)))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def of_words(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(of_windows(w)))

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_words))


def with_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with the columns of NEW."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    whole = carried(docs, text=text, trimmed=F.btrim(text, F.lit(SPACES)))
    words = F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACE_CLASS + "+", -1))
    counted = whole.withColumn("words", words).withColumn(
        "full_lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    )
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": F.size(F.split("text", "[#*$%&|<>]", -1)) - 1,
        "n_lines": F.size("full_lines"),
        "n_dup_lines": F.size("full_lines") - F.size(F.array_distinct("full_lines")),
        "n_repeat_words": repeated_words(F.col("words")),
    }
    numbers = counted.select("row", *[c.cast("long").alias(f"own_{name}") for name, c in counts.items()])
    n = {name: F.col(f"own_{name}") for name in counts}
    base = (n["n_words"] < MIN_WORDS) | (100 * n["n_repeat_words"] > MAX_REPEATED * n["n_words"])
    soft = (
        (100 * n["n_dup_lines"] > MAX_SAME_LINES * n["n_lines"])
        | (n["word_chars"] < MIN_WORD_CHARS * n["n_words"])
        | (n["word_chars"] > MAX_WORD_CHARS * n["n_words"])
    )
    hard = base | (100 * n["n_symbols"] > MAX_SYMBOLS * n["n_words"])
    return restored(numbers, docs.columns, **n, base_failed=base, hard_failed=hard, soft_failed=soft)


def beta_prior(domains: DataFrame) -> DataFrame:
    """One row with `alpha` and `beta`, by the moments of the domains' rates.

    Domains weigh by their documents. If their rates vary no more than chance would make them,
    or the table is empty, the prior is as strong as all documents together, or weak for none.
    """
    sums = domains.agg(
        F.sum("documents").cast("double").alias("n"),
        F.sum("failed").cast("double").alias("f"),
        F.sum(F.col("failed") * F.col("failed") / F.col("documents")).alias("ff"),
        F.sum(F.col("documents") * F.col("documents")).cast("double").alias("nn"),
        F.count(F.lit(1)).cast("double").alias("k"),
    )
    mean = F.expr("CASE WHEN n > 0 THEN f / n ELSE 0.5D END")
    with_mean = sums.select("*", mean.alias("mean"))
    # Weighted variance between domains without the part that counts of their size have by chance.
    between = F.expr("CASE WHEN n > nn / n THEN greatest(0D, (ff - n * mean * mean - (k - 1) * mean * (1 - mean)) / (n - nn / n)) ELSE 0D END")
    strength = F.expr("CASE WHEN between > 0 AND mean > 0 AND mean < 1 THEN greatest(1D, mean * (1 - mean) / between - 1) ELSE greatest(1D, coalesce(n, 1D)) END")
    prior = with_mean.select("*", between.alias("between")).select("mean", strength.alias("strength"))
    return prior.select((F.col("mean") * F.col("strength")).alias("alpha"), ((1 - F.col("mean")) * F.col("strength")).alias("beta"))


def strict_domains(
    counted: DataFrame, domain_column: str = "source", deviations: float = DEVIATIONS, spreads: float = SPREADS
) -> DataFrame:
    """`domain`, `documents`, `failed`, `shrunk_rate` and `strict` of each domain."""
    domains = counted.groupBy(F.col(f"`{domain_column}`").alias("domain")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("hard_failed").cast("long")).alias("failed")
    )
    prior = beta_prior(domains).first()  # two numbers
    strength = prior["alpha"] + prior["beta"]
    mean = prior["alpha"] / strength
    rate = (F.col("failed") + F.lit(prior["alpha"])) / (F.col("documents") + F.lit(strength))
    excess, posterior = F.col("shrunk_rate") - F.lit(mean), F.col("documents") + F.lit(strength + 1)
    by_chance = F.lit(deviations) * F.sqrt(F.col("shrunk_rate") * (1 - F.col("shrunk_rate")) / posterior)
    usual = F.lit(spreads * math.sqrt(mean * (1 - mean) / (strength + 1)))
    return domains.withColumn("shrunk_rate", rate).withColumn("strict", (excess > by_chance) & (excess > usual))


def judge(
    counted: DataFrame, domain_column: str = "source", deviations: float = DEVIATIONS, spreads: float = SPREADS
) -> DataFrame:
    """`counted`, from `with_counts` and settled, with `domain_strict` and `kept`."""
    # Written first, the domains have a known size when the join is planned: while they are few,
    # the documents stay where they are.
    domains = settle(
        strict_domains(counted, domain_column, deviations, spreads).select("domain", F.col("strict").alias("own_strict"))
    )
    whole = carried(counted, domain=F.col(f"`{domain_column}`"), hard=F.col("hard_failed"), soft=F.col("soft_failed"))
    found = whole.join(domains, whole["domain"].eqNullSafe(domains["domain"]), "left")
    strict = F.coalesce("own_strict", F.lit(False))
    return restored(found, counted.columns, domain_strict=strict, kept=~F.col("hard") & ~(strict & F.col("soft")))


def filter_documents(docs: DataFrame, text_column: str = "text", domain_column: str = "source") -> DataFrame:
    """The rows of `docs` that are kept, with its columns only."""
    judged = judge(settle(carried_counts(docs, text_column, domain_column)), "own_domain")
    return judged.where("kept").select(*[judged["row"].getField(c).alias(c) for c in docs.columns])


def carried_counts(docs: DataFrame, text_column: str, domain_column: str) -> DataFrame:
    """The counts beside `row`, which has all columns of `docs` untouched."""
    beside = carried(docs, text=F.col(f"`{text_column}`"), own_domain=F.col(f"`{domain_column}`"))
    return with_counts(beside).drop("text")
