"""The operators of this subpackage as queries over the test data, with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import centroids, decontaminate, divergence, fingerprints, id_files, line_dedup, near_dups, packing, personal, preference, quality, sharding, url_filter
from logloom.llm.url_filter import ALLOW, BLOCK, pattern_rule, site_rule
from logloom.session import settle, tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The vocabulary, and the id that ends each document.
VOCABULARY, END_ID = public_tokenizers.path("word_bpe_49k.json"), 2


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tune(spark), sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_preference_pairs(spark, sf_dir):
    """Every conversation as chosen, against one that ends in another's reply."""
    conversations = preference.conversations_of(table(spark, sf_dir, "conversations"), "conv_id")
    pairs = preference.format_pairs(preference.with_foreign_reply(conversations))

    def trained(side: str) -> Column:
        return preference.joined_text(F.filter(side, lambda s: s["trained"]))

    return pairs.select(
        F.col("pair_id").alias("conv_id"), "prompt_turns", F.md5("prompt").alias("prompt_md5"),
        *[F.md5(preference.joined_text(F.col(side))).alias(f"{side}_md5") for side in ("chosen", "rejected")],
        *[F.char_length(trained(side)).cast("long").alias(f"{side}_trained") for side in ("chosen", "rejected")],
        *[F.md5(trained(side)).alias(f"{side}_trained_md5") for side in ("chosen", "rejected")],
    )


@query
def op2_line_dedup(spark, sf_dir):
    """Lines that a document of smaller id has as well are dropped."""
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The rules of the URL query: sites, and marks of copies that a feed or a page list makes.
URL_RULES = [
    site_rule("org", "/", ALLOW),
    site_rule("example.org", "/es/", BLOCK),
    site_rule("example.org", "/en/1", BLOCK),
    site_rule("com", "/fr/", ALLOW),
    site_rule("com", "/de/", BLOCK),
]
URL_PATTERNS = [pattern_rule("?utm_source=*", BLOCK), pattern_rule("?page=*&ref=", BLOCK)]


@query
def op3_template_leaks(spark, sf_dir):
    """Documents that hold benchmark items, as they are or with other parameters."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), verbatim=True)
    return found.select("doc_id", "item_id", F.round("covered", 6).alias("covered"), F.round("consistent", 6).alias("consistent"))


@query
def op4_url_rules(spark, sf_dir):
    """Every page judged by site rules; pages that none fits, by patterns on the whole URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_filter.rule_table(spark, [*URL_RULES, *URL_PATTERNS]))
    of_site = F.col("rule").isin([r.rule for r in URL_RULES])
    return judged.select("page_id", "host", "path", F.when(of_site, F.col("rule")).alias("rule"), "verdict")


@query
def op5_domain_quality(spark, sf_dir):
    """Every document judged by rules, which are stricter on domains that often fail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    judged = quality.judge(settle(quality.with_counts(docs).drop("text")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "domain_strict"
    )


@query
def op6_prob_minhash(spark, sf_dir):
    """The class of each document, over links of a shingle similarity of 0.8 or more."""
    return near_dups.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_bilstm_crf_pii(spark, sf_dir):
    """Personal data and secrets in every document."""
    found = personal.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in ("email", "ip", "card", "phone")],
        F.sha2(personal.listed(base).cast("binary"), 256).alias("base_sha256"), personal.listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"),
    )


@query
def op8_sum_of_squares_packing(spark, sf_dir):
    """All documents in sequences of at most 4096 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, END_ID)
    return packing.numbered(packing.with_crc(pieces)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op9_feistel_shards(spark, sf_dir):
    """All documents in 16 shards, by a permutation of their row numbers."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    sizes = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    sharded = sharding.shuffle_into_shards(sizes, 16)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


@query
def op10_simple8b_files(spark, sf_dir):
    """The ids of all documents, written to files in the order of doc_id and read back."""
    files = id_files.write(table(spark, sf_dir, "documents"), VOCABULARY, END_ID)
    return id_files.read(files).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


@query
def op11_subvector_centroids(spark, sf_dir):
    """Every vector in one of eight clusters, after ten exact rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op12_minhash_fingerprints(spark, sf_dir):
    """Every document's fingerprint against those of its edited text and of the next document."""
    found = fingerprints.against_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns({c: fingerprints.as_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


@query
def op13_divergence_audit(spark, sf_dir):
    """How far the sources of each language are apart, and the terms that tell a source from its language."""
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))
