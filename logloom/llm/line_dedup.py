"""Lines that several documents share stay in one of them only.

Lines are exploded with their positions, normalised and hashed. Counting documents per hash is
done in two aggregations, first per (hash, document) and then per hash, so a line that a third
of all documents hold is counted where it is read and never gathered. The lines to drop come
back to their document as a sorted list of positions, and the text is cut between them.

Null or empty texts are one empty line. Rows with a null id hold no document's lines: they
count for nothing and keep all lines. Rows of the same id are one document, and if their texts
are equal too they get equal results. All other columns stay; columns called `n_lines` or
`n_dropped` are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import SPACES, ascii_lower, carried, double_hash, restored
from logloom.session import settle


def drop_shared_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_docs: int = 2,
    min_chars: int = 10,
) -> DataFrame:
    """`docs` without the lines that a smaller id has, with `n_lines` and `n_dropped`.

    A line counts as its key: spaces stripped at both ends, A-Z in lower case. Keys shorter
    than `min_chars` are never dropped, others where at least `min_docs` documents have them.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    of_row = dict(zip(("text1", "text2"), double_hash(text), strict=True))
    base = docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text"))
    lines = (
        base.where("id IS NOT NULL")
        .select("id", *[h.alias(n) for n, h in zip(of_row, double_hash(F.col("text")), strict=True)], F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("key", ascii_lower(F.btrim("line", F.lit(SPACES))))
        .where(F.char_length("key") >= min_chars)
        .select("id", "text1", "text2", "pos", *[h.alias(n) for n, h in zip(("key1", "key2"), double_hash(F.col("key")), strict=True)])
    )
    # Written first: few shared lines are sent to where the lines are; many are shuffled like the
    # lines, and a join of two shuffles splits the partition of a line that very many documents have.
    shared = settle(
        lines.groupBy("key1", "key2", "id")
        .agg(F.lit(1).alias("one"))
        .groupBy("key1", "key2")
        .agg(F.count("id").alias("documents"), F.min("id").alias("first_id"))
        .where(F.col("documents") >= min_docs)
        .select("key1", "key2", "first_id")
    )
    dropped = (
        lines.join(shared, ["key1", "key2"])
        .where("id != first_id")
        .groupBy("id", "text1", "text2")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )
    whole = carried(docs, id=F.col(f"`{id_column}`"), text=text, **of_row)
    found = whole.join(dropped, ["id", "text1", "text2"], "left").withColumn("lines", F.split("text", "\n", -1))
    kept_runs = F.zip_with(
        F.concat(F.array(F.lit(1)), F.transform("gone", lambda p: p + 2)),
        F.concat("gone", F.array(F.size("lines"))),
        lambda start, end: F.slice("lines", start, end + 1 - start),
    )
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(kept_runs), "\n"))
    return restored(
        found,
        docs.columns,
        **{
            text_column: kept,
            "n_lines": F.size("lines").cast("long"),
            "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
        },
    )
