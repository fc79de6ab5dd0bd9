"""A reproducible shuffle into shards by a permutation of row numbers.

Rows get global numbers in the order of an id: a range shuffle sorts them, and each partition's
count, one small row, gives the numbers before it. A Feistel network over the next power of
four permutes the numbers; values beyond the row count walk on along their cycle until they
fall below it. Shard and slot follow from the permuted number by division, so any of them can
be computed, or turned back into the row's number, without the data.

The law is `rows`: shard sizes differ by one row at most and slots have no gaps. It depends on
the rows, the seed and the shard count, not on partitions or executors: rows of equal id are
ordered by all their columns, and rows equal in all of them can be swapped without a difference.
Null ids come first. Null or empty texts need no special case here. Columns called `row_number`,
`shard` or `slot` are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.common import OWN, mixed
from logloom.session import settle

ROUNDS = 6
IN_PARTITION = 33  # bits that monotonically_increasing_id() leaves for the place in a partition


def round_keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mixed(np.uint64(seed % 2**64) + steps)


def half_bits(n: int) -> int:
    """Bits of each half, so that both together number at least n values."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def network(x: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """One pass of the Feistel network over numbers of 2 * bits bits."""
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for key in keys:
        left, right = right, left ^ (mixed(right ^ key) & mask)
    # Without the last swap, the same network with the keys reversed goes back.
    return (right << np.uint64(bits)) | left


def walk(numbers: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Apply the network until every number is below n."""
    out, bits = numbers.astype(np.uint64), half_bits(n)
    beyond = np.ones(len(out), bool)
    while beyond.any():
        out[beyond] = network(out[beyond], bits, keys)
        beyond = out >= np.uint64(n)
    return out.astype(np.int64)


def permuted(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where the permutation of 0..n-1 puts the numbers."""
    return walk(numbers, n, round_keys(seed))


def original(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The numbers that the permutation puts at `numbers`."""
    return walk(numbers, n, round_keys(seed)[::-1])


def with_row_numbers(df: DataFrame, id_column: str) -> tuple[DataFrame, int]:
    """`df` with `row_number`, 0, 1, ... in the order of the id, and the number of rows."""
    names = [c for c in df.columns if c.lower() != "row_number"]
    others = [F.col(f"`{c}`") for c, kind in df.dtypes if c != id_column and c in names and not kind.startswith("map")]
    order = [F.col(f"`{id_column}`"), F.xxhash64(*others) if others else F.lit(0), *others]
    place = f"{OWN}place"
    placed = settle(
        df.select(*[F.col(f"`{c}`") for c in names])
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(place, F.monotonically_increasing_id())
    ).withColumn(f"{OWN}part", F.shiftright(place, IN_PARTITION))
    # One row per partition, so the unpartitioned window is over a few rows.
    counts = placed.groupBy(f"{OWN}part").agg(F.count(F.lit(1)).alias(f"{OWN}count"))
    before = Window.orderBy(f"{OWN}part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(f"{OWN}start", F.coalesce(F.sum(f"{OWN}count").over(before), F.lit(0)))
    total = counts.agg(F.sum(f"{OWN}count")).first()[0] or 0
    numbered = placed.join(F.broadcast(starts), f"{OWN}part").withColumn(
        "row_number", F.col(f"{OWN}start") + F.col(place).bitwiseAND(F.lit((1 << IN_PARTITION) - 1))
    )
    return numbered.select(*[F.col(f"`{c}`") for c in names], "row_number"), total


def shuffle_into_shards(df: DataFrame, shards: int, id_column: str = "doc_id", seed: int = 42) -> DataFrame:
    """`df` with `row_number`, `shard` and `slot`."""
    numbered, total = with_row_numbers(df, id_column)

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), total, seed))

    kept = [F.col(f"`{c}`") for c in numbered.columns if c.lower() not in ("shard", "slot")]
    at = F.col(f"{OWN}at")
    placed = numbered.select(*kept, place("row_number").alias(f"{OWN}at"))
    return placed.select(
        *kept,
        F.pmod(at, F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"{OWN}at div {shards}").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its files in the order of slots; no task takes a whole shard."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
