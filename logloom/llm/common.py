"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The operators' own columns start with this, so that no column of the input has their name.
OWN = "__own_"
#: Characters that separate words: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def carried(docs: DataFrame, **columns: Column) -> DataFrame:
    """One struct `row` with all columns of `docs`, whatever their names, beside `columns`."""
    row = F.struct(*[docs[f"`{name}`"] for name in docs.columns])
    return docs.select(row.alias("row"), *[c.alias(name) for name, c in columns.items()])


def restored(df: DataFrame, names: Iterable[str], **new: Column) -> DataFrame:
    """The columns of `row` again; those in `new` replace others of their name, or follow."""
    by_lower = {name.lower(): (name, c) for name, c in new.items()}
    names = list(names)
    out = []
    for name in names:
        found = by_lower.get(name.lower())
        out.append((found[1] if found else df["row"].getField(name)).alias(name))
    old = {name.lower() for name in names}
    out += [c.alias(name) for name, c in new.items() if name.lower() not in old]
    return df.select(*out)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def double_hash(*columns: Column) -> tuple[Column, Column]:
    """128 bits in two columns: distinct values stay distinct at any size that occurs."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit function of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
