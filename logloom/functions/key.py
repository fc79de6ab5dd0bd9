"""The answer key as column expressions: it has one entry per test item."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: item -> (kind, accepted answers per slot)
AnswerKey = Mapping[str, tuple[str, list[list[str]]]]


def _lookup(item: Column, values: Mapping[str, Column]) -> Column:
    pairs = [x for name, value in values.items() for x in (F.lit(name), value)]
    return F.create_map(*pairs)[item]


def kind_of(item: Column, key: AnswerKey) -> Column:
    return _lookup(item, {i: F.lit(kind) for i, (kind, _) in key.items()})


def slots_of(item: Column, key: AnswerKey) -> Column:
    return _lookup(item, {i: F.lit(len(accepted)) for i, (_, accepted) in key.items()})


def accepted_of(item: Column, key: AnswerKey) -> Column:
    """array<array<string>>: the accepted answers of each slot."""
    return _lookup(
        item,
        {
            i: F.array(*[F.array(*[F.lit(a) for a in slot]) for slot in accepted])
            for i, (_, accepted) in key.items()
        },
    )
