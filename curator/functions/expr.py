"""Small helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), 0)


def regex_groups(c: Column, pattern: str, count: int) -> Column:
    """STRUCT<g1, g2, ...> of the capture groups ('' where a group is absent)."""
    return F.struct(*[F.regexp_extract(c, pattern, i).alias(f"g{i}") for i in range(1, count + 1)])


def reasons(*rules: tuple[Column, str | Column]) -> Column:
    """Texts of the rules that hold, in the order given."""
    return F.array_compact(
        F.array(*[F.when(rule, F.lit(text) if isinstance(text, str) else text) for rule, text in rules])
    )
