"""Structs with explicit field names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def record(**fields: Column) -> Column:
    """named_struct; aliases inside ``struct`` are lost around lambdas."""
    return F.named_struct(*[x for name, col in fields.items() for x in (F.lit(name), col)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is used several times but computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
