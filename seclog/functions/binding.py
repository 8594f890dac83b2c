"""Name an intermediate value inside one Column expression, so that it runs once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def only_if(value: Column, condition: Callable[[Column], Column]) -> Column:
    """``value`` where the condition holds for it, else null; evaluated once."""
    return F.get(F.filter(F.array(value), condition), F.lit(0))
