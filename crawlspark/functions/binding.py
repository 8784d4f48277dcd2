"""Name an intermediate value inside one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it.

    Array functions bind their lambda argument, so a one-element array does the naming
    and the row needs no helper column.
    """
    return F.transform(F.array(value), body)[0]
