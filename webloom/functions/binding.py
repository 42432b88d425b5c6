"""Values bound once within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda binds it, so neither the plan nor compiled code repeats it."""
    return F.element_at(F.transform(F.array(value), body), 1)
