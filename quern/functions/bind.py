"""Values that a higher-order function uses many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: what a lambda mentions from outside is else computed again for each element."""
    return F.transform(F.array(value), use)[0]
