"""Values that an expression uses more than once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once a row, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
