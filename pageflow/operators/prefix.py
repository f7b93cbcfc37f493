"""Running values through long ordered groups, in blocks: no group has to lie in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, by: list[str], block: Column, order: list[str], value: Column, name: str, fold: Callable[[Column], Column] = F.max, own: bool = True) -> DataFrame:
    """Add `name`: the maximum (or sum) of `value` over a group's rows up to this one, without it if not `own`.

    Rows of a group are cut into blocks, which must rise with the order.  Blocks are folded by
    themselves, a window over one row a block carries their values on, and each row adds what
    its block has so far.  So a group is as wide as its blocks are many.  Null groups are a
    group; null values do not count.
    """
    rows = df.withColumn("_block", block).withColumn("_value", value)
    start = 0 if own else -1
    inside = W.partitionBy(*by, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, start)
    upto = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_block").agg(fold("_value").alias("_total"))
    carry = totals.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate([*by, "_block"])), fold("_total").over(upto).alias("_carry"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate([*by, "_block"])]
    met = rows.withColumn("_inside", fold("_value").over(inside)).join(carry, same, "left")
    both = F.greatest("_inside", "_carry") if fold is F.max else F.coalesce("_inside", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    return met.select(*df.columns, both.alias(name))


def following(df: DataFrame, by: list[str], block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Add `name`: the next row's `value` in a group, or null; `value` must rise with the order, as blocks must.

    Within a block it is the next row's, and a block's last row gets the least of the next block.
    """
    rows = df.withColumn("_block", block).withColumn("_value", value)
    firsts = rows.groupBy(*by, "_block").agg(F.min("_value").alias("_least"))
    upon = F.lead("_least").over(W.partitionBy(*by).orderBy("_block"))
    carry = firsts.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate([*by, "_block"])), upon.alias("_carry"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate([*by, "_block"])]
    inside = F.lead("_value").over(W.partitionBy(*by, "_block").orderBy(*order))
    met = rows.withColumn("_inside", inside).join(carry, same, "left")
    return met.select(*df.columns, F.coalesce("_inside", "_carry").alias(name))


def stretches(order: Column, span: int) -> Column:
    """Blocks of `span` consecutive numbers."""
    return F.floor(order / span)
