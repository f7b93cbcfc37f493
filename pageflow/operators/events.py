"""Logs of what readers do: versions that follow a clock, the last of a burst, results of the newest load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import following, running, stretches

# Quiet times before a search and before pages are worked on, in milliseconds.
SEARCH_QUIET_MS, VIEWPORT_QUIET_MS = 250, 180
#: Consecutive numbers of an order that a task sees together.
SPAN = 1 << 16
#: Of times, an hour, in microseconds.
HOUR = 3_600_000_000


def next_versions(log: DataFrame, by: list[str], order: str = "seq", now_ms: str = "now_ms", last: int = 0, span: int = SPAN) -> DataFrame:
    """Add `version`: each is above the one before it in its group, and not below the clock in microseconds.

    The recurrence v = max(v before + 1, 1000 x now) has the closed form
    i + max(last, max over j up to i of 1000 x now_j - j), so it is a running count and a running
    maximum, both in blocks: a group may hold any share of the log.  `order` is a whole number
    that no two rows of a group share; a null clock counts as none.
    """
    block = stretches(F.col(order), span)
    placed = running(log, by, block, [order], F.lit(1).cast("long"), "_i", F.sum)
    ahead = running(placed, by, block, [order], F.col(now_ms).cast("long") * 1000 - F.col("_i"), "_ahead")
    return ahead.withColumn("version", F.col("_i") + F.greatest(F.lit(last).cast("long"), F.col("_ahead"))).drop("_i", "_ahead")


def micros(time: Column) -> Column:
    """Microseconds of a timestamp, with or without a zone."""
    return F.unix_micros(time.cast("timestamp"))


def settled(events: DataFrame, by: list[str], time: str, order: str, quiet_ms: int = SEARCH_QUIET_MS, span_us: int = HOUR) -> DataFrame:
    """The events after which a group is quiet for `quiet_ms`, each with `quiet_at`, when that time is over.

    An event just when that time is over still belongs to the burst.  A burst's last event counts
    (of several at one time the one with the largest `order`), the others do not.  Groups are cut
    by the hour, so one may hold any share of the events; a null time takes no part.
    """
    own = micros(F.col(time))
    met = following(events.filter(F.col(time).isNotNull()), by, stretches(own, span_us), [time, order], own, "_following")
    quiet = F.coalesce(F.col("_following") - own > quiet_ms * 1000, F.lit(True))
    return met.filter(quiet).drop("_following").withColumn("quiet_at", F.col(time) + F.expr(f"INTERVAL {quiet_ms} MILLISECONDS"))


def current_results(results: DataFrame, loads: DataFrame, span_us: int = HOUR) -> DataFrame:
    """Results (document_id, sequence, time) that no newer load (document_id, sequence, time) had overtaken when they came.

    A load at the same time comes first.  Documents are cut by the hour, so one may hold any
    share of the events.
    """
    value = F.struct(*results.columns)
    both = results.select("document_id", "time", F.lit(1).alias("_kind"), F.col("sequence").alias("_seq"), value.alias("_row"))
    both = both.unionByName(loads.select("document_id", "time", F.lit(0).alias("_kind"), F.col("sequence").alias("_seq"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row")))
    newest = running(both, ["document_id"], stretches(micros(F.col("time")), span_us), ["time", "_kind"], F.when(F.col("_kind") == 0, F.col("_seq")), "_newest")
    return newest.filter((F.col("_kind") == 1) & ~F.coalesce(F.col("_newest") > F.col("_seq"), F.lit(False))).select("_row.*")
