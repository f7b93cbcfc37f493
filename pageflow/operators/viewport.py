"""Which pages to work on around the one in view, and what to show about each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Milliseconds a page of distance costs before a fetch and before drawing.
FETCH_MS, RENDER_MS = 250, 180


def radius(nearby: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(nearby))


def page_window(current: Column, total: Column, nearby: Column) -> Column:
    """Pages within the radius and the document; empty if none."""
    start, end = F.greatest(F.lit(1), current - radius(nearby)), F.least(total, current + radius(nearby))
    return F.when(end >= start, F.sequence(start.cast("long"), end.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def work_enabled(page: Column, current: Column, nearby: Column, settled: Column) -> Column:
    return settled & (F.abs(page - current) <= radius(nearby))


def should_start(demo: Column, present: Column, force: Column, cache_only: Column, settled: Column) -> Column:
    return ~demo & (force | ~present) & (force | cache_only | settled)


def prefetch_plan(readers: DataFrame, cached: DataFrame) -> DataFrame:
    """One row a page to fetch, with its delay and whether only the cache is asked.

    `readers` has document_id, current, total, nearby; the band is a sequence a row, so no
    range join is needed.
    """
    pages = readers.select("document_id", "current", F.explode(page_window(F.col("current"), F.col("total"), F.col("nearby"))).alias("page"))
    known = cached.select("document_id", F.col("page").cast("long").alias("page")).distinct().withColumn("cache_only", F.lit(True))
    delay = FETCH_MS + F.abs(F.col("page") - F.col("current")) * FETCH_MS
    return pages.join(known, ["document_id", "page"], "left").select("document_id", "page", delay.alias("delay_ms"), F.coalesce("cache_only", F.lit(False)).alias("cache_only"))


def render_delay(page: Column, current: Column) -> Column:
    """Milliseconds before a page is drawn: the nearer, the sooner."""
    return F.abs(page - current) * RENDER_MS


def page_numbers(documents: DataFrame) -> DataFrame:
    return documents.filter("total >= 1").select("document_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total").cast("long"))).alias("page"))


def page_status(documents: DataFrame, sources: DataFrame, loading: DataFrame, translated: DataFrame) -> DataFrame:
    """(document_id, page, status) of every page: cache, loading, api, present or null, first that holds."""
    key = ["document_id", "page"]
    df = page_numbers(documents).join(sources.select(*key, "source"), key, "left")
    df = df.join(loading.select(*key).distinct().withColumn("_l", F.lit(True)), key, "left").join(translated.select(*key).distinct().withColumn("_t", F.lit(True)), key, "left")
    status = F.when(F.col("source") == "cache", "cache").when(F.col("_l"), "loading").when(F.col("source") == "api", "api").when(F.col("_t"), "present")
    return df.select(*key, status.alias("status"))


def context_pages(df: DataFrame, by: str = "document_id", page: str = "page") -> Column:
    """The page with its neighbours that exist."""
    return F.array_sort(F.collect_list(page).over(W.partitionBy(by).orderBy(page).rangeBetween(-1, 1)))


def running_lengths(by: str, order: str, length: Column) -> Column:
    """Characters before a row."""
    return F.coalesce(F.sum(length).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def progress(page: Column, total: Column) -> Column:
    return F.floor(page * 100 / total + 0.5)


def current_only(events: DataFrame, sequences: DataFrame, by: str = "document_id") -> DataFrame:
    """Drop results of an earlier load of their document."""
    return events.join(sequences.select(by, F.col("sequence").alias("_now")), by).filter(F.col("sequence") == F.col("_now")).drop("_now")
