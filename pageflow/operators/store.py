"""Keyed tables kept as folds over their logs: lookups, versioned and last-write-wins upserts, validation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim

# Limits of what is accepted.
KEY_PREFIX, KEY_LENGTH, DOCUMENT_LENGTH, PAYLOAD_LENGTH, CONTENTS_LENGTH, OFFSET = "layout-v3::", 2048, 128, 1048576, 262144, 10000
SUFFIX_LENGTH = 1800
FINGERPRINT = r"\A(?:[a-f0-9]{64}|fnv1a-[a-f0-9]{16})\z"
LIBRARY = 200
KEY_PARTS = ("document_id", "page", "provider", "endpoint", "model", "effort", "language")


def cache_key(*parts: Column) -> Column:
    """The key of a translation from its parts; null parts count as empty."""
    return F.concat_ws("::", F.lit("layout-v3"), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def valid_document(x: Column) -> Column:
    return F.coalesce((F.length(x) > 0) & (F.length(x) <= DOCUMENT_LENGTH), F.lit(False))


def valid_key(x: Column) -> Column:
    return F.coalesce(x.startswith(KEY_PREFIX) & (F.length(x) <= KEY_LENGTH), F.lit(False))


def index_request_valid(document: Column, suffix: Column) -> Column:
    """Whether a request for the cached pages is one: a document id and a settings suffix, neither too long."""
    return F.coalesce(F.length(document).between(1, DOCUMENT_LENGTH) & F.length(suffix).between(1, SUFFIX_LENGTH), F.lit(False))


def valid_fingerprint(x: Column) -> Column:
    return F.coalesce(x.rlike(FINGERPRINT), F.lit(False))


def checked_translations(log: DataFrame) -> DataFrame:
    """Add `rejected`: why an upsert is refused, or null."""
    reason = (
        F.when(~valid_key(F.col("cache_key")), "key")
        .when(~valid_document(F.col("document_id")), "document")
        .when(F.coalesce(F.col("page") < 1, F.lit(True)), "page")
        .when(F.col("payload").isNull(), "payload")
        .when(F.length("payload") > PAYLOAD_LENGTH, "size")
    )
    return log.withColumn("rejected", reason)


def upsert_versioned(log: DataFrame, key: str = "cache_key", version: str = "cache_version", order: str = "arrival", fixed: tuple[str, ...] = ("document_id", "page"), value: tuple[str, ...] = ("payload", "updated_at")) -> DataFrame:
    """State after a log of upserts, of which one applies only if its version is not below the stored one.

    Equal versions: the later arrival wins.  A missing version counts as 0.  `fixed` columns
    keep what the first arrival brought.  One aggregation, partial before the shuffle, and
    the same for any order of the rows.  What it returns is a state: with `first_arrival`
    it can stand in a log itself.
    """
    rank = F.struct(F.coalesce(F.col(version), F.lit(0)), F.col(order))
    began = F.coalesce(f"first_{order}", order) if f"first_{order}" in log.columns else F.col(order)
    kept = [F.min_by(F.struct(c), began)[c].alias(c) for c in fixed]
    return log.groupBy(key).agg(*kept, *(F.max_by(F.struct(c), rank)[c].alias(c) for c in value), F.max(F.coalesce(F.col(version), F.lit(0))).alias(version), F.min(began).alias(f"first_{order}"), F.max(rank)[order].alias(order))


def upsert_latest(log: DataFrame, key: list[str], order: str = "arrival", fixed: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key, nulls included; `fixed` columns stay as first written."""
    rest = [c for c in log.columns if c not in key and c not in fixed and c != order]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("_last")
    first = [F.min_by(F.struct(c), F.col(order))[c].alias(c) for c in fixed]
    return log.groupBy(*key).agg(*first, last, F.max(order).alias(order)).select(*key, *fixed, *(F.col(f"_last.{c}").alias(c) for c in rest), order)


def fold_into(base: DataFrame, batch: DataFrame, **how) -> DataFrame:
    """Versioned upsert of a batch into a stored state, in any order of arrival: what the whole log gives."""
    return upsert_versioned(base.unionByName(batch, allowMissingColumns=True), **how)


def library(books: DataFrame, most: int = LIBRARY) -> DataFrame:
    """The newest books."""
    return books.orderBy(F.desc("uploaded_at"), "id").limit(most)


def find_book(books: DataFrame, wanted: str) -> DataFrame:
    """One book by its id or fingerprint."""
    if not 1 <= len(wanted) <= 256:
        raise ValueError("a book id has 1 to 256 characters")
    return books.filter((F.col("id") == wanted) | (F.col("fingerprint") == wanted)).orderBy("id").limit(1)


def find_translation(translations: DataFrame, key: str) -> DataFrame:
    if not (key.startswith(KEY_PREFIX) and len(key) <= KEY_LENGTH):
        raise ValueError("not a translation key")
    return translations.filter(F.col("cache_key") == key)


def cached_pages(translations: DataFrame, suffix: str, document: str | None = None) -> DataFrame:
    """(document_id, page) that have a translation with these settings; the suffix reaches the scan."""
    df = translations.filter(F.endswith("cache_key", F.lit(f"::{suffix}")) & (F.col("page") > 0))
    if document is not None:
        df = df.filter(F.col("document_id") == document)
    return df.select("document_id", "page").distinct()


def navigation_of(pages: DataFrame, settings: DataFrame, document: str | None = None) -> DataFrame:
    """Navigation rows with their document's manual offset."""
    if document is not None:
        if not re.fullmatch(r".{1,128}", document, re.S):
            raise ValueError("a document id has 1 to 128 characters")
        pages = pages.filter(F.col("document_id") == document)
    return pages.filter("pdf_page > 0").join(settings.select("document_id", "manual_offset"), "document_id", "left")


def unseen(batch: DataFrame, state: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Rows whose key and content signature the state does not have yet."""
    sign = F.sha2(F.to_json(F.struct(*content)), 256)
    return batch.withColumn("signature", sign).join(state.select(*key, sign.alias("signature")).distinct(), [*key, "signature"], "left_anti")


def checked_settings(log: DataFrame) -> DataFrame:
    """Manual offsets within bounds; null clears one."""
    return log.filter(F.col("manual_offset").isNull() | (F.abs("manual_offset") <= OFFSET))


def checked_observations(log: DataFrame) -> DataFrame:
    """Add the entries as JSON, and `rejected`: why an observation is refused, or null.

    Takes document_id and `observation`.
    """
    entries = F.to_json("observation.tocEntries", {"ignoreNullFields": "false"})
    # titles and labels alone may be too long: then no JSON is made to find out
    letters = F.aggregate("observation.tocEntries", F.lit(0).cast("long"), lambda n, e: n + F.coalesce(F.length(e["title"]), F.lit(0)) + F.coalesce(F.length(e["label"]), F.lit(0)))
    large = F.coalesce(letters > CONTENTS_LENGTH, F.lit(False)) | (F.length("toc_entries") > CONTENTS_LENGTH)
    reason = F.when(~valid_document(F.col("document_id")), "document").when(F.coalesce(F.col("observation.pdfPage") < 1, F.lit(True)), "page").when(large, "size")
    return log.withColumn("toc_entries", entries).withColumn("rejected", reason)


def upsert_navigation(log: DataFrame, order: str = "arrival") -> DataFrame:
    """Stored navigation pages after a log of observations: the last accepted one of each page."""
    o = F.col("observation")
    rows = checked_observations(log).filter("rejected IS NULL").select(
        "document_id", o["pdfPage"].cast("int").alias("pdf_page"), o["isTableOfContents"].alias("is_table_of_contents"), "toc_entries",
        o["anchor"]["label"].alias("page_label"), o["anchor"]["value"].alias("page_value"), o["anchor"]["numbering"].alias("numbering"), order,
    )
    return upsert_latest(rows, ["document_id", "pdf_page"], order)


def typed_books(rows: DataFrame) -> DataFrame:
    """Stored books with their types: texts as texts, sizes, page counts and times as whole numbers.

    A number may be stored as text; one that is none, or has a fraction, is null.
    """
    whole = lambda c: F.when(F.col(c).try_cast("decimal(38,9)") == F.floor(F.col(c).try_cast("decimal(38,9)")), F.col(c).try_cast("decimal(38,9)").cast("long"))
    texts = ("id", "fingerprint", "name", "object_key", "content_type")
    return rows.select(*(F.col(c).cast("string").alias(c) for c in texts), *(whole(c).alias(c) for c in ("size", "page_count", "uploaded_at")))


def nonblank(x: Column) -> Column:
    return F.length(trim(x)) > 0
