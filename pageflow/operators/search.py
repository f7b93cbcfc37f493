"""Keyword search over translated pages, with snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, snippet, trim
from .blocks import _field, _text, block_of, search_text

# Candidates that the first filter passes on, results, and the query's length.
CANDIDATES, RESULTS, LONGEST_QUERY, LONGEST_SUFFIX = 250, 100, 200, 1800


def contains(text: Column, query: str, ascii_only: bool = False) -> Column:
    fold = ascii_lower if ascii_only else F.lower
    return F.contains(fold(F.coalesce(text, F.lit(""))), fold(F.lit(query)))


def block_contains(blocks: Column, query: str, ascii_only: bool = False) -> Column:
    """Whether a single block holds the query."""
    return F.exists(blocks, lambda b: contains(b["text"], query, ascii_only))


def _checked(query: str, suffix: str | None) -> str:
    wanted = query.strip()
    if not wanted or len(query) > LONGEST_QUERY:
        raise ValueError("a query has 1 to 200 characters")
    if suffix is not None and len(suffix) > LONGEST_SUFFIX:
        raise ValueError("the settings suffix is too long")
    return wanted


def search_request_valid(document: Column, query: Column, suffix: Column) -> Column:
    """Whether a search request is one: a document id of 1 to 128 characters, a query of 1 to 200, a suffix of at most 1800."""
    asked = F.length(trim(query)).between(1, LONGEST_QUERY) & (F.length(query) <= LONGEST_QUERY)
    return F.coalesce(F.length(document).between(1, 128) & asked & (F.length(F.coalesce(suffix, F.lit(""))) <= LONGEST_SUFFIX), F.lit(False))


def search_each(pages: DataFrame, query: str, suffix: str | None = None, candidates: int = CANDIDATES, results: int = RESULTS) -> DataFrame:
    """(document_id, page, snippet): the search of every document on its own, with both caps in each.

    The first filter folds A-Z alone and passes a document's first `candidates` pages; the
    second one folds all letters.  Rows of one page go in the order of their keys.  Both ranks
    are by document, so a plan keeps at most so many rows of each before it shuffles.
    """
    wanted = _checked(query, suffix)
    df = pages
    if suffix is not None:
        df = df.filter(F.endswith("cache_key", F.lit(f"::{suffix}")))
    df = df.filter(contains(F.col("markdown"), wanted, True) | block_contains(F.col("blocks"), wanted, True))
    return _ranked(df, wanted, candidates, results)


def _ranked(df: DataFrame, wanted: str, candidates: int, results: int) -> DataFrame:
    """Snippets of the first candidates of each document that the second filter leaves, the first results of them."""
    order = W.partitionBy("document_id").orderBy("page", "cache_key")
    first = df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= candidates)
    found = first.select("document_id", "page", "cache_key", snippet(search_text(F.col("blocks"), F.col("markdown")), wanted).alias("snippet")).filter("snippet <> ''")
    found = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= results)
    return found.select("document_id", "page", "snippet")


def payload_blocks(translations: DataFrame) -> DataFrame:
    """(document_id, page, cache_key, ordinal, block): the blocks of stored payloads, a row each.

    A lateral join with the elements of `$.blocks`, where that is a list; text, numbers and
    objects in its place, and payloads that are no JSON, have no blocks.  Elements that are no
    blocks come with the defaults.
    """
    parsed = translations.select("document_id", "page", "cache_key", F.try_variant_get(F.try_parse_json("payload"), "$.blocks", "variant").alias("_b"))
    listed = parsed.withColumn("_b", F.when(F.schema_of_variant("_b").startswith("ARRAY"), F.col("_b")))
    rows = translations.sparkSession.sql("SELECT t.document_id, t.page, t.cache_key, e.pos AS ordinal, e.value AS _v FROM {t} t, LATERAL variant_explode(t._b) e", t=listed)
    return rows.withColumn("block", block_of(F.col("_v"))).drop("_v")


def search_payloads(translations: DataFrame, query: str, suffix: str | None = None, candidates: int = CANDIDATES, results: int = RESULTS) -> DataFrame:
    """`search_each` over stored payloads: document_id, page, cache_key and the JSON text `payload`.

    The first filter looks at the markdown and at each block's text alone, numbers as they are
    written; the second one at the text a page shows, where only texts count.  A payload that is
    no JSON, or whose blocks are no list, costs its own row at most.
    """
    wanted = _checked(query, suffix)
    df = translations
    if suffix is not None:
        df = df.filter(F.endswith("cache_key", F.lit(f"::{suffix}")))
    df = df.select("document_id", "page", "cache_key", F.try_parse_json("payload").alias("_v"))
    df = df.select("document_id", "page", "cache_key", "_v", F.coalesce(F.try_variant_get("_v", "$.blocks", "array<variant>"), F.array().cast("array<variant>")).alias("_b"))
    near = contains(F.try_variant_get("_v", "$.markdown", "string"), wanted, True) | F.exists("_b", lambda b: contains(F.try_variant_get(b, "$.text", "string"), wanted, True))
    shown = df.filter(near).select("document_id", "page", "cache_key", F.transform("_b", block_of).alias("blocks"), _text(_field(F.col("_v"), "markdown")).alias("markdown"))
    return _ranked(shown, wanted, candidates, results)


def search(pages: DataFrame, document: str | None, query: str, suffix: str | None = None, ascii_only: bool = True, candidates: int = CANDIDATES, results: int = RESULTS) -> DataFrame:
    """(document_id, page, snippet) of pages that hold the query, in the order of pages.

    The first filter looks at the markdown or each block alone and passes the first
    `candidates` pages; the second looks at the page's search text.  Both caps are the
    feature.  Expects document_id, page, cache_key, blocks, markdown.
    """
    wanted = _checked(query, suffix)
    if document is not None and not 1 <= len(document) <= 128:
        raise ValueError("a document id has 1 to 128 characters")
    df = pages
    if document is not None:
        df = df.filter(F.col("document_id") == document)
    if suffix is not None:
        df = df.filter(F.endswith("cache_key", F.lit(f"::{suffix}")))
    df = df.filter(contains(F.col("markdown"), wanted, ascii_only) | block_contains(F.col("blocks"), wanted, ascii_only))
    first = df.orderBy("document_id", "page", "cache_key").limit(candidates)
    found = first.select("document_id", "page", "cache_key", snippet(search_text(F.col("blocks"), F.col("markdown")), wanted).alias("snippet"))
    return found.filter("snippet <> ''").orderBy("document_id", "page", "cache_key").limit(results).drop("cache_key")
