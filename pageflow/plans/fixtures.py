"""Relations of the operators' shapes, derived from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import cache_key
from ..schemas import BLOCKS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_block(kind, text, marker="", trailing="", indent=0):
    lit = lambda x: x if not isinstance(x, (str, int)) else F.lit(x)
    return F.struct(lit(kind).alias("kind"), lit(text).alias("text"), lit(marker).alias("marker"), lit(trailing).alias("trailing"), F.lit("left").alias("align"), lit(indent).cast("int").alias("indent"), F.lit("none").alias("spaceBefore"), F.lit("md").alias("size"))


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of a conversation as a translated page; its role is the target language."""
    c = table(spark, sf_dir, "conversations")
    doc = F.concat(F.lit("doc-"), F.col("conv_id"))
    page = (F.col("turn") + 1).cast("int")
    key = cache_key(doc, page, F.lit("p"), F.lit("e"), F.lit("m"), F.lit("low"), F.col("role"))
    blocks = F.array(plain_block("paragraph", F.coalesce("text", F.lit(""))))
    return c.select(doc.alias("document_id"), page.alias("page"), key.alias("cache_key"), blocks.cast(BLOCKS).alias("blocks"), F.lit("").alias("markdown"), F.col("role").alias("source"), F.coalesce("text", F.lit("")).alias("text"))


#: The same in SQL, as common table expressions.
TRANSLATIONS_SQL = "t AS (SELECT 'doc-' || conv_id AS document_id, CAST(turn + 1 AS INTEGER) AS page, 'layout-v3::doc-' || conv_id || '::' || (turn + 1) || '::p::e::m::low::' || role AS cache_key, role AS source, coalesce(text, '') AS text FROM conversations)"


def overlapping_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of 50 words, each 6 words over the one before; one without text has no page."""
    return _pages(spark, sf_dir, lambda n: F.floor((n - 1) / 44).cast("int"), lambda i: i * 44 + 1, lambda i: F.lit(50))


def _pages(spark: SparkSession, sf_dir: str, last, first, size) -> DataFrame:
    """Pages 0 to last(number of words) of each document: `size` words from word `first` on (from 1)."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())

    def cut(x):
        return F.transform(F.sequence(F.lit(0), last(F.size(x))), lambda i: F.array_join(F.slice(x, first(i), size(i)), " "))

    # the list of words stays within the row: no page carries it
    pages = F.get(F.transform(F.array(F.split("text", " ")), cut), F.lit(0))
    d = d.select("doc_id", F.posexplode(pages).alias("i", "text"))
    return d.select(F.col("doc_id").cast("string").alias("document_id"), (F.col("i") + 1).alias("page"), "text")


def vanishing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in threes: 50 words; the last 6 of these alone; and 50 from there on.

    The middle one is all repetition, so it vanishes, and then the third one repeats nothing.
    """
    place = lambda i: F.floor(i / 3).cast("int") * 88 + F.when(i % 3 == 0, 1).otherwise(45)
    return _pages(spark, sf_dir, lambda n: F.floor((n - 1) / 88).cast("int") * 3 + F.when((n - 1) % 88 >= 44, 2).otherwise(0), place, lambda i: F.when(i % 3 == 1, 6).otherwise(50))


OVERLAPPING_SQL = """w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(i + 1 AS INTEGER) AS page, array_to_string(w[i * 44 + 1 : i * 44 + 50], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, CAST(floor((len(w) - 1) / 44) AS BIGINT) + 1)) AS i FROM w))"""

VANISHING_SQL = """w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 88 * 3 + CASE WHEN (len(w) - 1) % 88 >= 44 THEN 3 ELSE 1 END)) AS i FROM w),
p AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(i + 1 AS INTEGER) AS page, array_to_string(w[i // 3 * 88 + CASE WHEN i % 3 = 0 THEN 1 ELSE 45 END : i // 3 * 88 + CASE WHEN i % 3 = 0 THEN 50 WHEN i % 3 = 1 THEN 50 ELSE 94 END], ' ') AS text FROM i)"""


def stored_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as stored navigation pages; the entries are text, some of it broken or of another kind."""
    line = table(spark, sf_dir, "lineitem")
    page, q, v = F.col("l_linenumber") - 1, F.col("l_quantity").cast("long"), F.col("l_linenumber") + F.col("l_suppkey") % 5
    entry = F.to_json(F.array(F.struct(F.concat(F.lit("Part "), F.col("l_partkey") % 7).alias("title"), q.cast("string").alias("label"), q.alias("value"), F.lit("arabic").alias("numbering"))))
    kind = F.col("l_partkey") % 4
    listed = F.when(kind == 0, entry).when(kind == 1, '{"title":"no list"}').when(kind == 2, '[{"title":"broken"').otherwise("null")
    named = F.col("l_suppkey") % 3 != 0
    return line.select(
        F.col("l_orderkey").cast("string").alias("document_id"),
        page.cast("int").alias("pdf_page"),
        F.lit(1).alias("is_table_of_contents"),
        listed.alias("toc_entries"),
        F.when(named, v.cast("string")).alias("page_label"),
        F.when(named, v.cast("int")).alias("page_value"),
        F.when(named, F.lit("arabic")).alias("numbering"),
        F.col("l_orderkey").alias("updated_at"),
    )


NAVIGATION_SQL = """s0 AS (SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CAST(l_linenumber - 1 AS BIGINT) AS pdf_page, l_partkey % 4 = 0 AS listed, 'Part ' || l_partkey % 7 AS title, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_suppkey % 3 <> 0 THEN CAST(l_linenumber + l_suppkey % 5 AS BIGINT) END AS printed FROM lineitem WHERE l_linenumber > 1)"""


def toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as entries of a table of contents; the part's name is the title."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("document_id"),
        F.col("l_linenumber").cast("long").alias("source_page"),
        (F.col("l_linenumber") % 3).cast("int").alias("ordinal"),
        F.col("p_name").alias("title"),
        F.col("l_quantity").cast("long").cast("string").alias("label"),
        F.col("l_quantity").cast("long").alias("value"),
        F.when(F.col("l_returnflag") == "R", "roman").otherwise("arabic").alias("numbering"),
    )


ENTRIES_SQL = "e AS (SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CAST(l_linenumber AS BIGINT) AS source_page, CAST(l_linenumber % 3 AS INTEGER) AS ordinal, p_name AS title, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS label, CAST(l_quantity AS BIGINT) AS value, CASE WHEN l_returnflag = 'R' THEN 'roman' ELSE 'arabic' END AS numbering FROM lineitem JOIN part ON l_partkey = p_partkey)"


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed page numbers seen on pages: a supplier is a book."""
    line = table(spark, sf_dir, "lineitem")
    return line.select((F.col("l_partkey") % 200).cast("string").alias("document_id"), F.when(F.col("l_returnflag") == "R", "roman").otherwise("arabic").alias("numbering"), F.col("l_suppkey").cast("long").alias("pdf_page"), (F.col("l_suppkey") - F.col("l_suppkey") % 7 + F.col("l_linenumber")).cast("long").alias("value"))


ANCHORS_SQL = "a AS (SELECT CAST(l_partkey % 200 AS VARCHAR) AS document_id, CASE WHEN l_returnflag = 'R' THEN 'roman' ELSE 'arabic' END AS numbering, CAST(l_suppkey AS BIGINT) AS pdf_page, CAST(l_suppkey - l_suppkey % 7 + l_linenumber AS BIGINT) AS value FROM lineitem)"

#: The offset most anchors agree on, as one more expression after `a`.
OFFSETS_SQL = """o AS (SELECT document_id, numbering, pdf_page - value AS o FROM a),
m AS (SELECT document_id, numbering, quantile_disc(-o, 0.5) AS neg FROM o GROUP BY ALL),
n AS (SELECT document_id, numbering, o, count(*) AS n FROM o GROUP BY ALL),
f AS (SELECT document_id, numbering, o AS page_offset FROM (SELECT n.*, row_number() OVER (PARTITION BY n.document_id, n.numbering ORDER BY n.n DESC, abs(n.o + m.neg), n.o) AS r FROM n JOIN m USING (document_id, numbering)) WHERE r = 1)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("b"), F.col("doc_id")).alias("id"), F.sha2("text", 256).alias("fingerprint"), F.concat(F.lit("Book "), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".pdf")).alias("name"), (F.col("n_chars") * 977).alias("size"), F.col("doc_id").alias("uploaded_at"))


BOOKS_SQL = "b AS (SELECT 'b' || doc_id AS id, sha256(text) AS fingerprint, 'Book ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.pdf' END AS name, n_chars * 977 AS size, doc_id AS uploaded_at FROM documents)"


def upsert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("k"), F.col("user_id")).alias("cache_key"), F.col("event_type").alias("document_id"), (F.col("event_id") % 50 + 1).cast("int").alias("page"), F.get_json_object("props", "$.k").cast("long").alias("cache_version"), F.col("value").cast("string").alias("payload"), F.col("event_id").alias("updated_at"), F.col("event_id").alias("arrival"))


LOG_SQL = "l AS (SELECT 'k' || user_id AS cache_key, event_type AS document_id, CAST(event_id % 50 + 1 AS INTEGER) AS page, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS version, value, event_id FROM events)"
