"""Queries over tables of contents, page numbers and offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import navigation as N
from ..operators import store as D
from . import fixtures as X

LABELS = ("xvii", "IX", "iix", "mix", "12", "0", "a-1", " 7 ", "1234567")
LABELS_SQL = "(VALUES (0, 'xvii', 17, 'roman'), (1, 'IX', 9, 'roman'), (2, 'iix', 8, 'roman'), (3, 'mix', 1009, 'roman'), (4, '12', 12, 'arabic'), (5, '0', 0, 'arabic'), (6, 'a-1', NULL, 'other'), (7, '7', 7, 'arabic'), (8, '1234567', NULL, 'other')) AS v(i, label, value, numbering)"


def _label(i):
    return F.element_at(F.array(*map(F.lit, LABELS)), (i + 1).cast("int"))


def page_ref_parse(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.page_reference(_label(F.col("o_orderkey") % 9)).alias("r")).select("o_orderkey", "r.label", "r.value", "r.numbering")


page_ref_parse.sql = f"SELECT o_orderkey, label, CAST(value AS BIGINT) AS value, numbering FROM orders JOIN {LABELS_SQL} ON o_orderkey % 9 = i"


def toc_pages(spark, sf_dir):
    """Observations of pages made of order lines, with a heading on every second one."""
    line, part = X.table(spark, sf_dir, "lineitem"), X.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    # lines are gathered as they are; blocks are made of them once they stand together
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name")))
    pages = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(lines.alias("items"))
    item = lambda x: X.plain_block("list_item", x["p_name"], marker=F.concat(x["l_linenumber"].cast("string"), F.lit(" /")), trailing=(x["l_partkey"] % 4).cast("string"), indent=x["l_linenumber"] % 5)
    heading = X.plain_block(F.when(F.col("l_orderkey") % 2 == 0, "heading").otherwise("caption"), "Table of  Contents")
    number = X.plain_block("page_number", _label(F.col("l_orderkey") % 9))
    blocks = F.concat(F.array(heading), F.transform("items", item), F.array(number))
    o = pages.select("l_orderkey", N.observe(blocks, F.col("l_orderkey")).alias("o"))
    return o.select("l_orderkey", F.col("o.isTableOfContents").alias("is_toc"), F.size("o.tocEntries").alias("n_entries"), F.array_join(F.transform("o.tocEntries", lambda e: e["title"]), "|").alias("titles"), F.coalesce(F.aggregate("o.tocEntries", F.lit(0), lambda a, e: a + e["level"]), F.lit(0)).alias("levels"), F.col("o.anchor.value").alias("printed"))


toc_pages.sql = f"""WITH c AS (SELECT l_orderkey, count(*) FILTER (l_partkey % 4 <> 0) AS n, coalesce(string_agg(l_linenumber || ' / ' || p_name, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_partkey % 4 <> 0), '') AS titles, coalesce(sum(least(3, l_linenumber % 5)) FILTER (l_partkey % 4 <> 0), 0) AS levels FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
d AS (SELECT *, n >= 4 OR (n >= 2 AND l_orderkey % 2 = 0) AS toc FROM c)
SELECT l_orderkey, toc AS is_toc, CAST(CASE WHEN toc THEN n ELSE 0 END AS INTEGER) AS n_entries, CASE WHEN toc THEN titles ELSE '' END AS titles, CAST(CASE WHEN toc THEN levels ELSE 0 END AS INTEGER) AS levels, CAST(value AS BIGINT) AS printed FROM d JOIN {LABELS_SQL} ON l_orderkey % 9 = i"""


def observation_normalize(spark, sf_dir):
    """Loosely typed JSON: wrong kinds fall back, nameless entries go."""
    p = X.table(spark, sf_dir, "part")
    entry = F.struct(F.concat(F.lit("  "), F.col("p_name")).alias("title"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.col("p_size").cast("string")).alias("label"), (F.col("p_size") - 5).alias("value"), F.lit("weird").alias("numbering"), F.col("p_size").alias("level"))
    json = F.to_json(F.struct(F.col("p_partkey").alias("pdfPage"), F.lit(1).alias("isTableOfContents"), F.array(entry).alias("tocEntries"), F.struct(F.lit("iv").alias("label"), F.lit(4).alias("value"), F.lit("roman").alias("numbering")).alias("anchor")))
    o = p.select("p_partkey", N.read_observation(json).alias("o"))
    e = F.try_element_at("o.tocEntries", F.lit(1))
    return o.select("p_partkey", F.col("o.isTableOfContents").alias("is_toc"), e["title"].alias("title"), e["label"].alias("label"), e["value"].alias("value"), e["numbering"].alias("numbering"), e["level"].alias("level"), F.col("o.anchor.numbering").alias("anchor"))


observation_normalize.sql = "SELECT p_partkey, p_partkey % 3 <> 0 AS is_toc, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS VARCHAR) END AS label, CASE WHEN p_partkey % 3 <> 0 AND p_size >= 5 THEN CAST(p_size - 5 AS BIGINT) END AS value, CASE WHEN p_partkey % 3 <> 0 THEN 'other' END AS numbering, CASE WHEN p_partkey % 3 <> 0 THEN CAST(least(3, p_size) AS INTEGER) END AS level, 'roman' AS anchor FROM part"


def toc_dedupe(spark, sf_dir):
    return N.collect_entries(X.toc_entries(spark, sf_dir).withColumn("document_id", F.col("value").cast("string"))).select("document_id", "source_page", "ordinal", "title", "numbering")


toc_dedupe.sql = f"WITH {X.ENTRIES_SQL} SELECT CAST(value AS VARCHAR) AS document_id, source_page, ordinal, title, numbering FROM (SELECT *, row_number() OVER (PARTITION BY value, lower(title), numbering ORDER BY source_page, ordinal, title) AS r FROM e) WHERE r = 1"


def page_offset_mode(spark, sf_dir):
    return N.page_offsets(X.anchors(spark, sf_dir))


page_offset_mode.sql = f"WITH {X.ANCHORS_SQL}, {X.OFFSETS_SQL} SELECT document_id, numbering, page_offset FROM f"


def _settings(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    settings = o.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("document_id"), (F.col("o_custkey") % 50 - 25).alias("manual_offset"))
    return settings, o.select(F.col("o_orderkey").cast("string").alias("document_id"), (F.col("o_orderkey") % 300).alias("total_pages"))


SETTINGS_SQL = "s AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id, o_custkey % 50 - 25 AS manual_offset FROM orders WHERE o_orderkey % 5 = 0), g AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id, o_orderkey % 300 AS total_pages FROM orders)"


def toc_resolved(spark, sf_dir):
    settings, pages = _settings(spark, sf_dir)
    r = N.resolve(X.toc_entries(spark, sf_dir), N.page_offsets(X.anchors(spark, sf_dir)), settings, pages)
    return r.select("document_id", "source_page", "title", "target_page", "used_offset", "calibrated")


toc_resolved.sql = f"WITH {X.ENTRIES_SQL}, {X.ANCHORS_SQL}, {X.OFFSETS_SQL}, {SETTINGS_SQL} SELECT e.document_id, source_page, title, CASE WHEN total_pages >= 1 THEN greatest(1, least(total_pages, value + coalesce(manual_offset, page_offset, 0))) END AS target_page, CASE WHEN total_pages >= 1 THEN coalesce(manual_offset, page_offset, 0) END AS used_offset, CASE WHEN total_pages >= 1 THEN coalesce(manual_offset, page_offset) IS NOT NULL END AS calibrated FROM e LEFT JOIN f USING (document_id, numbering) LEFT JOIN s ON s.document_id = e.document_id LEFT JOIN g ON g.document_id = e.document_id"


def effective_offset(spark, sf_dir):
    settings, _ = _settings(spark, sf_dir)
    return N.effective_offset(X.toc_entries(spark, sf_dir), N.page_offsets(X.anchors(spark, sf_dir)), settings)


effective_offset.sql = f"WITH {X.ENTRIES_SQL}, {X.ANCHORS_SQL}, {X.OFFSETS_SQL}, {SETTINGS_SQL}, p AS (SELECT document_id, CASE WHEN bool_or(numbering = 'arabic') THEN 'arabic' ELSE min(numbering) END AS numbering FROM e GROUP BY 1) SELECT p.document_id, p.numbering, coalesce(manual_offset, page_offset, 0) AS effective_offset FROM p LEFT JOIN f ON f.document_id = p.document_id AND f.numbering = p.numbering LEFT JOIN s ON s.document_id = p.document_id"


def navigation_list(spark, sf_dir):
    settings, _ = _settings(spark, sf_dir)
    pages = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), (F.col("l_linenumber") - 1).alias("pdf_page"), "l_partkey")
    return D.navigation_of(pages, settings).select("document_id", "pdf_page", "l_partkey", "manual_offset")


navigation_list.sql = f"WITH {SETTINGS_SQL} SELECT l.document_id, pdf_page, l_partkey, manual_offset FROM (SELECT CAST(l_orderkey AS VARCHAR) AS document_id, l_linenumber - 1 AS pdf_page, l_partkey FROM lineitem) l LEFT JOIN s ON s.document_id = l.document_id WHERE pdf_page > 0"


def contents_panel(spark, sf_dir):
    """From stored pages to resolved contents."""
    settings, pages = _settings(spark, sf_dir)
    r = N.contents_panel(X.stored_navigation(spark, sf_dir), settings, pages)
    return r.select("document_id", "source_page", "title", "label", "target_page", "used_offset", "calibrated")


contents_panel.sql = f"""WITH {X.NAVIGATION_SQL}, a AS (SELECT document_id, 'arabic' AS numbering, pdf_page, printed AS value FROM s0 WHERE printed IS NOT NULL), {X.OFFSETS_SQL}, {SETTINGS_SQL},
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, title, q ORDER BY pdf_page) AS r FROM s0 WHERE listed) WHERE r = 1)
SELECT e.document_id, pdf_page AS source_page, title, CAST(q AS VARCHAR) AS label, CASE WHEN total_pages >= 1 THEN greatest(1, least(total_pages, q + coalesce(manual_offset, page_offset, 0))) END AS target_page, CASE WHEN total_pages >= 1 THEN coalesce(manual_offset, page_offset, 0) END AS used_offset, CASE WHEN total_pages >= 1 THEN coalesce(manual_offset, page_offset) IS NOT NULL END AS calibrated
FROM e LEFT JOIN f ON f.document_id = e.document_id LEFT JOIN s ON s.document_id = e.document_id LEFT JOIN g ON g.document_id = e.document_id"""


def contents_active(spark, sf_dir):
    """Contents with the entries that lead to the page each document is open at."""
    settings, pages = _settings(spark, sf_dir)
    readers = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), (F.col("o_custkey") % 12 + 1).alias("current"))
    r = N.contents_panel(X.stored_navigation(spark, sf_dir), settings, pages, readers)
    return r.select("document_id", "source_page", "title", "label", "target_page", "active")


contents_active.sql = f"SELECT document_id, source_page, title, label, target_page, coalesce(target_page = o_custkey % 12 + 1, false) AS active FROM ({contents_panel.sql}) c LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = document_id"


def stored_pages(spark, sf_dir):
    """Observations as read back from stored text, broken text among it."""
    o = N.stored_observations(X.stored_navigation(spark, sf_dir))
    e = F.try_element_at("observation.tocEntries", F.lit(1))
    return o.select("document_id", F.col("observation.pdfPage").alias("page"), F.col("observation.isTableOfContents").alias("is_toc"), e["title"].alias("title"), e["sourcePage"].alias("source_page"), F.col("observation.anchor.value").alias("printed"))


stored_pages.sql = f"WITH {X.NAVIGATION_SQL} SELECT document_id, pdf_page AS page, listed AS is_toc, CASE WHEN listed THEN title END AS title, CASE WHEN listed THEN pdf_page END AS source_page, printed FROM s0"


def page_anchors(spark, sf_dir):
    return N.anchors_of(N.stored_observations(X.stored_navigation(spark, sf_dir)))


page_anchors.sql = f"WITH {X.NAVIGATION_SQL} SELECT document_id, pdf_page, CAST(printed AS VARCHAR) AS label, printed AS value, 'arabic' AS numbering FROM s0 WHERE printed IS NOT NULL"


def navigation_upsert(spark, sf_dir):
    """Observations are written as they arrive; the last of a page stays, oversized ones are refused."""
    line = X.table(spark, sf_dir, "lineitem")
    entry = F.struct(F.col("l_linenumber").cast("long").alias("sourcePage"), F.lit(0).alias("ordinal"), F.when(F.col("l_partkey") % 50 == 0, F.repeat(F.lit("x"), 262_000)).otherwise("t").alias("title"), F.lit("1").alias("label"), F.col("l_quantity").cast("long").alias("value"), F.lit("arabic").alias("numbering"), F.lit(0).alias("level"))
    o = F.struct((F.col("l_suppkey") % 10).cast("long").alias("pdfPage"), F.lit(True).alias("isTableOfContents"), F.when(F.col("l_partkey") % 50 == 0, F.array(entry, entry)).otherwise(F.array(entry)).alias("tocEntries"), F.lit(None).cast("struct<label:string,value:bigint,numbering:string>").alias("anchor"))
    log = line.select((F.col("l_orderkey") % 500).cast("string").alias("document_id"), o.alias("observation"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")).alias("arrival"))
    r = D.upsert_navigation(log)
    return r.select("document_id", "pdf_page", F.get_json_object("toc_entries", "$[0].value").cast("long").alias("value"), "arrival")


navigation_upsert.sql = """SELECT document_id, pdf_page, value, arrival FROM (SELECT *, row_number() OVER (PARTITION BY document_id, pdf_page ORDER BY arrival DESC) AS r FROM (SELECT CAST(l_orderkey % 500 AS VARCHAR) AS document_id, CAST(l_suppkey % 10 AS INTEGER) AS pdf_page, CAST(l_quantity AS BIGINT) AS value, l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS arrival, l_partkey FROM lineitem) WHERE pdf_page >= 1 AND l_partkey % 50 <> 0) WHERE r = 1"""


def page_sources(spark, sf_dir):
    """Pages from the cache's index and from calls in this session; calls win."""
    line = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), "l_partkey", "l_suppkey")
    calls = line.filter("l_partkey % 3 = 0").select("document_id", "page", F.when(F.col("l_suppkey") % 2 == 0, "api").otherwise("cache").alias("source"))
    return N.merge_sources(line.filter("l_partkey % 2 = 0").select("document_id", "page"), calls)


page_sources.sql = "SELECT l_orderkey AS document_id, l_linenumber AS page, CASE WHEN bool_or(l_partkey % 3 = 0 AND l_suppkey % 2 = 0) THEN 'api' ELSE 'cache' END AS source FROM lineitem WHERE l_partkey % 2 = 0 OR (l_partkey % 3 = 0 AND l_suppkey % 2 = 0) GROUP BY ALL"


def nav_merge_priority(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return N.merge_observations(e.filter("event_id % 2 = 0"), e.filter("event_id % 3 = 0"), ["user_id", "event_type"], "event_id")


nav_merge_priority.sql = "SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY side DESC, event_id DESC) AS r FROM (SELECT user_id, event_type, value, event_id, 0 AS side FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, value, event_id, 1 FROM events WHERE event_id % 3 = 0)) WHERE r = 1"


def list_items(spark, sf_dir):
    """List items of raw pages as contents candidates."""
    p = X.table(spark, sf_dir, "pages")
    items = F.regexp_extract_all("html", F.lit("<li>([^<]*)</li>"), F.lit(1))
    return p.select("page_id", F.size(items).alias("n_items"), F.array_join(F.transform(items, T.trim), "|").alias("items"))


list_items.sql = f"SELECT page_id, CAST(len(x) AS INTEGER) AS n_items, array_to_string(list_transform(x, lambda y: regexp_replace(regexp_replace(y, '^{T.WHITE}+', ''), '{T.WHITE}+$', '')), '|') AS items FROM (SELECT page_id, regexp_extract_all(html, '<li>([^<]*)</li>', 1) AS x FROM pages)"

QUERIES = [page_ref_parse, toc_pages, observation_normalize, toc_dedupe, page_offset_mode, toc_resolved, effective_offset, navigation_list, contents_panel, contents_active, stored_pages, page_anchors, navigation_upsert, page_sources, nav_merge_priority, list_items]
