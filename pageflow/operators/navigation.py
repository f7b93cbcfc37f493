"""Tables of contents: what a page shows, what a document collects, and where entries lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bind import bind as _bind
from ..functions.text import TOC_HEADING, clamp, one_of, page_reference, trim
from ..schemas import ANCHOR, NUMBERINGS, TOC_ENTRY
from .blocks import _boolean, _integer, _kind, _text

# Caps on what one page may bring.
MOST_ENTRIES, TITLE_LENGTH, LABEL_LENGTH = 200, 500, 40


def entry_title(b: Column) -> Column:
    parts = F.filter(F.array(trim(b["marker"]), trim(b["text"])), lambda x: x != "")
    return F.array_join(parts, " ")


def observe(blocks: Column, pdf_page: Column) -> Column:
    """A page's observation: list items that end in a page number, and the page's own printed number.

    Two candidates make a table of contents under a heading that says so, four without.
    """

    def candidate(b, i):
        listed = (b["kind"] == "list_item") & (trim(b["text"]) != "")
        return F.when(listed, _bind(page_reference(b["trailing"]), lambda ref: numbered(b, i, ref)))

    def numbered(b, i, ref):
        entry = F.struct(pdf_page.cast("long").alias("sourcePage"), i.alias("ordinal"), entry_title(b).alias("title"), ref["label"].alias("label"), ref["value"].alias("value"), ref["numbering"].alias("numbering"), clamp(b["indent"], 0, 3).alias("level"))
        return F.when(F.coalesce(ref["value"], F.lit(0)) != 0, entry)

    found = F.filter(F.transform(blocks, candidate), lambda e: e.isNotNull())
    return _bind(found, lambda entries: _observed(blocks, pdf_page, entries))


def _observed(blocks: Column, pdf_page: Column, entries: Column) -> Column:
    heading = F.exists(blocks, lambda b: b["kind"].isin("heading", "paragraph") & b["text"].rlike(TOC_HEADING))
    toc = (F.size(entries) >= 4) | ((F.size(entries) >= 2) & heading)
    printed = F.filter(F.transform(F.filter(blocks, lambda b: b["kind"] == "page_number"), lambda b: page_reference(b["text"])), lambda r: r["value"].isNotNull())

    def told(found):
        first = found["first"]
        anchor = F.when(first.isNotNull(), F.struct(pdf_page.cast("long").alias("pdfPage"), first["label"].alias("label"), first["value"].alias("value"), first["numbering"].alias("numbering")))
        return F.struct(pdf_page.cast("long").alias("pdfPage"), found["toc"].alias("isTableOfContents"), F.when(found["toc"], entries).otherwise(F.array().cast(f"array<{TOC_ENTRY}>")).alias("tocEntries"), anchor.alias("anchor"))

    return _bind(F.struct(toc.alias("toc"), F.try_element_at(printed, F.lit(1)).alias("first")), told)


def stored_observations(pages: DataFrame) -> DataFrame:
    """document_id and observation of stored navigation pages.

    The entries are JSON text; what is broken or no list counts as empty.  Pages below 1 go.
    """
    listed = pages.filter("pdf_page > 0").withColumn("_raw", F.try_variant_get(F.try_parse_json("toc_entries"), "$", "array<variant>"))
    page, label = F.col("pdf_page").cast("long"), F.when(F.length("page_label") > 0, F.col("page_label"))
    read = listed.withColumn("_entries", _entries(F.col("_raw"), page))
    observation = _observation(page, F.col("is_table_of_contents").cast("boolean"), F.col("_entries"), _label(label), _page(F.col("page_value")), F.col("numbering"))
    return read.select("document_id", observation.alias("observation"))


def anchors_of(observations: DataFrame) -> DataFrame:
    """(document_id, pdf_page, label, value, numbering) of every page that shows its printed number."""
    found = observations.select("document_id", F.col("observation.anchor").alias("a")).filter("a IS NOT NULL")  # the entries are not read for it
    return found.select("document_id", F.col("a.pdfPage").alias("pdf_page"), "a.label", "a.value", "a.numbering")


def entries_of(observations: DataFrame) -> DataFrame:
    """The entries of all observations, a row each."""
    rows = observations.select("document_id", F.col("observation.tocEntries").alias("es"))
    rows = rows.select("document_id", F.explode_outer("es").alias("e")).filter("e IS NOT NULL")  # of explode, Spark makes a filter that reads all entries once more
    return rows.select("document_id", F.col("e.sourcePage").alias("source_page"), "e.ordinal", "e.title", "e.label", "e.value", "e.numbering", "e.level")


def contents_panel(pages: DataFrame, settings: DataFrame, totals: DataFrame, readers: DataFrame | None = None) -> DataFrame:
    """A document's contents from its stored pages: the distinct entries and where each leads.

    With `readers` (document_id, current; a row a document) entries are `active` that lead to the page in view.
    """
    observations = stored_observations(pages)
    found = resolve(collect_entries(entries_of(observations)), page_offsets(anchors_of(observations)), settings, totals)
    if readers is None:
        return found
    met = found.join(readers.select("document_id", F.col("current").alias("_current")), "document_id", "left")
    return met.withColumn("active", F.coalesce(F.col("target_page") == F.col("_current"), F.lit(False))).drop("_current")


def _page(n: Column) -> Column:
    """A page's number: whole, from 0 on."""
    d = n.cast("double")
    return F.when((d == F.floor(d)) & (d >= 0) & (d < 9007199254740992), n.cast("long"))


def _page_value(v: Column) -> Column:
    return _bind(_integer(v), lambda n: F.when(n >= 0, n))


def _truth(v: Column) -> Column:
    """What a loosely typed value counts as."""
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce(_boolean(v), F.when(_kind(v) == "STRING", F.length(_text(v)) > 0).when(_kind(v) == "VOID", False).when(_kind(v).rlike("^(OBJECT|ARRAY)"), True).otherwise(F.coalesce(number != 0, F.lit(False))))


def _fields(v: Column, *names: str) -> Column:
    """The named fields of an object, each as it is; null for what is no object."""
    return F.try_variant_get(v, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")


def _entries(raw: Column, page: Column) -> Column:
    """The entries of a list of loosely typed ones; those without title or label go."""

    def entry(e, i):
        return _bind(_fields(e, "sourcePage", "ordinal", "title", "label", "value", "numbering", "level"), lambda f: read(f, i))

    def read(f, i):
        word = lambda n, most: F.substring(trim(F.coalesce(_text(f[n]), F.lit(""))), 1, most)
        return F.struct(
            F.coalesce(_integer(f["sourcePage"]), page).alias("sourcePage"),
            F.coalesce(_integer(f["ordinal"]), i).cast("int").alias("ordinal"),
            word("title", TITLE_LENGTH).alias("title"),
            word("label", LABEL_LENGTH).alias("label"),
            _page_value(f["value"]).alias("value"),
            _bind(_text(f["numbering"]), lambda x: one_of(x, NUMBERINGS, "other")).alias("numbering"),
            clamp(F.coalesce(_integer(f["level"]), F.lit(0)), 0, 3).cast("int").alias("level"),
        )

    found = F.filter(F.transform(F.slice(raw, 1, MOST_ENTRIES), entry), lambda e: (e["title"] != "") & (e["label"] != ""))
    return F.coalesce(found, F.array().cast(f"array<{TOC_ENTRY}>"))


def _label(text: Column) -> Column:
    return F.substring(trim(F.coalesce(text, F.lit(""))), 1, LABEL_LENGTH)


def _observation(page: Column, listed: Column, entries: Column, label: Column, value: Column, numbering: Column) -> Column:
    anchor = F.when(label != "", F.struct(page.alias("pdfPage"), label.alias("label"), value.alias("value"), one_of(numbering, NUMBERINGS, "other").alias("numbering")))
    return F.struct(page.alias("pdfPage"), (F.coalesce(listed, F.lit(False)) & (F.size(entries) > 0)).alias("isTableOfContents"), entries.alias("tocEntries"), anchor.cast(ANCHOR).alias("anchor"))


def read_observation(json: Column) -> Column:
    """An observation from JSON: capped, type-exact, entries without title or label dropped.

    The text is parsed once; lists and entries are taken from what was parsed.
    """

    def of(f):
        page = F.coalesce(_integer(f["pdfPage"]), F.lit(0).cast("long"))
        raw = F.try_variant_get(f["tocEntries"], "$", "array<variant>")
        parts = F.struct(page.alias("page"), _truth(f["isTableOfContents"]).alias("listed"), _fields(f["anchor"], "label", "value", "numbering").alias("anchor"))
        return _bind(parts, lambda p: _bind(_entries(raw, p["page"]), lambda entries: read(p, entries)))

    def read(p, entries):
        a = p["anchor"]
        return _bind(F.struct(_label(_text(a["label"])).alias("label"), _text(a["numbering"]).alias("numbering")), lambda t: _observation(p["page"], p["listed"], entries, t["label"], _page_value(a["value"]), t["numbering"]))

    return _bind(_fields(F.try_parse_json(json), "pdfPage", "isTableOfContents", "tocEntries", "anchor"), of)


def collect_entries(entries: DataFrame) -> DataFrame:
    """The first entry of each title, numbering and value of a document, in the order of pages."""
    same = [F.col("document_id"), F.lower("title"), F.col("numbering"), F.coalesce(F.col("value").cast("string"), F.col("label"))]
    order = W.partitionBy(*same).orderBy("source_page", "ordinal", "title")
    return entries.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def page_offsets(anchors: DataFrame) -> DataFrame:
    """(document_id, numbering, page_offset): the offset that most anchors agree on.

    Ties go to the one nearest to the upper median, then to the smaller one.  Both levels
    aggregate before they shuffle.
    """
    offsets = anchors.filter(F.col("value").isNotNull()).select("document_id", "numbering", (F.col("pdf_page") - F.col("value")).alias("o"))
    counts = offsets.groupBy("document_id", "numbering", "o").agg(F.count(F.lit(1)).alias("n"))
    # of the counts' running sums from above, the first to pass half belongs to the upper median
    key = W.partitionBy("document_id", "numbering")
    above = F.sum("n").over(key.orderBy(F.desc("o")))
    total = F.sum("n").over(key)
    marked = counts.withColumn("above", above).withColumn("total", total)
    median = F.max(F.when(F.col("above") * 2 >= F.col("total"), F.col("o"))).over(key)
    best = marked.withColumn("median", median)
    score = F.struct(F.col("n"), -F.abs(F.col("o") - F.col("median")), -F.col("o"))
    return best.groupBy("document_id", "numbering").agg(F.max_by("o", score).alias("page_offset"))


def resolve(entries: DataFrame, offsets: DataFrame, settings: DataFrame, pages: DataFrame) -> DataFrame:
    """Where each entry leads: its value shifted by the manual offset, else the automatic one, inside the document.

    `settings` (document_id, manual_offset) and `pages` (document_id, total_pages) have a row a document at most.
    """
    df = entries.join(offsets, ["document_id", "numbering"], "left").join(settings, "document_id", "left").join(pages, "document_id", "left")
    offset = F.coalesce("manual_offset", "page_offset", F.lit(0))
    fits = F.col("value").isNotNull() & (F.col("total_pages") >= 1)
    page = F.greatest(F.lit(1), F.least(F.col("total_pages"), F.col("value") + offset))
    return df.withColumns({"target_page": F.when(fits, page), "used_offset": F.when(fits, offset), "calibrated": F.when(fits, F.coalesce("manual_offset", "page_offset").isNotNull())})


def effective_offset(entries: DataFrame, offsets: DataFrame, settings: DataFrame) -> DataFrame:
    """A document's primary numbering (arabic if any entry has it, else its first entry's) and offset."""
    first = F.min_by("numbering", F.struct("source_page", "ordinal"))
    primary = entries.groupBy("document_id").agg(F.when(F.max((F.col("numbering") == "arabic").cast("int")) == 1, "arabic").otherwise(first).alias("numbering"))
    df = primary.join(offsets, ["document_id", "numbering"], "left").join(settings, "document_id", "left")
    return df.select("document_id", "numbering", F.coalesce("manual_offset", "page_offset", F.lit(0)).alias("effective_offset"))


def merge_observations(remote: DataFrame, local: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both; where both have a key, the local row.  Within a side the latest by `order` wins."""
    both = remote.withColumn("_side", F.lit(0)).unionByName(local.withColumn("_side", F.lit(1)))
    newest = W.partitionBy(*key).orderBy(F.desc("_side"), F.desc(order))
    return both.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_side")


def merge_sources(indexed: DataFrame, known: DataFrame) -> DataFrame:
    """(document_id, page, source): the pages of a fresh index as `cache`, and over them those known to come from a call (`api`)."""
    calls = known.filter("source = 'api'").select("document_id", "page", F.lit(1).alias("_api"))
    both = indexed.select("document_id", "page", F.lit(0).alias("_api")).unionByName(calls)
    return both.groupBy("document_id", "page").agg(F.when(F.max("_api") == 1, "api").otherwise("cache").alias("source"))
