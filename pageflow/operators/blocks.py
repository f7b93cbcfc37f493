"""Layout blocks: type-exact reading of JSON, and what is derived from a page's blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import bind as _bind
from ..functions.text import clamp, one_of, round_half_up, trim, trim_end
from ..schemas import ALIGNMENTS, BLOCKS, KINDS, SIZES, SPACES


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(v: Column) -> Column:
    """A string value; anything else, numbers too, is null."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    return F.when(_kind(v).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))


def _integer(v: Column) -> Column:
    """A number without a fraction, below 2**53 in size."""
    return _bind(_number(v), lambda n: F.when((n == F.floor(n)) & (F.abs(n) < 9007199254740992), n.cast("long")))


def _boolean(v: Column) -> Column:
    return F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def block_of(v: Column) -> Column:
    """One block; wrong types fall back to the defaults."""
    given = _field(v, "kind")
    kind = _text(F.when(_kind(given) == "VOID", _field(v, "type")).otherwise(given))
    indent = F.coalesce(round_half_up(_number(_field(v, "indent"))), F.lit(0))
    word = lambda name: F.coalesce(_text(_field(v, name)), F.lit(""))
    return F.struct(
        one_of(kind, KINDS, "paragraph").alias("kind"),
        word("text").alias("text"),
        word("marker").alias("marker"),
        word("trailing").alias("trailing"),
        one_of(_text(_field(v, "align")), ALIGNMENTS, "left").alias("align"),
        clamp(indent, 0, 3).cast("int").alias("indent"),
        one_of(_text(_field(v, "spaceBefore")), SPACES, "none").alias("spaceBefore"),
        one_of(_text(_field(v, "size")), SIZES, "md").alias("size"),
    )


def read_blocks(json: Column) -> Column:
    """Blocks of a JSON array; what is no array gives none."""
    own = F.when(F.regexp_like(json, F.lit(r"\A\s*\[")), json)
    return F.coalesce(F.transform(F.from_json(own, "array<variant>"), block_of), F.array().cast(BLOCKS))


def read_payload(json: Column) -> Column:
    """struct(blocks, isBlank, markdown, cacheVersion, rest) of a translation payload; `rest` keeps every key."""
    v = F.try_parse_json(json)
    blocks = read_blocks(F.get_json_object(json, "$.blocks"))
    return F.struct(
        blocks.alias("blocks"),
        F.coalesce(_boolean(_field(v, "isBlank")), is_blank(blocks)).alias("isBlank"),
        F.coalesce(_text(_field(v, "markdown")), F.lit("")).alias("markdown"),
        F.coalesce(_integer(_field(v, "cacheVersion")), F.lit(0)).alias("cacheVersion"),
        v.alias("rest"),
    )


def read_response(json: Column, page: Column) -> Column:
    """A model's answer: its page and blocks and, if given, its revision of the page before."""
    v = F.try_parse_json(json)
    blocks = read_blocks(F.get_json_object(json, "$.blocks"))
    revision = read_blocks(F.get_json_object(json, "$.previousPageRevision.blocks"))
    there = _kind(_field(v, "previousPageRevision")).startswith("OBJECT")
    return F.struct(
        F.coalesce(_integer(_field(v, "page")), page.cast("long")).alias("page"),
        blocks.alias("blocks"),
        is_blank(blocks).alias("isBlank"),
        F.when(there, F.struct(F.coalesce(_integer(F.try_variant_get(v, "$.previousPageRevision.page", "variant")), page.cast("long") - 1).alias("page"), revision.alias("blocks"), is_blank(revision).alias("isBlank"))).alias("previousPageRevision"),
    )


def live(b: Column) -> Column:
    return (b["kind"] != "spacer") & (F.length(trim(b["text"])) > 0)


def is_blank(blocks: Column) -> Column:
    return ~F.exists(blocks, live)


def markdown(blocks: Column) -> Column:
    """Non-empty texts with a blank line between."""
    return F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t != ""), "\n\n")


def search_text(blocks: Column, md: Column) -> Column:
    """Block texts a line each, else the markdown."""
    lines = F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t != ""), "\n")
    return F.when(lines != "", lines).otherwise(trim(F.coalesce(md, F.lit(""))))


def display_texts(blocks: Column, md: Column) -> Column:
    """Texts in the order they appear on screen."""

    def own(b):
        item = F.array(b["marker"], b["text"], b["trailing"])
        return F.when(b["kind"] == "spacer", F.array().cast("array<string>")).when(b["kind"] == "list_item", item).otherwise(F.array(b["text"]))

    return F.when(F.size(blocks) > 0, F.flatten(F.transform(blocks, own))).otherwise(F.split(md, "\n{2,}"))


def boundary_tail(blocks: Column, most: int = 160) -> Column:
    """The end of the last paragraph or caption that has text."""
    own = F.filter(blocks, lambda b: b["kind"].isin("paragraph", "caption") & (F.length(trim(b["text"])) > 0))
    return F.coalesce(F.right(trim_end(F.try_element_at(own, F.lit(-1))["text"]), F.lit(most)), F.lit(""))


def block_rows(df, blocks: str = "blocks"):
    """One row a block with its ordinal."""
    return df.select("*", F.posexplode(blocks).alias("ordinal", "block")).drop(blocks)
