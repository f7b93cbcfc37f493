"""Text that a page repeats from the end of the page before it."""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bind import bind as _bind
from ..functions.text import CJK, CLOSING, LETTER, SOLID, TERMINAL, WHITE, trim_end, trim_start
from ..scratch import scratch
from .blocks import is_blank, markdown

#: The longest repetition that is looked for, in code points (a fixed value).
LONGEST = 120


def _start(x: Column) -> Column:
    """`trim_start`, with a look at the first letter before a pattern goes over all of them."""
    return _bind(x, lambda y: F.when(F.substring(y, 1, 1).rlike(WHITE), trim_start(y)).otherwise(y))


def _end(x: Column) -> Column:
    return _bind(x, lambda y: F.when(F.right(y, F.lit(1)).rlike(WHITE), trim_end(y)).otherwise(y))


def _finished(x: Column) -> Column:
    """Whether a text ends in a mark that ends a sentence, closing marks after it allowed."""
    return F.right(x, F.lit(1)).rlike(CLOSING) & x.rlike(TERMINAL)


def _meaningful(before: Column, after: Column, n: Column) -> Column:
    own = F.substring(after, F.lit(1), n)
    letters = F.length(F.regexp_replace(own, r"[^\p{L}\p{N}]", ""))
    outside = F.when(F.length(before) > n, F.substring(before, F.length(before) - n, F.lit(1))).otherwise("")
    following = F.substring(after, n + 1, F.lit(1))
    cuts_start = outside.rlike(LETTER) & F.substring(own, 1, 1).rlike(LETTER)
    cuts_end = F.right(own, F.lit(1)).rlike(LETTER) & following.rlike(LETTER)
    return F.when(own.rlike(CJK), letters >= 2).otherwise((letters >= 8) & ~cuts_start & ~cuts_end)


def _ends(before: Column, after: Column) -> Column:
    """The ends of `before` that `after` starts with, longest first; only where its first two letters stand can one begin."""
    tail = F.right(before, F.lit(LONGEST))
    start = F.regexp_replace(F.substring(after, 1, 2), r"([^\p{L}\p{N}])", r"\\$1")
    cut = F.split(tail, F.concat(F.lit("(?="), start, F.lit(")")), -1)

    def whole(pieces):
        ends = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), ""))
        return F.filter(ends, lambda end: F.startswith(after, end))

    return F.when((F.length(tail) > 0) & (F.length(after) > 0), _bind(cut, whole)).otherwise(F.array().cast("array<string>"))


def overlap(previous: Column, current: Column) -> Column:
    """The longest end of `previous` that `current` starts with and that means something; else empty.

    Both are trimmed where they meet.  A finished sentence repeats nothing.
    """

    def longest(p):
        before, after = p["before"], p["after"]
        found = F.filter(_ends(before, after), lambda end: _meaningful(before, after, F.length(end)))
        return F.when(_finished(before), "").otherwise(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")))

    met = _bind(F.struct(_end(previous).alias("before"), _start(current).alias("after")), longest)
    return F.when(previous.isNull() | current.isNull(), "").otherwise(met)


def _carries(b: Column) -> Column:
    return b["kind"].isin("paragraph", "caption") & b["text"].rlike(SOLID)


def _first_carrying(blocks: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(blocks, lambda b, i: F.when(_carries(b), i)), lambda i: i.isNotNull()), F.lit(1))


def without(current: Column, removed: Column) -> Column:
    """The blocks without `removed` at the start of the first one that carries text; one left empty by it goes."""

    def cut(at):
        rest = lambda b: trim_start(F.substring(trim_start(b["text"]), F.length(removed) + 1, F.length(b["text"])))
        less = F.transform(current, lambda b, i: F.when(i == at, b.withField("text", rest(b))).otherwise(b))
        return F.filter(less, lambda b, i: (i != at) | (b["text"] != "") | (b["marker"] != "") | (b["trailing"] != ""))

    return F.when(removed != "", _bind(_first_carrying(current), cut)).otherwise(current)


def without_overlap(previous: Column, current: Column) -> Column:
    """struct(blocks, removed): the current blocks without what they repeat."""
    last = F.try_element_at(F.filter(previous, _carries), F.lit(-1))
    first = F.try_element_at(F.filter(current, _carries), F.lit(1))

    def compare(q):
        same = F.coalesce(q["last"]["kind"] == q["first"]["kind"], F.lit(False))
        return F.when(same, overlap(q["last"]["text"], q["first"]["text"])).otherwise("")

    removed = _bind(F.struct(last.alias("last"), first.alias("first")), compare)
    return _bind(removed, lambda r: F.struct(without(current, r).alias("blocks"), r.alias("removed")))


def exact_previous(df: DataFrame, value: str, by: str = "document_id", page: str = "page") -> Column:
    """A column's value on the page numbered one less; null where that page is missing."""
    return F.first(value).over(W.partitionBy(by).orderBy(page).rangeBetween(-1, -1))


def islands(df: DataFrame, by: str = "document_id", page: str = "page") -> DataFrame:
    """Add `island`: pages of a document without a gap share it."""
    return df.withColumn("island", F.col(page) - F.row_number().over(W.partitionBy(by).orderBy(page)))


#: Pages of a document that a task sees together.
STRETCH = 4096


def _seen(blocks: Column) -> Column:
    """What of a page its neighbours see: its first and last text, and whether it is settled.

    A page is settled if what it repeats itself cannot change what the next one repeats: it has
    no text; or several blocks with text, of which only the first is ever cut; or so long a text
    that its end stays, whatever is cut; or one that stays a finished sentence.  Of the first text the start
    is enough then, and the whole where a page is not settled, which is short but for white space.
    """

    def of(own):
        first, last = F.try_element_at(own, F.lit(1)), F.try_element_at(own, F.lit(-1))
        ends = F.struct(_start(first["text"]).alias("start"), _end(last["text"]).alias("end"))
        return _bind(ends, lambda e: shown(own, first["kind"], last["kind"], e["start"], e["end"]))

    def shown(own, first_kind, last_kind, start, end):
        rest = _start(F.substring(_start(end), F.lit(LONGEST + 1), F.length(end)))
        settled = F.when(F.size(own) == 1, _bind(rest, lambda r: (F.length(r) > LONGEST) | _finished(r))).otherwise(F.lit(True))
        tail = F.when(_finished(end), "").otherwise(F.right(end, F.lit(LONGEST + 1)))
        text = lambda done: F.when(done, F.left(start, F.lit(LONGEST + 1))).otherwise(start)
        told = lambda done: F.struct(first_kind.alias("first_kind"), text(done).alias("first_text"), last_kind.alias("last_kind"), tail.alias("tail"), done.alias("settled"))
        return _bind(settled, told)

    return _bind(F.filter(blocks, _carries), of)


def _beside(pages: DataFrame) -> DataFrame:
    """Pages with `_own`, what they show, and `_before`, what the page numbered one less shows, or null.

    Documents are dealt by stretches of pages; the last page of a stretch is sent to the next
    one too, to be seen there.  So a document of any length is dealt over tasks.
    """
    b = F.floor(F.col("page") / STRETCH)
    twice = F.pmod(F.col("page"), F.lit(STRETCH)) == STRETCH - 1
    sent = pages.withColumn("_stretch", F.explode(F.when(twice, F.array(b, b + 1)).otherwise(F.array(b))))
    sent = sent.repartition("document_id", "_stretch").withColumn("_own", _seen(F.col("blocks")))  # the text goes out once, and nothing beside it
    before = F.lag(F.struct("page", "_own")).over(W.partitionBy("document_id", "_stretch").orderBy("page"))
    met = sent.withColumn("_lag", before).filter(F.col("_stretch") == b)
    return met.withColumn("_before", F.when(F.col("_lag.page") == F.col("page") - 1, F.col("_lag._own"))).drop("_lag", "_stretch")


def _with_removed(met: DataFrame) -> DataFrame:
    """Add `_removed`, right wherever the page before is settled or missing, and `_waits` for the others."""
    o, p = F.col("_own"), F.col("_before")
    same = F.coalesce(p["last_kind"] == o["first_kind"], F.lit(False))
    waits = F.coalesce(~p["settled"], F.lit(False))
    return met.withColumn("_waits", waits).withColumn("_removed", F.when(~waits & same, overlap(p["tail"], o["first_text"])).otherwise(""))


def repeated(before: str, after: str) -> str:
    """`overlap` of two texts, for the pages that have to be taken one by one."""
    before, after = _END.sub("", before), _START.sub("", after)
    if not _FINISHED.search(before):
        for n in range(min(LONGEST, len(before), len(after)), 0, -1):
            own = after[:n]
            if before.endswith(own):
                letters = len(_LETTERS.findall(own))
                cuts_start = _LETTERS.fullmatch(before[-n - 1 : -n]) and _LETTERS.fullmatch(own[0])
                cuts_end = _LETTERS.fullmatch(own[-1]) and _LETTERS.fullmatch(after[n : n + 1])
                if letters >= 2 if _WIDE.search(own) else letters >= 8 and not cuts_start and not cuts_end:
                    return own
    return ""


_SPACE = regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WHITE)
_START, _END = regex.compile(rf"\A{_SPACE}+"), regex.compile(rf"{_SPACE}+\Z")
_FINISHED, _LETTERS, _WIDE = regex.compile(TERMINAL.replace(r"\z", r"\Z")), regex.compile(LETTER), regex.compile(CJK.replace("Is", ""))


def _in_turn(met: DataFrame) -> DataFrame:
    """(document_id, page, _late): what pages remove whose predecessor is not settled.

    These runs of short pages are streams: sorted by page, of which a task holds one text at a time.
    """
    rows = met.filter("_waits OR NOT _settled").select("document_id", F.col("page").cast("long").alias("page"), "_waits", "_removed", "_kind", "_text", "_settled")
    rows = rows.repartition("document_id").sortWithinPartitions("document_id", "page")

    def fold(batches):
        import pyarrow as pa

        at, kept, kept_kind = None, None, None
        for b in batches:
            out = []
            for document, page, waits, removed, kind, text, settled in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if waits:
                    removed = repeated(kept, text) if at == (document, page - 1) and kept is not None and text is not None and kind == kept_kind else ""
                    out.append((document, page, removed))
                at, kept = (document, page), None
                if not settled:
                    left = _START.sub("", _START.sub("", text)[len(removed) :]) if removed else text
                    kept, kept_kind = left if _START.sub("", left) else None, kind
            names = ("document_id", "page", "_late")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=names)

    return rows.mapInArrow(fold, "document_id string, page long, _late string")


def reconcile(pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove repetitions through whole documents, page by page: each page meets the one before as already reduced.

    Takes (document_id, page, blocks), one row a page; returns them with removed, markdown,
    is_blank and boundary_deduplicated, and the columns of `carry`.  Most pages are settled, so
    their successors are compared at once, wherever they lie; only runs of pages that are not,
    each a single short text, are taken in turn.  Pages are written to the shared folder once
    they have met, so both ways read them and the text is shuffled once.
    """
    own = pages.select(F.col("document_id").cast("string").alias("document_id"), F.col("page").cast("int").alias("page"), "blocks", *carry)
    o = F.col("_own")
    short = F.col("_waits") | ~o["settled"]
    met = _with_removed(_beside(own)).select(*own.columns, "_waits", "_removed", o["settled"].alias("_settled"), F.when(short, o["first_kind"]).alias("_kind"), F.when(short, o["first_text"]).alias("_text"))
    where = scratch(pages.sparkSession, "pages")
    met.write.option("compression", "zstd").parquet(where)
    met = pages.sparkSession.read.schema(met.schema).parquet(where)
    at_once = met.filter("NOT _waits").withColumn("removed", F.col("_removed"))
    in_turn = met.filter("_waits").join(_in_turn(met), ["document_id", "page"]).withColumn("removed", F.col("_late"))
    both = at_once.select(*own.columns, "removed").unionByName(in_turn.select(*own.columns, "removed"))
    cut = both.select("document_id", "page", without(F.col("blocks"), F.col("removed")).alias("blocks"), "removed", *carry)
    return cut.select("document_id", "page", "blocks", "removed", markdown(F.col("blocks")).alias("markdown"), is_blank(F.col("blocks")).alias("is_blank"), (F.col("removed") != "").alias("boundary_deduplicated"), *carry)
