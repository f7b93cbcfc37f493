"""Read-through translation: cached pages stay, missing ones go to a provider in bounded parallel."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim
from ..schemas import BLOCKS
from ..scratch import scratch
from .blocks import boundary_tail, is_blank, markdown, read_payload, read_response
from .boundary import reconcile, without_overlap
from .navigation import observe
from .store import cache_key, fold_into, upsert_navigation

# Parallel calls and images a call.
LEAST_CALLS, MOST_CALLS, USUAL_CALLS, IMAGES = 1, 6, 4, 3


class Provider(Protocol):
    """Turns a page's source text into a payload; it is shipped to the executors."""

    def translate(self, text: str, page: int, total: int, tail: str) -> dict: ...


class Echo:
    """The offline provider: each line of the source is a paragraph."""

    def translate(self, text: str, page: int, total: int, tail: str) -> dict:
        return {"page": page, "blocks": [{"kind": "paragraph", "text": x} for x in text.split("\n") if x.strip()], "cacheVersion": 1}


def parallel_calls(limit: float | None) -> int:
    """The number of calls at a time that a setting asks for."""
    if limit is None or limit != limit or limit in (float("inf"), float("-inf")):
        return USUAL_CALLS
    return int(min(MOST_CALLS, max(LEAST_CALLS, int(limit + 0.5))))


def prompt(page: Column, total: Column, language: Column, tail: Column) -> Column:
    """What a provider is told about a page."""
    head = F.concat(F.lit("Translate page "), page.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" into "), language, F.lit(" as layout blocks in JSON."))
    return F.when(F.length(tail) > 0, F.concat(head, F.lit(" The page before ends: "), tail)).otherwise(head)


def uses_responses(provider: Column, endpoint: Column) -> Column:
    """Whether an address takes the request with `input` (else the one with `messages`)."""
    return (provider == "openai") | F.endswith(endpoint, F.lit("/responses"))


def request_body(responses: Column, model: Column, effort: Column, instruction: Column, images: Column) -> Column:
    """The JSON of a request, in the wire shape that the address takes.

    `images` are array<struct<page, url>>; each one follows a line that names its page.  An
    effort of "none" is left out.
    """
    effort = F.when(effort != "none", effort)

    def content(text_kind, image):
        text = lambda x: F.struct(F.lit(text_kind).alias("type"), x.alias("text"))
        line = lambda x: F.concat(F.lit("Page "), x["page"].cast("string"), F.lit(":"))
        shown = F.flatten(F.transform(images, lambda x: F.array(F.to_json(text(line(x))), F.to_json(image(x)))))
        return F.concat(F.lit("["), F.array_join(F.concat(F.array(F.to_json(text(instruction))), shown), ","), F.lit("]"))

    def body(head, name, parts, tail):
        start = F.to_json(head)  # {"model":...}
        return F.concat(F.substring(start, F.lit(1), F.length(start) - 1), F.lit(f',"{name}":[{{"role":"user","content":'), parts, F.lit("}],"), F.lit(tail), F.lit("}"))

    new = body(
        F.struct(model.alias("model"), F.when(effort.isNotNull(), F.struct(effort.alias("effort"))).alias("reasoning")),
        "input",
        content("input_text", lambda x: F.struct(F.lit("input_image").alias("type"), x["url"].alias("image_url"), F.lit("high").alias("detail"))),
        '"text":{"format":{"type":"json_schema","name":"page_translation","strict":true}}',
    )
    chat = body(
        F.struct(model.alias("model"), effort.alias("reasoning_effort")),
        "messages",
        content("text", lambda x: F.struct(F.lit("image_url").alias("type"), F.struct(x["url"].alias("url"), F.lit("high").alias("detail")).alias("image_url"))),
        '"response_format":{"type":"json_object"}',
    )
    return F.when(responses, new).otherwise(chat)


def response_text(answer: Column) -> Column:
    """The text of either answer shape: a direct field, the first non-empty nested text, or the first choice."""
    nested = F.from_json(F.get_json_object(answer, "$.output"), "array<struct<content:array<struct<text:string>>>>")
    texts = F.flatten(F.transform(nested, lambda o: F.transform(F.coalesce(o["content"], F.array().cast("array<struct<text:string>>")), lambda c: c["text"])))
    first = F.try_element_at(F.filter(texts, lambda t: F.length(t) > 0), F.lit(1))
    filled = lambda x: F.when(F.length(x) > 0, x)
    return F.coalesce(filled(F.get_json_object(answer, "$.output_text")), first, filled(F.get_json_object(answer, "$.choices[0].message.content")))


def valid_request(key: Column, model: Column, images: Column) -> Column:
    return F.coalesce((F.length(trim(key)) > 0) & (F.length(trim(model)) > 0) & images.between(1, IMAGES), F.lit(False))


def with_tails(pages: DataFrame, translations: DataFrame) -> DataFrame:
    """Pages with `tail`: how the stored translation of the page before ends, or empty."""
    tails = translations.select("document_id", (F.col("page") + 1).cast("int").alias("page"), boundary_tail(read_payload(F.col("payload"))["blocks"]).alias("tail"))
    return pages.drop("tail").join(tails, ["document_id", "page"], "left").withColumn("tail", F.coalesce("tail", F.lit("")))


def translate_missing(pages: DataFrame, translations: DataFrame, provider: Provider, calls: float | None = None) -> DataFrame:
    """(document_id, page, payload) from the provider for pages without a translation; at most `calls` tasks call it.

    The limit is on tasks of the whole cluster, as a provider's limit is on its account.  Each
    of them is a queue: its pages are called in the order of documents and pages, one at a time.
    """
    missing = pages.join(translations.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [json.dumps(provider.translate(t or "", int(p), int(n), x or ""), ensure_ascii=False) for t, p, n, x in zip(b["text"], b["page"], b["total"], b["tail"], strict=True)]
            yield pd.DataFrame({"document_id": b["document_id"], "page": b["page"], "payload": out})

    own = missing.select("document_id", F.col("page").cast("int").alias("page"), "text", "total", "tail").repartition(parallel_calls(calls)).sortWithinPartitions("document_id", "page")
    return own.mapInPandas(call, "document_id string, page int, payload string")


def payload_json(page: Column, blocks: Column, removed: Column, revised: Column, version: Column) -> Column:
    """A translation as it is stored; the marks of a revision and of a removal stand only where they hold."""
    mark = lambda x: F.when(x, F.lit(True))
    return F.to_json(
        F.struct(
            page.alias("page"), markdown(blocks).alias("markdown"), blocks.alias("blocks"), is_blank(blocks).alias("isBlank"),
            mark(revised).alias("revised"), mark(removed != "").alias("boundaryDeduplicated"), version.alias("cacheVersion"),
        )
    )


@dataclass(frozen=True)
class Batch:
    """What one read-through gives: pages to show, and rows for the stores.

    `writes` are upserts of translations (cache_key, document_id, page, payload, cache_version,
    arrival); `observations` are rows for the navigation store (document_id, observation, arrival);
    `shown` has each page's blocks and source before they are reduced.
    """

    shown: DataFrame
    writes: DataFrame
    observations: DataFrame

    @cached_property
    def pages(self) -> DataFrame:
        """All pages, reduced through the whole document, with `source`; worked out once, and only if asked for."""
        return reconcile(self.shown, ("source",))

    def translations_after(self, stored: DataFrame) -> DataFrame:
        """The stored translations with the writes folded in, by version."""
        return fold_into(stored, self.writes, value=("payload",))

    def navigation_after(self) -> DataFrame:
        """The navigation pages that the observations leave."""
        return upsert_navigation(self.observations)


def translate_batch(pages: DataFrame, translations: DataFrame, provider: Provider, calls: float | None = None, settings: tuple[str, ...] = (), now_ms: int = 0) -> Batch:
    """Serve pages from the stored translations and the rest from the provider, which is called once a page.

    `pages` has document_id, page, text and total, `translations` document_id, page and payload
    with these settings.  The answers are written to the shared folder before anything reads
    them, so none of their readers (pages, writes, observations) calls again; a lost task calls
    anew for its own pages only.  A page hears how the stored page before it ends, and its
    answer may revise that page.  A page is reduced against its revision of the page before,
    else against the stored one; a stored page that loses something by that is written back
    with its own version.  The version of an answer and of its revision is the time in
    microseconds and its page, so of two writes of a page the later page's holds.
    """
    spark = pages.sparkSession
    asked = pages.withColumn("document_id", F.col("document_id").cast("string")).withColumn("page", F.col("page").cast("int"))
    stored = translations.select(F.col("document_id").cast("string").alias("document_id"), F.col("page").cast("int").alias("page"), "payload")
    where = scratch(spark, "answers")
    translate_missing(with_tails(asked, stored), stored, provider, calls).write.parquet(where)
    made = spark.read.schema("document_id string, page int, payload string").parquet(where)

    answer = made.select("document_id", "page", read_response(F.col("payload"), F.col("page")).alias("a"))
    r = F.col("a.previousPageRevision")
    revision = F.when((r["page"] == F.col("page") - 1) & (F.size(r["blocks"]) > 0), r["blocks"])
    answer = answer.select("document_id", "page", F.col("a.blocks").alias("blocks"), revision.alias("revision"), F.lit("api").alias("source"), F.lit(None).cast("long").alias("stored_version"))
    read = stored.select("document_id", "page", read_payload(F.col("payload")).alias("p"))
    read = read.select("document_id", "page", F.col("p.blocks").alias("blocks"), F.lit(None).cast(BLOCKS).alias("revision"), F.lit("cache").alias("source"), F.col("p.cacheVersion").alias("stored_version"))
    before = read.select("document_id", (F.col("page") + 1).alias("page"), F.col("blocks").alias("before"))
    met = answer.unionByName(read).join(before, ["document_id", "page"], "left")
    met = met.withColumn("cut", without_overlap(F.coalesce("revision", "before"), F.col("blocks")))

    version = F.lit(now_ms * 1000).cast("long") + F.col("page")
    key = lambda page: cache_key(F.col("document_id"), page, *map(F.lit, settings))
    own, gone, back = F.col("cut.blocks"), F.col("cut.removed"), F.col("page") - 1
    kept = F.coalesce("stored_version", version)
    rows = F.array(
        F.when(F.col("stored_version").isNull() | (gone != ""), F.struct(key(F.col("page")).alias("cache_key"), F.col("page").alias("page"), payload_json(F.col("page"), own, gone, F.lit(False), kept).alias("payload"), kept.alias("cache_version"))),
        F.when(F.col("revision").isNotNull(), F.struct(key(back).alias("cache_key"), back.alias("page"), payload_json(back, F.col("revision"), F.lit(""), F.lit(True), version).alias("payload"), version.alias("cache_version"))),
    )
    writes = met.select("document_id", version.alias("arrival"), F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("w")).select("w.cache_key", "document_id", "w.page", "w.payload", "w.cache_version", "arrival")
    seen = F.array(observe(own, F.col("page")), F.when(F.col("revision").isNotNull(), observe(F.col("revision"), back)))
    observations = met.select("document_id", F.explode(F.filter(seen, lambda x: x.isNotNull())).alias("observation"), version.alias("arrival"))

    revised = met.filter("revision IS NOT NULL").select("document_id", back.alias("page"), F.col("revision").alias("revised"))
    shown = answer.unionByName(read).select("document_id", "page", "blocks", "source").join(revised, ["document_id", "page"], "left")
    shown = shown.select("document_id", "page", F.coalesce("revised", "blocks").alias("blocks"), F.when(F.col("revised").isNotNull(), "api").otherwise(F.col("source")).alias("source"))
    return Batch(shown, writes, observations)


def read_through(pages: DataFrame, translations: DataFrame, provider: Provider, calls: float | None = None) -> DataFrame:
    """All pages' reduced blocks: from the table where it has them, else from the provider; `source` says which."""
    return translate_batch(pages, translations, provider, calls).pages
