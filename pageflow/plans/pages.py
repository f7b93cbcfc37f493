"""Queries over neighbouring pages, the viewport and translation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import boundary as Y
from ..operators import store as D
from ..operators import translate as P
from ..operators import viewport as V
from . import fixtures as X

#: Of q (a: the page before, z: the page, both trimmed where they meet), the length of what z repeats.
REPEATED = r"""CASE WHEN a IS NULL OR regexp_matches(a, '[.!?。！？][”’"''\)\]}】》」』]*$') THEN NULL ELSE list_filter(range(least(120, length(a), length(z)), 0, -1), lambda n: ends_with(a, substr(z, 1, n)) AND length(regexp_replace(substr(z, 1, n), '[^\p{L}\p{N}]', '', 'g')) >= 8
 AND NOT (regexp_matches(CASE WHEN length(a) > n THEN substr(a, length(a) - n, 1) ELSE '' END, '[\p{L}\p{N}]') AND regexp_matches(substr(z, 1, 1), '[\p{L}\p{N}]'))
 AND NOT (regexp_matches(substr(z, n, 1), '[\p{L}\p{N}]') AND regexp_matches(substr(z, n + 1, 1), '[\p{L}\p{N}]')))[1] END"""
PAIRS = f"""{X.OVERLAPPING_SQL},
q AS (SELECT c.document_id, c.page, regexp_replace(b.text, '{T.WHITE}+$', '') AS a, regexp_replace(c.text, '^{T.WHITE}+', '') AS z, c.text FROM p c LEFT JOIN p b ON b.document_id = c.document_id AND b.page = c.page - 1),
n AS (SELECT *, {REPEATED} AS k FROM q)"""


def boundary_overlap(spark, sf_dir):
    p = X.overlapping_pages(spark, sf_dir)
    df = p.withColumn("removed", Y.overlap(Y.exact_previous(p, "text"), F.col("text")))
    return df.filter("removed <> ''").select("document_id", "page", "removed")


boundary_overlap.sql = f"WITH {PAIRS} SELECT document_id, page, substr(z, 1, k) AS removed FROM n WHERE k IS NOT NULL"


#: Letters as signs of a script without word spaces.
SIGNS = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"


def boundary_signs(spark, sf_dir):
    """Repetitions of pages in which letters are signs: two of them mean something, and words have no edges."""
    p = X.overlapping_pages(spark, sf_dir).withColumn("text", F.translate("text", T.LOWER, SIGNS))
    df = p.withColumn("removed", Y.overlap(Y.exact_previous(p, "text"), F.col("text")))
    return df.filter("removed <> ''").select("document_id", "page", "removed")


boundary_signs.sql = rf"""WITH {X.OVERLAPPING_SQL}, t AS (SELECT document_id, page, translate(text, '{T.LOWER}', '{SIGNS}') AS text FROM p),
q AS (SELECT c.document_id, c.page, regexp_replace(b.text, '{T.WHITE}+$', '') AS a, regexp_replace(c.text, '^{T.WHITE}+', '') AS z FROM t c LEFT JOIN t b ON b.document_id = c.document_id AND b.page = c.page - 1),
e AS (SELECT *, list_filter(range(least(120, length(a), length(z)), 0, -1), lambda n: ends_with(a, substr(z, 1, n))) AS ends FROM q WHERE a IS NOT NULL AND NOT regexp_matches(a, '[.!?。！？][”’"''\)\]}}】》」』]*$')),
n AS (SELECT *, list_filter(ends, lambda n: CASE WHEN regexp_matches(substr(z, 1, n), '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}]') THEN length(regexp_replace(substr(z, 1, n), '[^\p{{L}}\p{{N}}]', '', 'g')) >= 2
 ELSE length(regexp_replace(substr(z, 1, n), '[^\p{{L}}\p{{N}}]', '', 'g')) >= 8 AND NOT (regexp_matches(CASE WHEN length(a) > n THEN substr(a, length(a) - n, 1) ELSE '' END, '[\p{{L}}\p{{N}}]') AND regexp_matches(substr(z, 1, 1), '[\p{{L}}\p{{N}}]'))
 AND NOT (regexp_matches(substr(z, n, 1), '[\p{{L}}\p{{N}}]') AND regexp_matches(substr(z, n + 1, 1), '[\p{{L}}\p{{N}}]')) END)[1] AS k FROM e)
SELECT document_id, page, substr(z, 1, k) AS removed FROM n WHERE k IS NOT NULL"""


def boundary_chain(spark, sf_dir):
    p = X.overlapping_pages(spark, sf_dir)
    r = Y.reconcile(p.select("document_id", "page", F.array(X.plain_block("paragraph", F.col("text"))).alias("blocks")))
    return r.select("document_id", "page", "removed", "markdown", "boundary_deduplicated")


#: Page after page of p, each against what is left of the one before.
FOLDED = f"""r AS (SELECT document_id, page, text, '' AS removed FROM p WHERE page = 1
UNION ALL SELECT document_id, page, CASE WHEN k IS NULL THEN text ELSE regexp_replace(substr(z, k + 1), '^{T.WHITE}+', '') END, coalesce(substr(z, 1, k), '')
FROM (SELECT *, {REPEATED} AS k FROM (SELECT c.document_id, c.page, c.text, regexp_replace(r.text, '{T.WHITE}+$', '') AS a, regexp_replace(c.text, '^{T.WHITE}+', '') AS z FROM r JOIN p c ON c.document_id = r.document_id AND c.page = r.page + 1) q) n)
SELECT document_id, page, removed, text AS markdown"""
boundary_chain.sql = f"WITH RECURSIVE {X.OVERLAPPING_SQL}, {FOLDED}, removed <> '' AS boundary_deduplicated FROM r"


def boundary_fold(spark, sf_dir):
    """The same where pages in the middle vanish: a page meets what is left of the one before."""
    p = X.vanishing_pages(spark, sf_dir)
    r = Y.reconcile(p.select("document_id", "page", F.array(X.plain_block("paragraph", F.col("text"))).alias("blocks")))
    return r.select("document_id", "page", "removed", "markdown", "is_blank")


boundary_fold.sql = f"WITH RECURSIVE {X.VANISHING_SQL}, {FOLDED}, regexp_replace(text, '{T.WHITE}+', '', 'g') = '' AS is_blank FROM r"


def boundary_tail(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return d.select("doc_id", B.boundary_tail(F.array(X.plain_block("paragraph", F.coalesce("text", F.lit(""))), X.plain_block("spacer", "x"))).alias("tail"))


boundary_tail.sql = f"SELECT doc_id, right(regexp_replace(coalesce(text, ''), '{T.WHITE}+$', ''), 160) AS tail FROM documents"


def _turns(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def _gapped(spark, sf_dir):
    """Turns with gaps, which are what the queries over it are about."""
    return _turns(spark, sf_dir).filter("(document_id + page - 1) % 5 <> 0")


GAPPED = "c AS (SELECT conv_id AS document_id, turn + 1 AS page, coalesce(text, '') AS text FROM conversations WHERE (conv_id + turn) % 5 <> 0)"
TURNS = "c AS (SELECT conv_id AS document_id, turn + 1 AS page, coalesce(text, '') AS text FROM conversations)"


def exact_previous_page(spark, sf_dir):
    c = _gapped(spark, sf_dir)
    return c.select("document_id", "page", F.length(Y.exact_previous(c, "text")).alias("before"))


exact_previous_page.sql = f"WITH {GAPPED} SELECT c.document_id, c.page, CAST(length(b.text) AS INTEGER) AS before FROM c LEFT JOIN c b ON b.document_id = c.document_id AND b.page = c.page - 1"


def page_islands(spark, sf_dir):
    return Y.islands(_gapped(spark, sf_dir)).groupBy("document_id", "island").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).drop("island")


page_islands.sql = f"WITH {GAPPED} SELECT document_id, min(page) AS first, count(*) AS n FROM (SELECT *, page - row_number() OVER (PARTITION BY document_id ORDER BY page) AS i FROM c) GROUP BY document_id, i"


def context_window(spark, sf_dir):
    c = _gapped(spark, sf_dir)
    return c.select("document_id", "page", F.array_join(V.context_pages(c), ",").alias("context"))


context_window.sql = f"WITH {GAPPED} SELECT a.document_id, a.page, string_agg(b.page, ',' ORDER BY b.page) AS context FROM c a JOIN c b ON b.document_id = a.document_id AND abs(b.page - a.page) <= 1 GROUP BY ALL"


def _readers(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 12 + 1).alias("current"), (F.col("o_orderkey") % 10).alias("total"), (F.col("o_custkey") % 4 / 1.5).alias("nearby"))


READERS = "r AS (SELECT o_orderkey AS document_id, o_custkey % 12 + 1 AS current, o_orderkey % 10 AS total, greatest(1, floor(o_custkey % 4 / 1.5)) AS radius FROM orders)"


def prefetch_plan(spark, sf_dir):
    line = X.table(spark, sf_dir, "lineitem")
    return V.prefetch_plan(_readers(spark, sf_dir), line.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page")))


prefetch_plan.sql = f"WITH {READERS}, x AS (SELECT document_id, current, unnest(range(CAST(greatest(1, current - radius) AS BIGINT), CAST(least(total, current + radius) AS BIGINT) + 1)) AS page FROM r) SELECT x.document_id, page, 250 + abs(page - current) * 250 AS delay_ms, EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey = x.document_id AND l_linenumber = page) AS cache_only FROM x"


def viewport_predicates(spark, sf_dir):
    r = _readers(spark, sf_dir)
    flag = lambda k: F.col("document_id") % k == 0
    return r.select("document_id", V.work_enabled(F.lit(3), F.col("current"), F.col("nearby"), flag(2)).alias("enabled"), V.should_start(flag(7), flag(2), flag(3), flag(5), flag(4)).alias("start"), V.progress(F.col("current"), F.lit(12)).alias("progress"), V.render_delay(F.lit(3), F.col("current")).alias("render_ms"))


viewport_predicates.sql = f"WITH {READERS} SELECT document_id, document_id % 2 = 0 AND abs(3 - current) <= radius AS enabled, document_id % 7 <> 0 AND (document_id % 3 = 0 OR document_id % 2 <> 0) AND (document_id % 3 = 0 OR document_id % 5 = 0 OR document_id % 4 = 0) AS start, CAST(floor(current * 100 / 12 + 0.5) AS BIGINT) AS progress, abs(3 - current) * 180 AS render_ms FROM r"


def page_status(spark, sf_dir):
    line = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("page"), "l_returnflag", "l_linestatus", "l_partkey")
    sources = line.filter("l_returnflag <> 'N'").select("document_id", "page", F.when(F.col("l_returnflag") == "R", "cache").otherwise("api").alias("source")).groupBy("document_id", "page").agg(F.max("source").alias("source"))
    return V.page_status(_readers(spark, sf_dir).select("document_id", "total"), sources, line.filter("l_partkey % 3 = 0"), line.filter("l_linestatus = 'O'"))


page_status.sql = f"WITH {READERS}, x AS (SELECT document_id, unnest(range(1, total + 1)) AS page FROM r), l AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS c, bool_or(l_partkey % 3 = 0) AS w, bool_or(l_returnflag = 'A') AS a, bool_or(l_linestatus = 'O') AS t FROM lineitem GROUP BY ALL) SELECT x.document_id, page, CASE WHEN c THEN 'cache' WHEN w THEN 'loading' WHEN a THEN 'api' WHEN t THEN 'present' END AS status FROM x LEFT JOIN l ON l_orderkey = x.document_id AND l_linenumber = page"


def char_prefix_sum(spark, sf_dir):
    c = _turns(spark, sf_dir)
    n = F.length("text")
    return c.select("document_id", "page", V.running_lengths("document_id", "page", n).alias("before"), F.sum(n).over(W.partitionBy("document_id")).alias("total"))


char_prefix_sum.sql = f"WITH {TURNS} SELECT document_id, page, CAST(coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(length(text)) OVER (PARTITION BY document_id) AS BIGINT) AS total FROM c"


def typewriter_reveal(spark, sf_dir):
    c = _turns(spark, sf_dir)
    n, ms = F.length("text"), F.col("page") * 300
    shown = T.revealed(ms, n, F.lit(80))
    p = T.reveal_parts(F.col("text"), F.lit(5), shown)
    return c.select("document_id", "page", T.reveal_duration(n, F.lit(80)).alias("duration"), shown.alias("shown"), p["stable"].alias("stable"), p["tail"].alias("tail"), F.length(p["pending"]).alias("pending"))


typewriter_reveal.sql = f"WITH {TURNS}, x AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE least(length(text), CAST(floor(page * 300 * 80 / 1000) AS BIGINT)) END AS shown FROM c), y AS (SELECT *, least(length(text), greatest(0, shown - 5)) AS k FROM x), z AS (SELECT *, CASE WHEN k < length(text) THEN least(5, k) ELSE 0 END AS t FROM y) SELECT document_id, page, length(text) / 80 * 1000 AS duration, CAST(shown AS BIGINT) AS shown, substr(text, 1, k - t) AS stable, substr(text, k - t + 1, t) AS tail, CAST(length(text) - k AS INTEGER) AS pending FROM z"


def accept_language(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    header = F.concat(F.lit("fr-FR, zh-CN;q=0."), (F.col("event_id") % 10).cast("string"), F.lit(" ,en-US; q=0."), (F.col("user_id") % 10).cast("string"))
    saved = F.when(F.col("event_id") % 9 == 0, "zh-CN").when(F.col("event_id") % 9 == 1, "de")
    return e.select("event_id", T.accepted_locale(saved, header).alias("locale"))


accept_language.sql = "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'zh-CN' WHEN event_id % 10 > 0 AND event_id % 10 >= user_id % 10 THEN 'zh-CN' ELSE 'en-US' END AS locale FROM events"


def read_through(spark, sf_dir):
    """Every third page is stored, the others are made offline."""
    c = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.lit(9).alias("total"), F.lit("").alias("tail"))
    stored = c.filter("page % 3 = 0").select("document_id", "page", F.lit('{"blocks":[{"kind":"caption","text":"kept"}]}').alias("payload"))
    return P.read_through(c, stored, P.Echo()).select("document_id", "page", "source", F.size("blocks").alias("n_blocks"))


read_through.sql = f"SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn + 1 AS INTEGER) AS page, CASE WHEN (turn + 1) % 3 = 0 THEN 'cache' ELSE 'api' END AS source, CAST(CASE WHEN (turn + 1) % 3 = 0 THEN 1 ELSE len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_replace(l, '{T.WHITE}+', '', 'g') <> '')) END AS INTEGER) AS n_blocks FROM conversations"


class Reviser:
    """Answers with a page's text and number, and takes back the page before if told how that ends."""

    def translate(self, text, page, total, tail):
        own = {"page": page, "blocks": [{"kind": "paragraph", "text": text}, {"kind": "page_number", "text": str(page + 10)}]}
        return own | {"previousPageRevision": {"page": page - 1, "blocks": [{"kind": "caption", "text": f"after {tail}"}]}} if tail else own


def _revised(spark, sf_dir):
    """Turns as pages, each a finished sentence; every third one is stored, and the answer for the next page revises it."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("."))
    c = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page"), text.alias("text"), F.lit(9).alias("total"))
    stored = c.filter("page % 3 = 0").select("document_id", "page", F.to_json(F.struct(F.array(F.struct(F.lit("paragraph").alias("kind"), "text")).alias("blocks"))).alias("payload"))
    return P.translate_batch(c, stored, Reviser(), settings=SETTINGS, now_ms=NOW), stored


SETTINGS, NOW = ("p", "e", "m", "low", "English"), 1000
REVISED = "c AS (SELECT conv_id, turn + 1 AS page, coalesce(text, '') || '.' AS text, (turn + 1) % 3 = 0 AS stored FROM conversations), r AS (SELECT CAST(c.conv_id AS VARCHAR) AS document_id, CAST(c.page AS INTEGER) AS page, c.text, c.stored, n.page IS NOT NULL AND c.stored AS revised FROM c LEFT JOIN c n ON n.conv_id = c.conv_id AND n.page = c.page + 1)"


def read_through_revised(spark, sf_dir):
    return _revised(spark, sf_dir)[0].pages.select("document_id", "page", "source", "markdown")


read_through_revised.sql = f"WITH {REVISED} SELECT document_id, page, CASE WHEN stored AND NOT revised THEN 'cache' ELSE 'api' END AS source, CASE WHEN NOT stored THEN text || chr(10) || chr(10) || (page + 10) WHEN revised THEN 'after ' || right(text, 160) ELSE text END AS markdown FROM r"


def read_through_store(spark, sf_dir):
    """The stored translations after the batch: what was there, answers, and revisions over what was there."""
    batch, stored = _revised(spark, sf_dir)
    key = D.cache_key(F.col("document_id"), F.col("page"), *map(F.lit, SETTINGS))
    state = batch.translations_after(stored.select(key.alias("cache_key"), "document_id", "page", "payload", F.lit(0).cast("long").alias("cache_version"), F.lit(0).cast("long").alias("arrival")))
    at = lambda p: F.get_json_object("payload", p)
    return state.select("cache_key", "page", "cache_version", at("$.blocks[0].text").alias("text"), F.size(F.from_json(at("$.blocks"), "array<string>")).alias("n_blocks"), F.coalesce(at("$.revised"), F.lit("false")).alias("revised"), at("$.cacheVersion").cast("long").alias("version_inside"))


read_through_store.sql = f"""WITH {REVISED} SELECT 'layout-v3::' || document_id || '::' || page || '::p::e::m::low::English' AS cache_key, page, CAST(CASE WHEN NOT stored THEN 1000000 + page WHEN revised THEN 1000001 + page ELSE 0 END AS BIGINT) AS cache_version, CASE WHEN revised THEN 'after ' || right(text, 160) ELSE text END AS text,
 CASE WHEN stored THEN 1 ELSE 2 END AS n_blocks, CASE WHEN revised THEN 'true' ELSE 'false' END AS revised, CAST(CASE WHEN NOT stored THEN 1000000 + page WHEN revised THEN 1000001 + page END AS BIGINT) AS version_inside FROM r"""


def read_through_navigation(spark, sf_dir):
    """The navigation store after the batch: a revision is looked at after the page it revises."""
    return _revised(spark, sf_dir)[0].navigation_after().select("document_id", "pdf_page", "is_table_of_contents", "page_label", "page_value", "numbering", "arrival")


read_through_navigation.sql = f"WITH {REVISED} SELECT document_id, page AS pdf_page, false AS is_table_of_contents, CASE WHEN NOT stored THEN CAST(page + 10 AS VARCHAR) END AS page_label, CAST(CASE WHEN NOT stored THEN page + 10 END AS BIGINT) AS page_value, CASE WHEN NOT stored THEN 'arabic' END AS numbering, CAST(1000000 + page + CASE WHEN revised THEN 1 ELSE 0 END AS BIGINT) AS arrival FROM r"


def request_bodies(spark, sf_dir):
    """Requests in both wire shapes, with one to three images."""
    c = X.table(spark, sf_dir, "conversations")
    images = F.transform(F.sequence(F.lit(1), (F.col("turn") % 3 + 1).cast("int")), lambda i: F.struct(i.alias("page"), F.concat(F.lit("data:"), i.cast("string")).alias("url")))
    provider = F.when(F.col("conv_id") % 2 == 0, "openai").otherwise("other")
    endpoint = F.when(F.col("conv_id") % 3 == 0, "https://x/responses").otherwise("https://x/chat/completions")
    effort = F.when(F.col("turn") % 2 == 0, "none").otherwise("low")
    body = P.request_body(P.uses_responses(provider, endpoint), F.lit("m"), effort, F.coalesce("text", F.lit("")), images)
    b = c.select("conv_id", "turn", body.alias("b"))
    at = lambda p: F.get_json_object("b", p)
    return b.select(
        "conv_id", "turn",
        F.coalesce(at("$.input[0].content[0].text"), at("$.messages[0].content[0].text")).alias("instruction"),
        F.coalesce(at("$.input[0].content[2].image_url"), at("$.messages[0].content[2].image_url.url")).alias("first_image"),
        F.coalesce(at("$.input[0].content[5].text"), at("$.messages[0].content[5].text")).alias("third_line"),
        F.coalesce(at("$.reasoning.effort"), at("$.reasoning_effort")).alias("effort"),
        F.coalesce(at("$.text.format.type"), at("$.response_format.type")).alias("format"),
    )


request_bodies.sql = "SELECT conv_id, turn, coalesce(text, '') AS instruction, 'data:1' AS first_image, CASE WHEN turn % 3 = 2 THEN 'Page 3:' END AS third_line, CASE WHEN turn % 2 <> 0 THEN 'low' END AS effort, CASE WHEN conv_id % 2 = 0 OR conv_id % 3 = 0 THEN 'json_schema' ELSE 'json_object' END AS format FROM conversations"


def provider_answers(spark, sf_dir):
    """Texts of the answer shapes."""
    c = X.table(spark, sf_dir, "conversations")
    direct = F.to_json(F.struct(F.col("text").alias("output_text")))
    nested = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.lit("").alias("text")), F.struct(F.col("text").alias("text"))).alias("content"))).alias("output")))
    choice = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    answer = F.when(F.col("turn") % 4 == 0, direct).when(F.col("turn") % 4 == 1, nested).when(F.col("turn") % 4 == 2, choice).otherwise(F.lit("{}"))
    return c.select("conv_id", "turn", P.response_text(answer).alias("answer"))


provider_answers.sql = "SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 AND text <> '' THEN text END AS answer FROM conversations"


def scalar_functions(spark, sf_dir):
    p = X.table(spark, sf_dir, "part")
    raw = F.concat(F.lit(" https://x.org/v1"), F.when(F.col("p_partkey") % 2 == 0, "/responses").otherwise("/"))
    name = F.element_at(F.array(F.lit("English"), F.lit("Japanese"), F.lit("Klingon")), (F.col("p_partkey") % 3 + 1).cast("int"))
    url = F.when(F.col("p_partkey") % 5 == 0, "not an address").when(F.col("p_partkey") % 5 == 1, "https://x.org/?book=+%20#top").otherwise(F.concat(F.lit("https://x.org/?a=1&book=%20"), F.col("p_partkey").cast("string"), F.lit("#top")))
    return p.select("p_partkey", T.signed(F.col("p_size") - 20).alias("signed"), T.percent_encode(F.col("p_name")).alias("encoded"), T.percent_decode(T.percent_encode(F.col("p_name"))).alias("decoded"), T.endpoint(raw, "compatible", "").alias("endpoint"), T.language_label(name, "zh-CN").alias("language"), T.book_id_of(url).alias("book"), T.with_book_id(url, F.when(F.col("p_partkey") % 2 == 0, F.lit("a b"))).alias("address"), T.safe_return_path(F.when(F.col("p_partkey") % 2 == 0, "//evil").otherwise("/ok")).alias("back"))


scalar_functions.sql = "SELECT p_partkey, CASE WHEN p_size > 20 THEN '+' ELSE '' END || (p_size - 20) AS signed, url_encode(p_name) AS encoded, p_name AS decoded, 'https://x.org/v1' || CASE WHEN p_partkey % 2 = 0 THEN '/responses' ELSE '/chat/completions' END AS endpoint, CASE p_partkey % 3 WHEN 0 THEN 'English' WHEN 1 THEN '日本語' ELSE 'Klingon' END AS language, CASE WHEN p_partkey % 5 > 1 THEN CAST(p_partkey AS VARCHAR) END AS book, CASE p_partkey % 5 WHEN 0 THEN 'not an address' WHEN 1 THEN 'https://x.org/' ELSE 'https://x.org/?a=1' END || CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 5 > 1 THEN '&' ELSE '?' END || 'book=a%20b' ELSE '' END || CASE WHEN p_partkey % 5 > 0 THEN '#top' ELSE '' END AS address, CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '/ok' END AS back FROM part"

def response_normalize(spark, sf_dir):
    """A model's answers: the page asked for where none is given, and revisions of exactly the page before."""
    c = X.table(spark, sf_dir, "conversations")
    block = F.array(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    json = F.to_json(F.struct(F.when(F.col("turn") % 2 == 0, F.col("turn") + 5).alias("page"), block.alias("blocks"), F.when(F.col("turn") % 3 == 0, F.struct(F.when(F.col("turn") % 6 == 0, F.lit(1)).alias("page"), block.alias("blocks"))).alias("previousPageRevision")))
    r = c.select("conv_id", "turn", B.read_response(json, F.col("turn") + 1).alias("r"))
    return r.select("conv_id", "turn", "r.page", F.size("r.blocks").alias("n_blocks"), F.col("r.previousPageRevision.page").alias("revised_page"), F.size("r.previousPageRevision.blocks").alias("revised_blocks"))


response_normalize.sql = "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn + 5 ELSE turn + 1 END AS page, 1 AS n_blocks, CASE WHEN turn % 6 = 0 THEN 1 WHEN turn % 3 = 0 THEN turn END AS revised_page, CASE WHEN turn % 3 = 0 THEN 1 ELSE NULL END AS revised_blocks FROM conversations"


def stale_results(spark, sf_dir):
    """Results of the newest load of each document only."""
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), (F.col("event_id") % 4).alias("sequence"), "event_id")
    return V.current_only(e, e.groupBy("document_id").agg(F.max("sequence").alias("sequence"))).select("document_id", "event_id")


stale_results.sql = "SELECT user_id AS document_id, event_id FROM (SELECT *, max(event_id % 4) OVER (PARTITION BY user_id) AS now FROM events) WHERE event_id % 4 = now"


def request_validation(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 5 == 0, F.lit(" ")).otherwise(F.lit("k"))
    return o.select("o_orderkey", P.valid_request(key, F.col("o_orderpriority"), (F.col("o_custkey") % 5).cast("int")).alias("valid"), P.prompt(F.col("o_orderkey"), F.lit(9), F.lit("English"), F.when(F.col("o_orderkey") % 2 == 0, "the end").otherwise("")).alias("prompt"))


request_validation.sql = "SELECT o_orderkey, o_orderkey % 5 <> 0 AND o_custkey % 5 BETWEEN 1 AND 3 AS valid, 'Translate page ' || o_orderkey || ' of 9 into English as layout blocks in JSON.' || CASE WHEN o_orderkey % 2 = 0 THEN ' The page before ends: the end' ELSE '' END AS prompt FROM orders"

QUERIES = [response_normalize, stale_results, request_validation, boundary_overlap, boundary_signs, boundary_chain, boundary_fold, boundary_tail, exact_previous_page, page_islands, context_window, prefetch_plan, viewport_predicates, page_status, char_prefix_sum, typewriter_reveal, accept_language, read_through, read_through_revised, read_through_store, read_through_navigation, request_bodies, provider_answers, scalar_functions]
