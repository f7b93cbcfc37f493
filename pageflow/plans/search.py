"""Search, library and store queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import search as S
from ..operators import statements as ST
from ..operators import store as D
from ..scratch import scratch
from ..streaming.upserts import latest_state, stream_upsert, task_tokens
from . import fixtures as X

WHITE = T.WHITE
SUFFIX = "p::e::m::low::user"


def search_snippets(spark, sf_dir):
    """A search of every document, 250 candidates and 100 results in each."""
    return S.search_each(X.translations(spark, sf_dir), "tion")


SNIPPET = f"""(CASE WHEN s > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, s + 1, e - s), '{WHITE}+', ' ', 'g'), ' ') || CASE WHEN e < length(text) THEN '…' ELSE '' END)"""
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SEARCH = f"""f AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, cache_key) AS n FROM t WHERE contains({FOLD.format('text')}, '{{q}}'){{w}}),
c AS (SELECT document_id, page, text, instr(lower(text), '{{q}}') AS pos, row_number() OVER (PARTITION BY document_id ORDER BY page, cache_key) AS n FROM f WHERE n <= 250 AND contains(lower(text), '{{q}}')),
s AS (SELECT *, greatest(0, pos - 1 - 72) AS s, least(length(text), pos - 1 + {{n}} + 72) AS e FROM c WHERE n <= 100)"""
search_snippets.sql = f"WITH {X.TRANSLATIONS_SQL}, {SEARCH.format(q='tion', n=4, w='')} SELECT document_id, page, {SNIPPET} AS snippet FROM s"


def search_settings(spark, sf_dir):
    return S.search_each(X.translations(spark, sf_dir), "er", suffix=SUFFIX)


search_settings.sql = f"WITH {X.TRANSLATIONS_SQL}, {SEARCH.format(q='er', n=2, w=f" AND ends_with(cache_key, '::{SUFFIX}')")} SELECT document_id, page, {SNIPPET} AS snippet FROM s"


def search_document(spark, sf_dir):
    """One document's search, as a reader asks for it."""
    return S.search(X.translations(spark, sf_dir), "doc-1", "E")


search_document.sql = f"WITH {X.TRANSLATIONS_SQL}, {SEARCH.format(q='e', n=1, w=" AND document_id = 'doc-1'")} SELECT document_id, page, {SNIPPET} AS snippet FROM s"


def search_requests(spark, sf_dir):
    """Which requests are valid."""
    e = X.table(spark, sf_dir, "events")
    document = F.repeat(F.lit("d"), (F.col("event_id") % 131).cast("int"))
    query = F.concat(F.lit(" "), F.repeat(F.lit("q"), (F.col("event_id") % 203).cast("int")))
    suffix = F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("s"), (1795 + F.col("event_id") % 11).cast("int")))
    return e.select("event_id", S.search_request_valid(document, query, suffix).alias("search"), D.index_request_valid(document, suffix).alias("index"))


search_requests.sql = "SELECT event_id, event_id % 131 BETWEEN 1 AND 128 AND event_id % 203 BETWEEN 1 AND 199 AND (event_id % 3 <> 0 OR event_id % 11 <= 5) AS search, event_id % 131 BETWEEN 1 AND 128 AND event_id % 3 = 0 AND event_id % 11 <= 5 AS index FROM events"


def search_prefilter_ascii(spark, sf_dir):
    t = X.translations(spark, sf_dir)
    return t.filter(S.contains(F.col("text"), "É", ascii_only=True) | S.contains(F.col("text"), "TH", ascii_only=True)).select("document_id", "page")


search_prefilter_ascii.sql = f"WITH {X.TRANSLATIONS_SQL} SELECT document_id, page FROM t WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'É') OR contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'th')"


def block_exists_search(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    blocks = F.transform(F.split("text", "\n"), lambda x: X.plain_block("paragraph", x))
    return d.filter(S.block_contains(blocks, "license")).select("doc_id")


block_exists_search.sql = "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'license'))) > 0"


def highlight_segments(spark, sf_dir):
    t = X.translations(spark, sf_dir).withColumn("parts", T.highlight(F.col("text"), "the"))
    return t.select("document_id", "page", F.size(F.filter("parts", lambda p: p["hit"])).alias("hits"), F.size("parts").alias("segments"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("joined"))


highlight_segments.sql = f"WITH {X.TRANSLATIONS_SQL}, x AS (SELECT *, string_split(lower(text), 'the') AS parts FROM t) SELECT document_id, page, len(parts) - 1 AS hits, len(parts) - 1 + len(list_filter(parts, lambda p: p <> '')) AS segments, text AS joined FROM x"


def cached_page_index(spark, sf_dir):
    return D.cached_pages(X.translations(spark, sf_dir), SUFFIX)


cached_page_index.sql = f"WITH {X.TRANSLATIONS_SQL} SELECT DISTINCT document_id, page FROM t WHERE ends_with(cache_key, '::{SUFFIX}')"


def translation_lookup(spark, sf_dir):
    return D.find_translation(X.translations(spark, sf_dir), "layout-v3::doc-1::1::p::e::m::low::user").select("document_id", "page", "text")


translation_lookup.sql = f"WITH {X.TRANSLATIONS_SQL} SELECT document_id, page, text FROM t WHERE cache_key = 'layout-v3::doc-1::1::p::e::m::low::user'"

SIZE_SQL = "CASE WHEN size < 1048576 THEN CAST(greatest(1, CAST(floor(size / 1024 + 0.5) AS BIGINT)) AS VARCHAR) || ' KB' WHEN size < 10485760 THEN CAST(CAST(floor(size / 1048576 * 10 + 0.5) / 10 AS DECIMAL(20, 1)) AS VARCHAR) || ' MB' ELSE CAST(CAST(floor(size / 1048576 + 0.5) AS BIGINT) AS VARCHAR) || ' MB' END"


def library_recent(spark, sf_dir):
    b = D.library(X.books(spark, sf_dir))
    return b.select("id", T.title_of(F.col("name")).alias("title"), T.file_size(F.col("size")).alias("shown_size"), "uploaded_at")


library_recent.sql = f"WITH {X.BOOKS_SQL} SELECT id, regexp_replace(name, '(?i)\\.pdf$', '') AS title, {SIZE_SQL} AS shown_size, uploaded_at FROM b ORDER BY uploaded_at DESC, id LIMIT 200"


def book_lookup(spark, sf_dir):
    return D.find_book(X.books(spark, sf_dir), "b7").select("id", "fingerprint", "size")


book_lookup.sql = f"WITH {X.BOOKS_SQL} SELECT id, fingerprint, size FROM b WHERE id = 'b7' OR fingerprint = 'b7' ORDER BY id LIMIT 1"


def upsert_versioned(spark, sf_dir):
    return D.upsert_versioned(X.upsert_log(spark, sf_dir)).select("cache_key", "document_id", "page", "cache_version", F.col("payload").cast("double").alias("payload"), "updated_at")


upsert_versioned.sql = f"""WITH {X.LOG_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY version DESC, event_id DESC) AS n, first(document_id) OVER (PARTITION BY cache_key ORDER BY event_id) AS d, first(page) OVER (PARTITION BY cache_key ORDER BY event_id) AS p FROM l)
SELECT cache_key, d AS document_id, p AS page, version AS cache_version, value AS payload, event_id AS updated_at FROM r WHERE n = 1"""


def upsert_incremental(spark, sf_dir):
    """A stored state and a batch give what the whole log gives."""
    log = X.upsert_log(spark, sf_dir)
    base = D.upsert_versioned(log.filter("arrival % 2 = 0"))
    state = D.fold_into(base, log.filter("arrival % 2 = 1"))
    return state.select("cache_key", "document_id", "page", "cache_version", F.col("payload").cast("double").alias("payload"), "updated_at")


upsert_incremental.sql = upsert_versioned.sql


def stream_upserts(spark, sf_dir):
    """The same upserts as a stream."""
    events = spark.readStream.schema(X.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    log = events.select(F.concat(F.lit("k"), F.col("user_id")).alias("cache_key"), F.col("event_type").alias("document_id"), (F.col("event_id") % 50 + 1).cast("int").alias("page"), F.get_json_object("props", "$.k").cast("long").alias("cache_version"), F.col("value").cast("string").alias("payload"), F.col("event_id").alias("updated_at"), F.col("event_id").alias("arrival"))
    root = scratch(spark, "state")
    stream_upsert(log, root, f"{root}-log").awaitTermination()
    return latest_state(spark, root).select("cache_key", "document_id", "page", "cache_version", F.col("payload").cast("double").alias("payload"), "updated_at")


stream_upserts.sql = upsert_versioned.sql


def upsert_latest(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").cast("string").alias("document_id"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 100).cast("int")).alias("manual_offset"), F.col("event_id").alias("arrival"))
    return D.upsert_latest(D.checked_settings(log), ["document_id"]).select("document_id", "manual_offset")


upsert_latest.sql = "SELECT document_id, manual_offset FROM (SELECT CAST(user_id AS VARCHAR) AS document_id, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 100 AS INTEGER) END AS manual_offset, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1"


def upsert_books(spark, sf_dir):
    """Books that arrive again under a fingerprint keep their first id."""
    log = X.books(spark, sf_dir).withColumn("arrival", F.col("uploaded_at"))
    return D.upsert_latest(log, ["fingerprint"], fixed=("id",)).select("fingerprint", "id", "name", "size", "uploaded_at")


upsert_books.sql = f"WITH {X.BOOKS_SQL} SELECT fingerprint, arg_min(id, uploaded_at) AS id, arg_max(name, uploaded_at) AS name, arg_max(size, uploaded_at) AS size, max(uploaded_at) AS uploaded_at FROM b GROUP BY fingerprint"


def upsert_validation(spark, sf_dir):
    log = X.upsert_log(spark, sf_dir)
    key = F.when(F.col("arrival") % 7 == 0, F.col("cache_key")).otherwise(F.concat(F.lit("layout-v3::"), F.col("cache_key")))
    document = F.when(F.col("arrival") % 11 == 0, F.repeat(F.lit("x"), 129)).otherwise(F.col("document_id"))
    page = F.when(F.col("arrival") % 13 == 0, 0).otherwise(F.col("page"))
    checked = D.checked_translations(log.withColumns({"cache_key": key, "document_id": document, "page": page}))
    return checked.groupBy(F.coalesce("rejected", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


upsert_validation.sql = "SELECT CASE WHEN event_id % 7 = 0 THEN 'key' WHEN event_id % 11 = 0 THEN 'document' WHEN event_id % 13 = 0 THEN 'page' WHEN value IS NULL THEN 'payload' ELSE 'ok' END AS outcome, count(*) AS n FROM events GROUP BY 1"


def signature_suppress(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id") % 10, "event_id").toDF("user_id", "event_type", "content", "event_id")
    return D.unseen(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], ["content"]).select("event_id")


signature_suppress.sql = "SELECT event_id FROM events a WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 2 = 1 AND b.user_id = a.user_id AND b.event_type = a.event_type AND b.event_id % 10 = a.event_id % 10)"


def latest_tasks(spark, sf_dir):
    """Starts that replace whatever runs are all accepted; finishes count when their token runs."""
    e = X.table(spark, sf_dir, "events")
    kind = F.element_at(F.array(F.lit("start"), F.lit("finish"), F.lit("cancel")), (F.col("event_id") % 3 + 1).cast("int"))
    return task_tokens(e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 5).cast("string").alias("token"), (F.col("event_id") % 2 == 0).alias("replace")))


latest_tasks.sql = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, (['start', 'finish', 'cancel'])[event_id % 3 + 1] AS kind, CAST(event_id % 5 AS VARCHAR) AS token, event_id % 2 = 0 AS rep, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT key, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BOOLEAN) AS accepted, CAST(NULL AS VARCHAR) AS running, CAST(0 AS BIGINT) AS n FROM e WHERE n = 1
UNION ALL SELECT key, seq, ok, CASE WHEN ok AND kind = 'start' THEN token WHEN NOT ok THEN running END, n
FROM (SELECT e.*, s.running, CASE kind WHEN 'start' THEN s.running IS NULL OR rep WHEN 'finish' THEN coalesce(s.running = token, false) ELSE s.running IS NOT NULL END AS ok FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1) x)
SELECT key, CAST(seq AS BIGINT) AS seq, accepted FROM s WHERE n > 0"""


def block_normalize(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations")
    one = F.struct(F.when(F.col("turn") % 2 == 0, "list_item").otherwise("bogus").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("marker"), F.lit("center").alias("align"), (F.col("turn") * 0.7).alias("indent"), F.lit("huge").alias("size"))
    blocks = B.read_blocks(F.concat(F.lit(" "), F.to_json(F.array(one))))
    rows = c.select("conv_id", "turn", F.explode(blocks).alias("b"))
    return rows.select("conv_id", "turn", "b.kind", "b.text", "b.marker", "b.align", "b.indent", "b.size")


block_normalize.sql = "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'list_item' ELSE 'paragraph' END AS kind, coalesce(text, '') AS text, '' AS marker, 'center' AS align, CAST(least(3, floor(turn * 0.7 + 0.5)) AS INTEGER) AS indent, 'md' AS size FROM conversations"


def payload_normalize(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations")
    json = F.when(F.col("turn") % 3 == 0, F.lit('{"blocks":"none","isBlank":"yes","cacheVersion":7}')).when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.array(F.struct(F.lit("spacer").alias("kind"), F.col("text").alias("text"))).alias("blocks"), F.lit("m").alias("markdown")))).otherwise(F.lit('{"isBlank":false'))
    p = B.read_payload(json)
    return c.select("conv_id", "turn", p["isBlank"].alias("is_blank"), p["cacheVersion"].alias("version"), F.size(p["blocks"]).alias("n_blocks"), p["markdown"].alias("markdown"))


payload_normalize.sql = "SELECT conv_id, turn, true AS is_blank, CASE WHEN turn % 3 = 0 THEN 7 ELSE 0 END AS version, CASE WHEN turn % 3 = 1 THEN 1 ELSE 0 END AS n_blocks, CASE WHEN turn % 3 = 1 THEN 'm' ELSE '' END AS markdown FROM conversations"


def _lined(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    kind = lambda i: F.when(i == 0, "heading").when(i % 5 == 4, "list_item").when(i % 5 == 3, "spacer").otherwise("paragraph")
    return d.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: X.plain_block(kind(i), x, marker=F.lit("*"))).alias("blocks"))


LINES = "x AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda p: p <> '') AS filled, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)"


def page_markdown(spark, sf_dir):
    b = F.col("blocks")
    return _lined(spark, sf_dir).select("doc_id", F.sha2(B.markdown(b), 256).alias("markdown"), F.sha2(B.search_text(b, F.lit("")), 256).alias("search_text"))


page_markdown.sql = f"WITH {LINES} SELECT doc_id, sha256(array_to_string(filled, chr(10) || chr(10))) AS markdown, sha256(array_to_string(filled, chr(10))) AS search_text FROM x"


def page_is_blank(spark, sf_dir):
    b = F.col("blocks")
    return _lined(spark, sf_dir).select("doc_id", B.is_blank(b).alias("is_blank"), F.size(B.display_texts(b, F.lit(""))).alias("n_texts"))


page_is_blank.sql = f"WITH {LINES} SELECT doc_id, len(list_filter(lines, lambda l, i: (i - 1 = 0 OR (i - 1) % 5 <> 3) AND regexp_replace(l, '{WHITE}+', '', 'g') <> '')) = 0 AS is_blank, CAST(list_sum(list_transform(lines, lambda l, i: CASE WHEN i > 1 AND (i - 1) % 5 = 3 THEN 0 WHEN i > 1 AND (i - 1) % 5 = 4 THEN 3 ELSE 1 END)) AS INTEGER) AS n_texts FROM x"


def block_rows(spark, sf_dir):
    return B.block_rows(_lined(spark, sf_dir)).select("doc_id", "ordinal", "block.kind", F.length("block.text").alias("n"))


block_rows.sql = f"WITH {LINES}, y AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM x) SELECT doc_id, CAST(i AS INTEGER) AS ordinal, CASE WHEN i = 0 THEN 'heading' WHEN i % 5 = 4 THEN 'list_item' WHEN i % 5 = 3 THEN 'spacer' ELSE 'paragraph' END AS kind, CAST(length(line) AS INTEGER) AS n FROM y"



def _payloads(spark, sf_dir):
    """Turns as stored payloads: blocks with odd elements, blocks that are text or a number, and broken JSON."""
    t = X.translations(spark, sf_dir)
    json = F.to_json(F.struct("text"))
    text = F.substring(json, F.lit(9), F.length(json) - 9)  # {"text":...}
    part = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    kind = F.length("text") % 5
    payload = (
        F.when(kind == 0, part('{"blocks":[{"kind":"paragraph","text":', text, '},{"text":5},"tion",3,null],"markdown":"m"}'))
        .when(kind == 1, part('{"blocks":"nation","markdown":', text, "}"))
        .when(kind == 2, part('{"blocks":[{"text":', text))
        .when(kind == 3, part('{"blocks":7,"markdown":', text, "}"))
        .otherwise(part('{"blocks":[{"text":', text, '},{"text":" the end"}],"markdown":"relation"}'))
    )
    return t.select("document_id", "page", "cache_key", payload.alias("payload"))


def search_stored(spark, sf_dir):
    """The search of stored payloads."""
    return S.search_payloads(_payloads(spark, sf_dir), "tion")


STORED = f"{X.TRANSLATIONS_SQL}, k AS (SELECT *, length(text) % 5 AS kind FROM t)"
STORED_TEXT = f"x AS (SELECT document_id, page, cache_key, kind = 4 OR contains({FOLD.format('text')}, 'tion') AS near, CASE WHEN kind = 0 THEN text WHEN kind = 4 THEN CASE WHEN text = '' THEN '' ELSE text || chr(10) END || ' the end' ELSE regexp_replace(regexp_replace(text, '^{WHITE}+', ''), '{WHITE}+$', '') END AS text FROM k WHERE kind <> 2)"
search_stored.sql = f"""WITH {STORED}, {STORED_TEXT}, f AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, cache_key) AS n FROM x WHERE near),
c AS (SELECT *, instr(lower(text), 'tion') AS pos FROM f WHERE n <= 250 AND contains(lower(text), 'tion')), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, cache_key) AS m FROM c),
s AS (SELECT document_id, page, text, greatest(0, pos - 1 - 72) AS s, least(length(text), pos - 1 + 4 + 72) AS e FROM r WHERE m <= 100) SELECT document_id, page, {SNIPPET} AS snippet FROM s"""


def stored_blocks(spark, sf_dir):
    """The blocks of stored payloads, a row each."""
    b = S.payload_blocks(_payloads(spark, sf_dir))
    return b.select("document_id", "page", "ordinal", "block.kind", "block.text")


stored_blocks.sql = f"""WITH {STORED}, b AS (SELECT document_id, page, unnest(CASE kind WHEN 0 THEN [text, '', '', '', ''] WHEN 4 THEN [text, ' the end'] ELSE [] END) AS text, unnest(CASE kind WHEN 0 THEN [0, 1, 2, 3, 4] WHEN 4 THEN [0, 1] ELSE [] END) AS ordinal FROM k)
SELECT document_id, page, CAST(ordinal AS INTEGER) AS ordinal, 'paragraph' AS kind, text FROM b"""

#: Marks that would end a text, were values put into it.
MARKS = "it's \"7\"; -- {x} :y"


def statement_lookups(spark, sf_dir):
    """A book, a translation and a document's index by statements with named parameters, with marks in the values."""
    books = X.books(spark, sf_dir).withColumn("id", F.concat("id", F.lit(MARKS)))
    t = X.translations(spark, sf_dir).withColumn("cache_key", F.concat("cache_key", F.lit(MARKS)))
    book, translation, index = ST.book_statement(books), ST.translation_statement(t), ST.index_statement(t)
    found = [
        *(book.bind(wanted=w).rows().select(F.lit("book").alias("what"), F.col("id").alias("key"), F.col("size").cast("string").alias("value")) for w in (f"b7{MARKS}", "b7", "' OR '1' = '1")),
        translation.bind(key=f"layout-v3::doc-1::1::p::e::m::low::user{MARKS}").rows().select(F.lit("translation").alias("what"), F.col("document_id").alias("key"), F.col("text").alias("value")),
        *(index.bind(document=d, suffix=f"{SUFFIX}{MARKS}").rows().select(F.lit("index").alias("what"), F.col("document_id").alias("key"), F.col("page").cast("string").alias("value")) for d in ("doc-1", "doc-2'")),
    ]
    return reduce(lambda a, b: a.unionByName(b), found)


statement_lookups.sql = f"""WITH {X.BOOKS_SQL}, {X.TRANSLATIONS_SQL} SELECT 'book' AS what, id || '{MARKS.replace("'", "''")}' AS key, CAST(size AS VARCHAR) AS value FROM b WHERE id = 'b7'
UNION ALL SELECT 'translation', document_id, text FROM t WHERE cache_key = 'layout-v3::doc-1::1::p::e::m::low::user'
UNION ALL SELECT 'index', document_id, CAST(page AS VARCHAR) FROM t WHERE document_id = 'doc-1' AND ends_with(cache_key, '::{SUFFIX}')"""


def typed_books(spark, sf_dir):
    """Books read from text, with numbers that are none."""
    b = X.books(spark, sf_dir)
    size = F.when(F.col("uploaded_at") % 4 == 0, F.concat(F.col("size").cast("string"), F.lit(".0"))).when(F.col("uploaded_at") % 4 == 1, "12.5").when(F.col("uploaded_at") % 4 == 2, "many").otherwise(F.col("size").cast("string"))
    raw = b.select("id", "fingerprint", "name", F.lit("k").alias("object_key"), F.lit("application/pdf").alias("content_type"), size.alias("size"), F.lit(3.0).alias("page_count"), F.col("uploaded_at").cast("double").alias("uploaded_at"))
    return D.typed_books(raw).select("id", "name", "size", "page_count", "uploaded_at")


typed_books.sql = f"WITH {X.BOOKS_SQL} SELECT id, name, CASE WHEN uploaded_at % 4 IN (0, 3) THEN size END AS size, CAST(3 AS BIGINT) AS page_count, uploaded_at FROM b"

QUERIES = [search_stored, stored_blocks, statement_lookups, typed_books, search_snippets, search_settings, search_document, search_requests, search_prefilter_ascii, block_exists_search, highlight_segments, cached_page_index, translation_lookup, library_recent, book_lookup, upsert_versioned, upsert_incremental, stream_upserts, upsert_latest, upsert_books, upsert_validation, signature_suppress, latest_tasks, block_normalize, payload_normalize, page_markdown, page_is_blank, block_rows]
