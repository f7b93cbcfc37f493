"""Queries over book bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store as D
from ..operators.prefix import running, stretches
from ..scratch import scratch
from ..sources import books as K
from ..sources import ranges as R
from ..sources.files import Appended
from ..streaming.uploads import library_of, stream_uploads
from . import fixtures as X


def _content(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def fingerprint_sha256(spark, sf_dir):
    return _content(spark, sf_dir).select("id", K.fingerprint(F.col("content")).alias("fingerprint"))


SAMPLED = "x AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents), y AS (SELECT doc_id, encode(CAST(n AS VARCHAR)) || array_slice(b, 1, 65536) || array_slice(b, greatest(1, n - 65535), n) AS s FROM x)"
fingerprint_sha256.sql = f"WITH {SAMPLED} SELECT doc_id AS id, sha256(s) AS fingerprint FROM y"


def fingerprint_fnv1a(spark, sf_dir):
    return _content(spark, sf_dir).select("id", K.fingerprint_fnv1a(F.col("content")).alias("fingerprint"))


fingerprint_fnv1a.sql = f"""WITH {SAMPLED}, z AS (SELECT doc_id, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(regexp_extract_all(hex(s), '..'), lambda d: CAST(CAST('0x' || d AS INTEGER) AS HUGEINT))), lambda h, d: xor(h, d) * 1099511628211 % 18446744073709551616) AS h FROM y)
SELECT doc_id AS id, 'fnv1a-' || format('{{:08x}}{{:08x}}', CAST(h // 4294967296 AS BIGINT), CAST(h % 4294967296 AS BIGINT)) AS fingerprint FROM z"""


def part_plan(spark, sf_dir):
    return K.part_plan(X.books(spark, sf_dir))


part_plan.sql = f"WITH {X.BOOKS_SQL}, x AS (SELECT id, size, unnest(range(1, CAST(ceil(size / 8388608) AS BIGINT) + 1)) AS part_number FROM b WHERE size > 0) SELECT id, part_number, (part_number - 1) * 8388608 AS start, least(8388608, size - (part_number - 1) * 8388608) AS length FROM x"


def part_reassemble(spark, sf_dir):
    """Parts of 1000 bytes, put together again; every tenth book announces a wrong size."""
    c = _content(spark, sf_dir)
    sizes = c.select("id", (F.octet_length("content") + F.when(F.col("id") % 10 == 0, 1).otherwise(0)).alias("size"))
    parts = K.cut_parts(c, 1000)
    return K.check_assembly(parts, sizes).join(K.digests(parts).drop("bytes"), "id").select("id", "digest", "accepted", "reason")


part_reassemble.sql = "SELECT doc_id AS id, sha256(text) AS digest, doc_id % 10 <> 0 AS accepted, CASE WHEN doc_id % 10 = 0 THEN 'size' END AS reason FROM documents WHERE strlen(text) > 0"



def part_checks(spark, sf_dir):
    """Parts as they arrive, some with a wrong key, number, session or size, some twice."""
    e = X.table(spark, sf_dir, "events")
    i = F.col("event_id")
    upload = F.concat(F.lpad(F.col("user_id").cast("string"), 8, "0"), F.when(i % 17 == 0, "-x").otherwise(F.repeat(F.lit("-"), 28)))
    key = F.when(i % 7 == 0, "books/A.pdf").otherwise("books/a-1.pdf")
    content = F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("part "), i.cast("string"))).cast("binary")
    parts = e.select(upload.alias("upload_id"), key.alias("object_key"), (i % 6).cast("int").alias("part_number"), content.alias("content"), i.alias("arrival"))
    return K.checked_parts(parts).select("arrival", "rejected", "etag")


part_checks.sql = """WITH x AS (SELECT event_id AS arrival, user_id, event_id % 6 AS part, CASE WHEN event_id % 7 = 0 THEN 'key' WHEN event_id % 6 < 1 THEN 'number' WHEN event_id % 17 = 0 THEN 'upload' WHEN event_id % 13 = 0 THEN 'size' END AS r FROM events),
y AS (SELECT *, min(arrival) FILTER (r IS NULL) OVER (PARTITION BY user_id, part) AS f FROM x),
z AS (SELECT arrival, CASE WHEN r IS NULL AND arrival > f THEN 'exists' ELSE r END AS rejected FROM y)
SELECT arrival, rejected, CASE WHEN rejected IS NULL THEN sha256('part ' || arrival) END AS etag FROM z"""

HEADERS = ("bytes=0-3", "bytes=5-", "bytes=-7", "bytes=-", "bytes=9-2", "bytes=100000000-", "bytes=-0", "pages=1-2")


def byte_range_parse(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders").withColumn("size", F.col("o_custkey") + 3)
    r = K.byte_range(F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("o_orderkey") % 8 + 1).cast("int")), F.col("size"))
    return o.select("o_orderkey", r["offset"].alias("offset"), r["length"].alias("length"), K.range_status(r).alias("status"))


byte_range_parse.sql = """WITH x AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_custkey + 3 AS n FROM orders),
y AS (SELECT o_orderkey, CASE WHEN k = 0 AND n > 0 THEN 0 WHEN k = 1 AND n > 5 THEN 5 WHEN k = 2 THEN n - least(n, 7) WHEN k = 3 THEN 0 WHEN k = 4 AND n > 9 THEN 9 END AS o, CASE WHEN k = 0 THEN least(n, 4) WHEN k = 1 AND n > 5 THEN n - 5 WHEN k = 2 THEN least(n, 7) WHEN k = 3 THEN n WHEN k = 4 AND n > 9 THEN 0 END AS l FROM x)
SELECT o_orderkey, CAST(o AS BIGINT) AS "offset", CAST(l AS BIGINT) AS length, CASE WHEN o IS NULL THEN 400 WHEN l < 1 OR l > 2097152 THEN 416 ELSE 206 END AS status FROM y"""


def byte_range_read(spark, sf_dir):
    c = _content(spark, sf_dir)
    r = K.byte_range(F.lit("bytes=3-20"), F.octet_length("content"))
    return c.filter(r.isNotNull()).select("id", F.sha2(K.read_range(F.col("content"), r), 256).alias("digest"), r["length"].alias("length"))


byte_range_read.sql = "SELECT doc_id AS id, sha256(array_slice(encode(text), 4, 21)) AS digest, CAST(least(18, strlen(text) - 3) AS BIGINT) AS length FROM documents WHERE strlen(text) > 3"


def chunk_plan(spark, sf_dir):
    b = X.books(spark, sf_dir).select("id", F.lit(100).cast("long").alias("start"), F.col("size").alias("end"))
    return K.chunk_plan(b)


chunk_plan.sql = f'WITH {X.BOOKS_SQL}, x AS (SELECT id, size, unnest(range(0, CAST(ceil((size - 100) / 1048576) AS BIGINT))) AS i FROM b WHERE size > 100) SELECT id, i, 100 + i * 1048576 AS start, least(size, 100 + (i + 1) * 1048576) AS "end" FROM x'


def upload_new(spark, sf_dir):
    b = X.books(spark, sf_dir)
    return K.new_uploads(b.filter("uploaded_at % 2 = 0"), b.filter("uploaded_at % 2 = 1")).select("id")


upload_new.sql = f"WITH {X.BOOKS_SQL} SELECT id FROM b WHERE uploaded_at % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b c WHERE c.uploaded_at % 2 = 1 AND c.fingerprint = b.fingerprint AND c.size = b.size)"


def upload_known(spark, sf_dir):
    b = X.books(spark, sf_dir)
    return K.known_uploads(b.filter("uploaded_at % 2 = 0"), b.filter("uploaded_at % 2 = 1")).select("id")


upload_known.sql = f"WITH {X.BOOKS_SQL} SELECT id FROM b WHERE uploaded_at % 2 = 0 AND EXISTS (SELECT 1 FROM b c WHERE c.uploaded_at % 2 = 1 AND c.fingerprint = b.fingerprint AND c.size = b.size)"

def retry_plan(spark, sf_dir):
    """Delays before each further attempt, and whether a reply confirms the bytes asked for."""
    o = X.table(spark, sf_dir, "orders").withColumn("attempt", F.col("o_orderkey") % K.ATTEMPTS)
    header = F.concat(F.lit("bytes 0-"), (F.col("o_custkey") % 9).cast("string"), F.lit("/100"))
    return o.select("o_orderkey", K.retry_delay(F.col("attempt")).alias("delay_ms"), K.content_range_ok(header, F.lit(0), F.lit(6), F.lit(100)).alias("confirmed"))


retry_plan.sql = "SELECT o_orderkey, CAST(75 * 2 ** (o_orderkey % 5) AS BIGINT) AS delay_ms, o_custkey % 9 = 5 AS confirmed FROM orders"


def fingerprint_valid(spark, sf_dir):
    b = X.books(spark, sf_dir)
    own = F.when(F.col("uploaded_at") % 3 == 0, F.upper("fingerprint")).when(F.col("uploaded_at") % 3 == 1, F.concat(F.lit("fnv1a-"), F.substring("fingerprint", 1, 16))).otherwise(F.col("fingerprint"))
    return b.select("id", D.valid_fingerprint(own).alias("valid"))


fingerprint_valid.sql = f"WITH {X.BOOKS_SQL} SELECT id, uploaded_at % 3 <> 0 OR regexp_full_match(upper(fingerprint), '[0-9]*') AS valid FROM b"



def _positions(spark, sf_dir):
    """Documents as stretches of one book a source, in the order of their ids: doc_id, id, first, last."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), F.coalesce("source", F.lit("none"))).alias("id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    placed = running(d, ["id"], stretches(F.col("doc_id"), 1 << 16), ["doc_id"], F.col("n"), "last", F.sum)
    return placed.select("doc_id", "id", (F.col("last") - F.col("n")).alias("first"), "last")


def _waiting(spark, sf_dir):
    """Requests for the first bytes of each document and some before it; long documents leave gaps."""
    p = _positions(spark, sf_dir)
    return p.select("id", F.col("doc_id").alias("request"), F.greatest(F.lit(0), F.col("first") - 100).alias("start"), F.least(F.col("last"), F.col("first") + 600).alias("end"), F.col("last").alias("size"))


WAITING = """p AS (SELECT doc_id, 's' || coalesce(source, 'none') AS id, coalesce(strlen(text), 0) AS n FROM documents),
w AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY doc_id) AS last FROM p),
r AS (SELECT id, doc_id AS request, greatest(0, last - n - 100) AS s, least(last, last - n + 600) AS e FROM w WHERE least(last, last - n + 600) > greatest(0, last - n - 100)),
i AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e, request ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
j AS (SELECT *, max(CASE WHEN reach IS NULL OR s > reach THEN s END) OVER (PARTITION BY id ORDER BY s, e, request ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM i)"""


def shared_fetches(spark, sf_dir):
    """The chunks that waiting requests need, each once."""
    shared = R.shared_chunks(R.checked_ranges(_waiting(spark, sf_dir)).filter("valid"), K.LEAST_CHUNK)
    return shared.fetches.select("id", "start", F.col("end").alias("stop"))


shared_fetches.sql = f"WITH {WAITING}, k AS (SELECT id, f, max(e) AS t FROM j GROUP BY ALL), x AS (SELECT id, f, t, unnest(range(0, CAST((t - f + 65535) // 65536 AS BIGINT))) AS i FROM k) SELECT id, CAST(f + i * 65536 AS BIGINT) AS start, CAST(least(t, f + (i + 1) * 65536) AS BIGINT) AS stop FROM x"


def shared_pieces(spark, sf_dir):
    """Which bytes of which chunk each waiting request gets."""
    shared = R.shared_chunks(R.checked_ranges(_waiting(spark, sf_dir)).filter("valid"), K.LEAST_CHUNK)
    return shared.pieces.select("id", "request", "chunk", "start", F.col("end").alias("stop"))


shared_pieces.sql = f"WITH {WAITING}, x AS (SELECT *, unnest(range(CAST((s - f) // 65536 AS BIGINT), CAST((e - 1 - f) // 65536 + 1 AS BIGINT))) AS i FROM j) SELECT id, request, CAST(f + i * 65536 AS BIGINT) AS chunk, CAST(greatest(s, f + i * 65536) AS BIGINT) AS start, CAST(least(e, f + (i + 1) * 65536) AS BIGINT) AS stop FROM x"


def _stored(spark, sf_dir):
    """Documents in files, one a task with its documents in a row: doc_id, file, first, length; and the files' folder."""
    root = scratch(spark, "stored")
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name, held, at = f"{root}/books/{TaskContext.get().partitionId():06d}.pdf", [], 0
        file = Appended(name)
        for b in batches:
            for i, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = content.as_py()
                file.append(own)
                held.append((i, name, at, len(own)))
                at += len(own)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "file", "first", "length"])
            held = []
        file.commit()

    d.mapInArrow(write, "doc_id long, file string, first long, length long").write.parquet(f"{root}/index")
    return spark.read.parquet(f"{root}/index"), f"{root}/books"


def stored_range_read(spark, sf_dir):
    """The same ranges as byte_range_read, of documents that lie in files; tasks read these bytes alone."""
    index, _ = _stored(spark, sf_dir)
    r = K.byte_range(F.lit("bytes=3-20"), F.col("length"))
    wanted = index.filter(r.isNotNull()).select("doc_id", "file", (F.col("first") + r["offset"]).alias("start"), (F.col("first") + r["offset"] + r["length"]).alias("end"))
    read = R.read_ranges(wanted)
    return read.select(F.col("doc_id").alias("id"), F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("length"))


stored_range_read.sql = byte_range_read.sql


def stored_chunk_read(spark, sf_dir):
    """Documents from the chunks that they share: files as rows of 64 KiB, each read once, and put together piece by piece."""
    index, root = _stored(spark, sf_dir)
    chunks = R.read_chunks(spark, root, K.LEAST_CHUNK).select(F.substring_index("path", "/", -1).alias("name"), "i", "content")
    first, last = F.floor(F.col("first") / K.LEAST_CHUNK), F.floor((F.col("first") + F.col("length") - 1) / K.LEAST_CHUNK)
    asked = index.filter("length > 0").select("doc_id", F.substring_index("file", "/", -1).alias("name"), "first", "length", F.explode(F.sequence(first, last)).alias("i"))
    begin = F.greatest(F.lit(0), F.col("first") - F.col("i") * K.LEAST_CHUNK)
    end = F.least(F.lit(K.LEAST_CHUNK), F.col("first") + F.col("length") - F.col("i") * K.LEAST_CHUNK)
    pieces = asked.join(chunks, ["name", "i"]).select("doc_id", "i", F.substring("content", (begin + 1).cast("int"), (end - begin).cast("int")).alias("content"))
    return K.digests(pieces, "doc_id", "i").select(F.col("doc_id").alias("id"), "bytes", "digest")


stored_chunk_read.sql = "SELECT doc_id AS id, strlen(text) AS bytes, sha256(text) AS digest FROM documents WHERE strlen(text) > 0"


def upload_library(spark, sf_dir):
    """Books of a hundred documents, a part each, uploaded as a stream; in every fifth book the first part comes with a wrong key."""
    book = F.floor(F.col("doc_id") / 100)
    d = X.table(spark, sf_dir, "documents")
    sizes = d.groupBy(book.alias("book")).agg(F.count(F.lit(1)).cast("int").alias("parts"), F.sum(F.octet_length("text").cast("long")).alias("size"))
    parts = spark.readStream.schema(d.schema).parquet(f"{sf_dir}/documents.parquet*").withColumn("book", book).join(sizes, "book")
    mark = F.sha2(F.col("book").cast("string"), 256)
    number = (F.col("doc_id") % 100 + 1).cast("int")
    key = F.when((F.col("book") % 5 == 0) & (number == 1), "books/none").otherwise(F.concat(F.lit("books/"), mark, F.lit(".pdf")))
    rows = parts.select(
        F.concat(F.lpad(F.col("book").cast("string"), 8, "0"), F.lit("-0000-0000-0000-000000000000")).alias("upload_id"), key.alias("object_key"), mark.alias("fingerprint"), F.concat(F.lit("Book "), F.col("book"), F.lit(".pdf")).alias("name"),
        "size", F.lit(1).alias("page_count"), F.lit("application/pdf").alias("content_type"), "parts", number.alias("part_number"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("arrival"),
    )
    root = scratch(spark, "uploads")
    stream_uploads(rows, root, f"{root}/log").awaitTermination()
    return library_of(spark, root).select("fingerprint", "name", "size", "uploaded_at", F.col("sha256").alias("digest"))


upload_library.sql = """SELECT sha256(CAST(b AS VARCHAR)) AS fingerprint, 'Book ' || b || '.pdf' AS name, CAST(sum(strlen(text)) AS BIGINT) AS size, max(doc_id) AS uploaded_at, sha256(string_agg(text, '' ORDER BY doc_id)) AS digest
FROM (SELECT *, doc_id // 100 AS b FROM documents) GROUP BY b HAVING b % 5 <> 0 AND min(coalesce(strlen(text), 0)) > 0"""

QUERIES = [shared_fetches, shared_pieces, stored_range_read, stored_chunk_read, upload_library, retry_plan, fingerprint_valid, fingerprint_sha256, fingerprint_fnv1a, part_plan, part_checks, part_reassemble, byte_range_parse, byte_range_read, chunk_plan, upload_new, upload_known]
