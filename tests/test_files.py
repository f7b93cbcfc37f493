"""Ranges and uploads over real files."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pageflow.sources import ranges as R
from pageflow.sources.books import LEAST_CHUNK
from pageflow.sources.files import Appended, write_whole
from pageflow.streaming.uploads import library_of, stream_uploads


@pytest.fixture()
def books(tmp_path):
    r = random.Random(1)
    out = {}
    for name, size in (("a", 700_000), ("b", 1), ("c", 131_072), ("d", 0)):
        out[f"file://{tmp_path}/books/{name}.pdf"] = r.randbytes(size)
    for uri, data in out.items():
        write_whole(uri, [data[:1000], data[1000:]])
    return out


def test_files_appear_whole(tmp_path):
    file = Appended(f"file://{tmp_path}/x/y.pdf")
    file.append(b"12")
    assert not (tmp_path / "x/y.pdf").exists()
    file.append(b"3")
    file.commit()
    assert (tmp_path / "x/y.pdf").read_bytes() == b"123" and [p.name for p in (tmp_path / "x").iterdir()] == ["y.pdf"]
    other = Appended(f"file://{tmp_path}/x/z.pdf")
    other.append(b"4")
    other.abandon()
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["y.pdf"]


def test_ranges_read_just_their_bytes(spark, books):
    r = random.Random(2)
    rows = []
    for i in range(300):
        uri = r.choice(list(books))
        a, b = sorted((r.randrange(len(books[uri]) + 1), r.randrange(len(books[uri]) + 1)))
        rows.append((i, uri, a, b))
    df = spark.createDataFrame(rows, "i int, file string, start long, end long").repartition(4)
    got = {x.i: x.content for x in R.read_ranges(df, cap=400_000).collect()}
    assert len(got) == len(rows)
    for i, uri, a, b in rows:
        assert (bytes(got[i]) == books[uri][a:b]) if 0 < b - a <= 400_000 else got[i] is None


def test_chunks_as_a_data_source(spark, books, tmp_path):
    df = R.read_chunks(spark, f"file://{tmp_path}/books", chunk=50_000, split=170_000)
    rows = df.collect()
    for uri, data in books.items():
        own = sorted((x.i, x.start, bytes(x.content)) for x in rows if uri.endswith(x.path))
        assert b"".join(c for _, _, c in own) == data and all(s == 50_000 * i and len(c) <= 50_000 for i, s, c in own)
    assert df.rdd.getNumPartitions() == 5 + 1 + 1  # stretches of three chunks
    assert R.read_chunks(spark, f"file://{tmp_path}/books/b.pdf").count() == 1


@pytest.mark.parametrize("span", [1 << 26, 90_000])
def test_requests_share_fetches(spark, books, span):
    """Every request gets its bytes, and no byte is fetched twice."""
    r = random.Random(3)
    rows = []
    for i in range(120):
        uri = r.choice(list(books)[:3])
        n = len(books[uri])
        a = r.randrange(n)
        rows.append((uri, i, a, min(n, a + r.choice([1, 500, 70_000])), n))
    rows += [(rows[0][0], 900, *rows[0][2:]), (rows[0][0], 901, -1, 4, 10), (rows[0][0], 902, 5, 5, 10), (rows[0][0], 903, 5, 11, 10), (rows[0][0], 904, None, 11, 20)]
    df = R.checked_ranges(spark.createDataFrame(rows, "id string, request int, start long, end long, size long").repartition(3))
    assert sorted(x.request for x in df.filter("NOT valid").collect()) == [901, 902, 903, 904]
    good = df.filter("valid")
    shared = R.shared_chunks(good, LEAST_CHUNK, span)
    fetches = shared.fetches.collect()
    for uri in books:
        own = sorted((x.start, x.end) for x in fetches if x.id == uri)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False)) and all(0 < b - a <= LEAST_CHUNK for a, b in own)
        asked = {p for u, i, a, b, _ in rows if u == uri and i <= 900 for p in range(a, b)}
        assert asked == {p for a, b in own for p in range(a, b)}
    content = {(x.file, x.start): bytes(x.content) for x in R.read_ranges(shared.fetches.withColumnRenamed("id", "file")).collect()}
    given = {}
    for x in sorted(shared.pieces.collect(), key=lambda x: (x.request, x.start)):
        given.setdefault(x.request, []).append(content[x.id, x.chunk][x.start - x.chunk : x.end - x.chunk])
    assert {i: b"".join(p) for i, p in given.items()} == {i: books[u][a:b] for u, i, a, b, _ in rows if i <= 900}


SCHEMA = "upload_id string, object_key string, fingerprint string, name string, size long, page_count int, content_type string, parts int, part_number int, content binary, arrival long"


def session(k, content, cuts, **other):
    """Rows of an upload's parts."""
    print_ = hashlib.sha256(content).hexdigest()
    pieces = [content[a:b] for a, b in zip([0, *cuts], [*cuts, len(content)], strict=True)]
    own = {"upload_id": f"{k:08d}-0000-0000-0000-000000000000", "object_key": f"books/{print_}.pdf", "fingerprint": print_, "name": f"Book {k}.pdf", "size": len(content), "page_count": 3, "content_type": "application/pdf", "parts": len(pieces)} | other
    return [(*own.values(), i + 1, p) for i, p in enumerate(pieces)]


def test_uploads_over_micro_batches(spark, tmp_path):
    r = random.Random(4)
    data = {k: r.randbytes(1000 + k) for k in range(6)}
    a, b, c, d, e = (session(k, data[k], [100, 500, 900]) for k in range(5))
    wrong = session(7, data[5], [10], size=7)
    again = session(8, data[0], [50])  # the first book under another session, later
    moved = session(9, data[5], [10], object_key="books/elsewhere.pdf")
    batches = [
        [a[2], a[0], b[1], c[0], c[1], c[2], c[3], wrong[1]],  # c is whole at once; a and b are not
        [a[3], a[2], a[0], b[0], d[0], d[1], d[3], wrong[0], moved[0], moved[1]],  # some come twice; d lacks one
        [a[1], b[3], b[2], e[3], e[2], e[1], e[0], (*e[0][:-1], b"other bytes"), again[1], again[0]],
    ]
    root, seen, arrival = f"file://{tmp_path}/store", [], 0
    for rows in batches:
        numbered = [(*x, arrival + i) for i, x in enumerate(rows)]
        arrival += len(rows)
        spark.createDataFrame(numbered, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream_uploads(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), root, f"{tmp_path}/log").awaitTermination()
        seen.append(sorted(p.name for p in Path(f"{tmp_path}/store/books").glob("*")))
    name = {k: f"{hashlib.sha256(v).hexdigest()}.pdf" for k, v in data.items()}
    assert seen == [[name[2]], [name[2]], sorted([name[0], name[1], name[2], name[4]])]
    for k in (0, 1, 2, 4):
        assert Path(f"{tmp_path}/store/books/{name[k]}").read_bytes() == data[k]
    got = {x.fingerprint: (x.id[:8], x.name, x.size, x.sha256) for x in library_of(spark, root).collect()}
    print_ = lambda k: hashlib.sha256(data[k]).hexdigest()
    assert got == {print_(k): (f"{k:08d}", f"Book {8 if k == 0 else k}.pdf", 1000 + k, print_(k)) for k in (0, 1, 2, 4)}
