"""Boundaries through long documents, and read-through that calls once."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageflow.operators import boundary as Y
from pageflow.operators import translate as P
from pageflow.plans.fixtures import plain_block

WORDS = ["alpha", "beta", "gamma ray", "de,", "(x)", "字文", "書", "ok", " ", "\t", ".", "?”", "é", "12", "\\E", "$1", "[a"]


def one_by_one(pages):
    """Brute force over (document, page, blocks as (kind, text)): each page against what is left of the one before."""
    out, last = {}, None
    carries = lambda b: b[0] in ("paragraph", "caption") and b[1].strip()
    for doc, page, blocks in sorted(pages):
        blocks = list(blocks)
        before = [b for b in last[2] if carries(b)] if last and last[:2] == (doc, page - 1) else []
        first = next((i for i, b in enumerate(blocks) if carries(b)), None)
        removed = ""
        if before and first is not None and before[-1][0] == blocks[first][0]:
            removed = Y.repeated(before[-1][1], blocks[first][1])
        if removed:
            left = blocks[first][1].lstrip()[len(removed) :].lstrip()
            blocks[first : first + 1] = [(blocks[first][0], left)] if left else []
        last = (doc, page, blocks)
        out[doc, page] = (removed, [t for _, t in blocks])
    return out


def reconciled(spark, rows):
    df = spark.createDataFrame(rows, "document_id string, page int, blocks array<struct<kind:string,text:string>>").repartition(5)
    blocks = F.transform("blocks", lambda b: plain_block(b["kind"], b["text"]))
    return {(r.document_id, r.page): (r.removed, [b.text for b in r.blocks]) for r in Y.reconcile(df.select("document_id", "page", blocks.alias("blocks"))).collect()}


def test_repeated_equals_overlap(spark):
    r = random.Random(4)
    pairs = []
    for i in range(3000):
        before = "".join(r.choices(WORDS, k=r.randint(0, 40)))
        start = before[r.randrange(len(before) + 1) :] if r.random() < 0.8 else ""
        pairs.append((i, before, start + "".join(r.choices(WORDS, k=r.randint(0, 6)))))
    pairs += [(3000, "x" * 300, "x" * 300), (3001, "aa" * 70, "aa" * 90), (3002, "", "alpha"), (3003, "alpha beta gamma", ""), (3004, "one two three four", "three four"), (3005, "😀 smile and wave", "😀 smile and wave, all"), (3006, "a 😀 smile and wave", "😀 smile and wave, all")]
    got = spark.createDataFrame(pairs, "i int, a string, b string").select("i", Y.overlap(F.col("a"), F.col("b")).alias("o")).collect()
    want = {i: Y.repeated(a, b) for i, a, b in pairs}
    assert {x.i: x.o for x in got} == want and sum(map(bool, want.values())) > 300


def test_repetition_by_definition():
    """Held against the plain definition for Latin words."""
    assert Y.repeated("of the great river", "the great river flows") == "the great river"
    assert Y.repeated("the great rivers", "the great river") == ""
    assert Y.repeated("the great river.", "the great river") == ""
    assert Y.repeated("in 長江大河", "大河 flows") == "大河"


def documents(seed, n=6, most=60):
    r = random.Random(seed)
    rows = []
    for d in range(n):
        end = ""
        for page in range(1, r.randint(2, most)):
            if r.random() < 0.06:
                continue  # a gap
            blocks = []
            for _ in range(r.choice([0, 1, 1, 1, 1, 1, 2, 3])):
                own = end if r.random() < 0.7 else ""
                text = own + r.choice(["", " "]) + " ".join(r.choices(WORDS, k=r.choice([0, 0, 1, 3, 80])))
                blocks.append((r.choice(["paragraph"] * 5 + ["caption", "heading"]), text))
                end = text[-r.randint(1, 60) :]
            rows.append((f"d{d}", page, blocks))
    return rows


def test_fold_equals_one_by_one(spark):
    rows = [x for seed in range(8) for x in [(f"{seed}{d}", p, b) for d, p, b in documents(seed)]]
    want = one_by_one(rows)
    assert reconciled(spark, rows) == want
    assert sum(bool(x[0]) for x in want.values()) > 40


def test_runs_across_stretches(spark):
    """Short pages, one the repetition of another, on both sides of where a document is cut."""
    rows = [("d", p, [("paragraph", "again and again")]) for p in range(Y.STRETCH - 5, Y.STRETCH + 6)]
    assert reconciled(spark, rows) == one_by_one(rows)
    long = [("e", p, [("paragraph", f"{p - 1} ends this page {'words of it ' * 40} {p} ends this page")]) for p in range(2 * Y.STRETCH - 3, 2 * Y.STRETCH + 4)]
    got = reconciled(spark, long)
    assert got == one_by_one(long) and sum(bool(x[0]) for x in got.values()) == 6


def test_wide_white_space_between_short_texts(spark):
    """A page whose end lies far behind what can be cut, but would be all that is left of it."""
    head = "the same old words " * 7
    rows = [("d", 1, [("paragraph", head)]), ("d", 2, [("paragraph", head[-95:] + " " * 1000 + "short end of it")]), ("d", 3, [("paragraph", "short end of it all")])]
    got = reconciled(spark, rows)
    assert got == one_by_one(rows) and got["d", 2][0] and got["d", 3][0] == "short end of it"


def test_a_long_document_takes_linear_time(spark):
    """100,000 pages that all wait for the one before."""
    def seconds(n):
        df = spark.range(1, n + 1).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("page"), F.array(plain_block("paragraph", F.lit("again and again"))).alias("blocks"))
        began = time.perf_counter()
        kept = Y.reconcile(df).filter("removed = ''").count()
        assert kept == (n + 1) // 2  # every second page vanishes
        return time.perf_counter() - began

    seconds(1000)
    few, many = seconds(10_000), seconds(100_000)
    assert many < 20 * few + 10


class Counted:
    """Notes each call in a file."""

    def __init__(self, path):
        self.path = path

    def translate(self, text, page, total, tail):
        with open(self.path, "a") as f:
            f.write(f"{page}\n")
        own = {"page": page, "blocks": [{"kind": "paragraph", "text": f"{text} {len(tail)}"}]}
        return own | {"previousPageRevision": {"page": page - 1, "blocks": [{"kind": "paragraph", "text": "revised"}]}} if tail else own


def test_each_missing_page_is_asked_for_once(spark, tmp_path):
    pages = spark.createDataFrame([("d", p, f"text {p}", 9) for p in range(1, 10)], "document_id string, page int, text string, total int")
    stored = spark.createDataFrame([("d", 3, '{"blocks":[{"kind":"paragraph","text":"it was kept safely"}]}'), ("d", 4, '{"blocks":[{"kind":"paragraph","text":"kept safely, and on"}],"cacheVersion":7}')], "document_id string, page int, payload string")
    log = tmp_path / "calls"
    batch = P.translate_batch(pages, stored, Counted(str(log)), now_ms=5)
    shown = {r.page: (r.source, r.markdown) for r in batch.pages.collect()}
    writes = {(r.page, r.arrival): (r.payload, r.cache_version) for r in batch.writes.collect()}
    seen = batch.observations.select("observation.pdfPage", "arrival").collect()
    batch.navigation_after().collect()
    assert sorted(log.read_text().split()) == ["1", "2", "5", "6", "7", "8", "9"]
    assert shown[3] == ("cache", "it was kept safely") and shown[4] == ("api", "revised") and shown[5][0] == "api"
    # a stored page that repeats the stored one before it is written back with its own version
    assert writes[4, 5004][1] == 7 and '"text":", and on"' in writes[4, 5004][0] and '"boundaryDeduplicated":true' in writes[4, 5004][0]
    # the revision of page 4 comes with page 5's version
    assert writes[4, 5005][1] == 5005 and '"revised":true' in writes[4, 5005][0] and (3, 5003) not in writes
    assert sorted((r.pdfPage, r.arrival) for r in seen) == sorted([(p, 5000 + p) for p in range(1, 10)] + [(4, 5005)])
    state = batch.translations_after(spark.createDataFrame([], batch.writes.schema)).collect()
    assert {r.page: r.cache_version for r in state} == {1: 5001, 2: 5002, 4: 5005, **{p: 5000 + p for p in range(5, 10)}}


class Queued:
    """Notes each call in a file of its process."""

    def __init__(self, path):
        self.path = path

    def translate(self, text, page, total, tail):
        from pyspark import TaskContext

        with open(f"{self.path}/{TaskContext.get().partitionId()}", "a") as f:
            f.write(f"{page}\n")
        return {"page": page, "blocks": []}


def test_calls_are_bounded_queues(spark, tmp_path):
    pages = spark.range(1, 200).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("page"), F.lit("t").alias("text"), F.lit(200).alias("total"), F.lit("").alias("tail")).repartition(9)
    none = spark.createDataFrame([], "document_id string, page int, payload string")
    assert P.translate_missing(pages, none, Queued(str(tmp_path)), 3).count() == 199
    queues = [[int(x) for x in f.read_text().split()] for f in tmp_path.iterdir()]
    assert len(queues) == 3 and all(q == sorted(q) for q in queues) and sorted(sum(queues, [])) == list(range(1, 200))


@settings(max_examples=200, deadline=None)
@given(st.text("ab c.字", max_size=30), st.text("ab c.字", max_size=30))
def test_repetition_is_an_end_and_a_start(a, b):
    own = Y.repeated(a, b)
    assert a.rstrip().endswith(own) and b.lstrip().startswith(own) and len(own) <= Y.LONGEST
