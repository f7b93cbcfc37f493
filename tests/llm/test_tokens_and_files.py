"""Operators 2, 5 and 9: token counts, Simple-8b files, packing."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from pageflow.llm.binary_output import BLOCK, decode_block, decode_file, encode_file, pack, read_token_files, simple8b_round_trip, unpack, write_token_files
from pageflow.llm.packing import best_fit_packing, plan_packing
from pageflow.llm.queries import tokenizer_path
from pageflow.llm.token_counts import count_documents, file_name, flat_file_blocks, separator_scan, stitch, write_flat_files
from pageflow.llm.tokens import Encoder

from .helpers import corpus, empty, frame

TEXTS = ["", "a \x1c b", "  two  spaces\n\n x y  z", "<|endoftext|> hi's we'LL don't 12ab", "x\n", "\n", "é ́a Σας ΣΑΣ İ", "word,word. (word)  　x", "tab\tand\r\nline"] + [t or "" for _, t in corpus()]


ENCODERS, FRESH = {}, {}
NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library_ids(name, texts):
    """Ids by a tokenizer that nothing else has touched."""
    fresh = FRESH.get(name) or FRESH.setdefault(name, Tokenizer.from_file(tokenizer_path(name)))
    return [np.asarray(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_cached_pieces_give_the_librarys_ids(name):
    e = Encoder(tokenizer_path(name), most=50)
    assert e.encode(TEXTS) == library_ids(name, TEXTS) == e.encode(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "  ", "\n", "a", "Word", "it's", "12", "é", "\x1c", ".", "<"]), max_size=12).map("".join), max_size=6))
def test_added_tokens_are_the_librarys(texts):
    for name in NAMES:
        assert ENCODERS.setdefault(name, Encoder(tokenizer_path(name))).encode(texts) == library_ids(name, texts)


LETTERS = [chr(c) for c in range(0x250) if chr(c).isalpha()]


@pytest.mark.parametrize("name", NAMES)
def test_every_letter_before_every_mark(name):
    """Letters whose lower case is more than one character among them."""
    e = Encoder(tokenizer_path(name))
    ends = [*".,;:!?", " ", "\n", "\t", "", "...", ".x", " x", "'s", "\u0301"]
    texts = [f"{before}{c}{end}" for c in LETTERS for end in ends for before in ("", "a", "ab ")]
    assert e.encode(texts) == library_ids(name, texts)
    turkish = "İstanbul'da, İ. İnönü! DİYARBAKIR; İ... sİ? Iı İ"
    assert e.encode([turkish]) == library_ids(name, [turkish])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from([*"aİıIéßŉǰ ", *".,;:!?\n"]), max_size=14), max_size=5))
def test_mixed_letters_and_marks(texts):
    for name in NAMES:
        assert ENCODERS.setdefault(name, Encoder(tokenizer_path(name))).encode(texts) == library_ids(name, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**16), st.integers(0, 2**64 - 1)), max_size=700), st.sampled_from([1, 7, 256]))
def test_simple8b_round_trip(codes, block):
    words, escapes, first, _ = pack(np.array(codes, np.uint64), block)
    assert unpack(words, escapes).tolist() == codes
    assert len(first) == -(-len(codes) // block)


def test_simple8b_packs_small_ids():
    words, escapes, _, _ = pack(np.ones(6000, np.uint64), 6000)
    assert len(words) == 100 and not len(escapes)


def test_file_and_single_blocks():
    ids = np.random.default_rng(1).integers(0, 50000, 2000).astype(np.uint32)
    data = b"".join(encode_file(ids, [3, None], [1500, 500]))
    got, docs, lengths = decode_file(data)
    assert (got == ids).all() and docs == [3, None] and lengths.tolist() == [1500, 500]
    assert (decode_block(data, 3) == ids[3 * BLOCK : 4 * BLOCK]).all()
    wide = np.array([2**40, 5, 2**40], np.uint64)
    assert decode_file(b"".join(encode_file(wide, [1], [3])))[0].tolist() == wide.tolist()


def test_simple8b_files(spark, tmp_path):
    rows = corpus() + [(None, "no id"), (3, "again"), (2, "two <|endoftext|> ends")] + [(1000 + i, f"more {i}") for i in range(1200)]
    docs = frame(spark, rows)
    want: dict = {}
    for (d, _), ids in zip(rows, library_ids("byte_bpe_50k.json", [t or "" for _, t in rows]), strict=True):
        ids += np.array([2], "<u4").tobytes()
        want.setdefault(d, []).append((len(ids) // 4, zlib.crc32(ids)))
    for tasks in (1, 5):
        files = write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/{tasks}", text_mb=0.01, tasks=tasks)
        assert files.count() > 1
        got, start, found = read_token_files(files).orderBy("start").collect(), 0, {}
        for r in got:
            assert r.start == start
            start += r.n_tokens
            found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
        assert {d: sorted(x) for d, x in found.items()} == {d: sorted(x) for d, x in want.items()}
        assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert simple8b_round_trip(spark, empty(spark), tokenizer_path("byte_bpe_50k.json"), 2).count() == 0


def simple_best_fit(lengths, capacity):
    """One by one: large items in greedy pairs, then best fit."""
    left = sorted((x for x in lengths if 3 * x > capacity), reverse=True)
    gaps = []
    while left:
        a = left.pop(0)
        b = next((x for x in left if x <= capacity - a), None)
        if b:
            left.remove(b)
        gaps.append(capacity - a - (b or 0))
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        gaps.append(capacity) if fit is None else None
        gaps.remove(capacity if fit is None else fit)
        gaps.append((capacity if fit is None else fit) - x)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120))
def test_plan_equals_one_by_one(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    taken, seen = {}, dict.fromkeys(counts, 0)
    for length, first, n, at, each, offset in plan_packing(counts, 40):
        assert first == seen[length]
        seen[length] += n
        for k in range(n):
            taken.setdefault(at + k // each, []).append((offset + k % each * length, length))
    assert seen == counts
    for own in taken.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 40
        assert sum(3 * x > 40 for _, x in own) <= 2
    assert len(taken) == simple_best_fit(lengths, 40)


def test_packing(spark):
    rows = corpus() + [(4, corpus()[4][1]), (None, "no id"), (2, "two <|endoftext|> ends")]
    got = best_fit_packing(spark, frame(spark, rows), tokenizer_path("word_bpe_49k.json"), 0, 64).collect()
    ids = library_ids("word_bpe_49k.json", [t or "" for _, t in rows])
    want = []
    for (d, _), x in zip(rows, ids, strict=True):
        x += bytes(4)
        want += [(d, k // 256, k // 4, len(x[k : k + 256]) // 4, zlib.crc32(x[k : k + 256])) for k in range(0, len(x), 256)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((key(r[:5]) for r in got)) == sorted(map(key, want))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 64 + 1
    assert best_fit_packing(spark, empty(spark), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_scan_counts(spark, tmp_path):
    rows = corpus() + [(None, "no id"), (None, None), (3, "again"), (3, "again"), (4, ""), (900, "é" * 60_000)]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens) for r in count_documents(frame(spark, rows), rounds=3, file_mb=0.02, block_mb=0.001).collect())
    assert got == sorted((-1 if d is None else d, len((t or "").encode()) + 1) for d, t in rows)
    assert count_documents(empty(spark)).count() == 0
    write_flat_files(frame(spark, rows[:9]), f"file://{tmp_path}", 2)
    ids = [np.fromfile(tmp_path / file_name(f), "<u2") for f in range(2)]
    assert sum(len(x) for x in ids) == sum(len(t.encode()) + 1 for _, t in rows[:9])
    assert sorted(bytes((x[x > 1] - 3).astype(np.uint8).tolist()) for f in ids for x in np.split(f, np.flatnonzero(f == 1) + 1)[:-1]) == sorted(t.encode() for _, t in rows[:9])


def test_scan_of_flat_files(spark, tmp_path):
    a, b = np.array([5, 6, 0, 0, 7, 0, 8], "<u4"), np.array([1, 2, 3], "<u4")
    (tmp_path / "a.bin").write_bytes(a.tobytes())
    (tmp_path / "b.bin").write_bytes(b.tobytes())
    (tmp_path / "c.bin").write_bytes(b"")
    blocks = flat_file_blocks(spark, f"file://{tmp_path}", 4, block_mb=8e-6)
    assert blocks.filter("file LIKE '%a.bin'").count() == 4
    got = sorted((r.file[-5:], r.ordinal, r.start, r.n_tokens, r.ended) for r in separator_scan(blocks, 0, 4).collect())
    assert got == [("a.bin", 0, 0, 3, True), ("a.bin", 1, 3, 1, True), ("a.bin", 2, 4, 2, True), ("a.bin", 3, 6, 1, False), ("b.bin", 0, 0, 3, False)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 9))
def test_stitch(spark, ids, size):
    cuts = [ids[i : i + size] for i in range(0, len(ids), size)]
    rows = [("f", k, len(c), [i for i, x in enumerate(c) if x == 0]) for k, c in enumerate(cuts)]
    got = [(r.start, r.n_tokens, r.ended) for r in stitch(spark.createDataFrame(rows, "file string, block long, size long, places array<long>")).orderBy("ordinal").collect()]
    want, start = [], 0
    for i, x in enumerate(ids):
        if x == 0:
            want.append((start, i + 1 - start, True))
            start = i + 1
    assert got == want + ([(start, len(ids) - start, False)] if start < len(ids) else [])


def test_new_words_are_not_cut_again():
    """Words of letters go to the library's model at once; its pattern sees other pieces only, and the ids are the library's."""
    enc = Encoder(tokenizer_path(NAMES[0]))
    seen = []

    class Watched:
        model = enc.tok.model

        def encode_batch_fast(self, texts, **kw):
            seen.extend(texts)
            return whole.encode_batch_fast(texts, **kw)

    whole, enc.tok = enc.tok, Watched()
    texts = ["Über straße naïvely zzqx, nothing", " Ǆ ɏx İs it's 12ab", "a" * 3000 + " b", "", "été́ ſ\nword"]
    got = enc.encode(texts)
    assert got == [np.array(x.ids, "<u4").tobytes() for x in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert not any(w in t for t in seen for w in ("Über", "straße", "naïvely", "zzqx", "nothing", "aaa")) and any("12ab" in t for t in seen)


def test_words_learned_together_have_the_librarys_ids():
    """Words of letters whose bytes have other names, long and short, with and without a space, some of them twice as long as others."""
    path = tokenizer_path("byte_bpe_50k.json")
    words = [f"{space}{a}{b}" for space in ("", " ") for a in ("a", "É", "ñandú", "thing" * 40, "ÿ") for b in ("", "x", "ığ", "À" * 9, *(chr(97 + i % 26) * (i // 26 + 1) for i in range(200)))]
    enc = Encoder(path)
    got = enc._words(words)
    assert len(enc.plain.encode("aĊb").ids) == 2  # parted where the line feed's letter stands
    assert got == enc._whole(words)


def test_texts_go_to_python_in_small_batches(spark):
    """Whole batches of 10,000 texts lay in the buffers of two tasks; so few rows do now, and the session's own setting stays."""
    from pageflow.llm.common import small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark, 100):
        sizes = spark.range(0, 1000, numPartitions=1).mapInArrow(lambda bs: (__import__("pyarrow").RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert max(r.n for r in sizes) == 100
    assert spark.conf.get(name) == before
