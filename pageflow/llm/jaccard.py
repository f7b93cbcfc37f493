"""N-gram Jaccard join by vertical partitioning (operator 6).

A document is the set of its distinct word n-grams, as 64-bit hashes.  N-grams have one
global order: by the number of documents that hold them, rare ones first.

0. Portions of documents send their distinct n-grams, as sorted segments by hash range, to
   be counted over the corpus, and get the counts back in the same order.
1. Documents with equal sets (in size and 128 bits of signature) form a class, which stands
   for them from here on.
2. Two sets that are similar enough share one of their first n - ceil(t n) + 1 n-grams in
   the global order; n-grams of one document only match nothing.  Classes are dealt to blocks
   of bounded size, those that share such n-grams together.  Pairs of blocks whose classes
   share one, with sizes that can be similar, are compared; no others can hold a link.
3. The global order is cut into fragments.  Each pair of blocks is a group of the shuffle;
   its fragments' partial overlaps are counted one fragment after another, summed for each pair
   of classes in a matrix of bounded size, and tested.  What comes back is a spanning forest of
   the links and each class's number of links, so rows follow the classes, not their pairs.
4. Components of these links are the result.

The order only decides what is cheap; results are exact for any counts.

Behaviour: texts with fewer words than n have the whole sequence as their only n-gram;
null and empty texts, and texts without words, have an empty set, link with nothing and
are their own component; each row counts as a document, also where doc_ids repeat; a
null doc_id links with nothing and has a null component; an empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, hash_words, mix64, new_folder, released, rolling, tidy, utf8, width, written
from .graph import connected_components
from .portions import bucket_count, bucket_cuts, keep_portion, portion_id, portions, read_portion, row_ids
from .substrings import read_segment, write_segment

#: Counts above this are equal in the order; what a class costs a block besides its n-grams.
MANY, ROW = 65535, 150


def shingle_sets(docs: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document, sorted, one document after the other, and the set sizes."""
    words, counts = hash_words(docs)
    doc = np.repeat(np.arange(len(docs)), counts)
    grams = rolling(words, n)
    own = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :]) if len(grams) else np.empty(0, np.int64)
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = np.array([rolling(words[first[i] : first[i] + counts[i]], int(counts[i]))[0] ^ np.uint64(counts[i]) for i in short.tolist()], np.uint64)
    h, d = np.concatenate((grams[own], whole)), np.concatenate((doc[own], short))
    order = np.argsort(h)
    order = order[np.argsort(d[order].astype(np.min_scalar_type(len(docs))), kind="stable")]
    h, d = h[order], d[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))[: len(h)]
    return h[new], np.bincount(d[new], minlength=len(docs))


def _sets(texts: list[bytes], n):
    for first, part in chunks(x.lower() for x in texts):
        h, sizes = shingle_sets(part, n)
        yield first, h, sizes


def _distinct(texts: list[bytes], n) -> tuple[np.ndarray, np.ndarray]:
    """A group's distinct n-grams in order, and how many of its documents hold each."""
    parts = [np.unique(h, return_counts=True) for _, h, _ in _sets(texts, n)]
    h, c = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
    values, at = np.unique(h, return_inverse=True)
    return values, np.bincount(at, c, len(values)).astype(np.int64)


def document_counts(docs: DataFrame, n: int, portion_mb: float) -> tuple[DataFrame, str]:
    """(g, bucket, counts): for each portion's n-grams, in order, how many documents of the corpus hold them; the portions' folder."""
    spark = docs.sparkSession
    buckets, texts = bucket_count(spark), new_folder(spark, "portions")

    @tidy
    def send(batches):
        import pyarrow as pa

        for k, t in enumerate(portions(batches, 1, portion_mb * 1e6)):
            g = portion_id(k)
            keep_portion(texts, g, t)
            h, c = _distinct(utf8(t.column(1)), n)
            cuts = bucket_cuts(h, buckets)
            own = [b for b in range(buckets) if cuts[b] < cuts[b + 1]] or [0]  # each portion gets an answer
            grams = [write_segment(h[cuts[b] : cuts[b + 1]], c[cuts[b] : cuts[b + 1]]) for b in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([g] * len(own), pa.int64()), pa.array(grams, pa.binary())], names=["bucket", "g", "grams"])

    @released
    def count(t):
        import pyarrow as pa

        parts = [read_segment(x) for x in t.column("grams").to_pylist()]
        h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")  # sorted segments, which this sort merges
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))[: len(h)])
        total = np.minimum(np.add.reduceat(c, first) if len(first) else c, MANY).astype(np.uint16)
        back = np.empty(len(order), np.uint16)
        back[order] = np.repeat(total, np.diff(np.append(first, len(h))))
        ends = np.cumsum([0] + [len(x[0]) for x in parts])
        codec = pa.Codec("zstd")
        counts = [codec.compress(back[a:b].tobytes(), asbytes=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"g": t.column("g"), "bucket": t.column("bucket"), "counts": pa.array(counts, pa.binary()), "size": pa.array(np.diff(ends))})

    sent = docs.mapInArrow(send, "bucket int, g long, grams binary")
    return sent.groupBy("bucket").applyInArrow(count, "g long, bucket int, counts binary, size long"), texts


def prefixes(docs: DataFrame, n: int, percent: int, portion_mb: float) -> DataFrame:
    """A row for each of `docs` (doc_id, text, ...): row, doc_id, n_shingles, two signatures of the set, the shared n-grams
    among its first ones in the global order, and, if there are any, all its shared n-grams with their counts."""
    counts, texts = document_counts(docs, n, portion_mb)
    more = docs.schema.fields[2:]

    @released
    def cut(back):
        import pyarrow as pa

        codec, g = pa.Codec("zstd"), back.column("g")[0].as_py()
        lists = sorted(zip(*(back.column(c).to_pylist() for c in ("bucket", "counts", "size")), strict=True))
        df = np.concatenate([np.frombuffer(codec.decompress(c, 2 * k, asbytes=True), np.uint16) for _, c, k in lists])
        t = read_portion(texts, g)
        raw = utf8(t.column(1))
        grams, _ = _distinct(raw, n)
        out = []
        for first, h, sizes in _sets(raw, n):
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            own = df[np.searchsorted(grams, h)]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            shared = np.bincount(doc, own > 1, len(sizes)).astype(np.int64)
            take = sizes - -(-percent * sizes // 100) + 1 - (sizes - shared)  # of the shared ones, after those of one document
            few = np.flatnonzero((take > 0) & (sizes > 0))
            pre, tok = [None] * len(sizes), [None] * len(sizes)
            for i in few.tolist():
                x, c = h[cuts[i] : cuts[i + 1]], own[cuts[i] : cuts[i + 1]]
                x, c = x[c > 1], c[c > 1]
                order = np.lexsort((x, c))
                pre[i] = x[order[: take[i]]].view(np.int64)
                tok[i] = x[order].tobytes() + c[order].tobytes()
            some = np.concatenate((h, np.zeros(1, np.uint64)))
            sums = [np.where(sizes > 0, np.add.reduceat(f(some), np.minimum(cuts[:-1], len(h))), 0).astype(np.uint64).view(np.int64) for f in (mix64, lambda x: mix64(x ^ np.uint64(0x5851F42D4C957F2D)))]
            rows = [pa.array(row_ids(g, first, len(sizes))), t.column(0).slice(first, len(sizes)), pa.array(sizes.astype(np.int64)), *map(pa.array, sums), pa.array(pre, pa.list_(pa.int64())), pa.array(tok, pa.binary())]
            out.append(pa.table([*rows, *(t.column(2 + i).slice(first, len(sizes)) for i in range(len(more)))], names=["row", "doc_id", "n_shingles", "s1", "s2", "prefix", "tokens", *(f.name for f in more)]))
        return pa.concat_tables(out)

    schema = "row long, doc_id long, n_shingles long, s1 long, s2 long, prefix array<long>, tokens binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more)
    return counts.groupBy("g").applyInArrow(cut, schema)


def add_overlaps(total: np.ndarray, left, right, cells: int = 1 << 22) -> None:
    """Add to `total` how many of a fragment's n-grams each two sets share.

    A side is the sets' places in `total`, their sizes, and their n-grams one set after the
    other.  Without `right`, both are the left ones, and a set meets itself too.
    """
    places, sizes, grams = (np.concatenate(x) for x in zip(left, *([right] if right is not None else []), strict=True))
    rows = len(left[0])
    side = np.repeat(np.arange(len(places)), sizes)
    _, at, times = np.unique(grams, return_inverse=True, return_counts=True)
    own = times[at] > 1
    rank = np.cumsum(times > 1) - 1
    side, at, n = side[own], rank[at[own]], int((times > 1).sum())
    order = np.argsort(at, kind="stable")
    side, at = side[order], at[order]
    i, j = places[:rows], places[rows:] if right is not None else places
    step = max(1, cells // max(1, len(places)))  # far below 2**24, so sums of ones in float32 are exact
    for low in range(0, n, step):
        x, y = np.searchsorted(at, (low, low + step))
        m = np.zeros((len(places), min(step, n - low)), np.float32)
        m[side[x:y], at[x:y] - low] = 1
        total[np.ix_(i, j)] += (m[:rows] @ (m[rows:] if right is not None else m).T).astype(total.dtype)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of links; each node's row is looked at once."""
    left = np.ones(len(linked), bool)
    edges = []
    for start in range(len(linked)):
        if left[start]:
            left[start] = False
            queue = [start]
            for x in queue:
                new = np.flatnonzero(linked[x] & left)
                left[new] = False
                edges += [(x, y) for y in new.tolist()]
                queue += new.tolist()
    return edges


def bipartite(linked: np.ndarray) -> list[tuple[int, int]]:
    """The same between rows and columns; columns are numbered after the rows."""
    rows, cols = linked.shape
    back = np.ascontiguousarray(linked.T)
    free = [np.ones(rows, bool), np.ones(cols, bool)]
    edges = []
    for start in np.flatnonzero(linked.any(axis=1)).tolist():
        if free[0][start]:
            free[0][start] = False
            queue = [(0, start)]
            for side, x in queue:
                new = np.flatnonzero((back if side else linked)[x] & free[1 - side])
                free[1 - side][new] = False
                edges += [(x + rows * side, y + rows * (1 - side)) for y in new.tolist()]
                queue += [(1 - side, y) for y in new.tolist()]
    return edges


def _rows(batches):
    """Rows one after another; one at a time becomes Python's, lists of numbers stay arrays."""
    for b in batches:
        lists = [str(c.type).startswith("list") for c in b.columns]
        for k in range(b.num_rows):
            yield tuple((None if not c[k].is_valid else c[k].values.to_numpy()) if own else c[k].as_py() for c, own in zip(b.columns, lists, strict=True))


def _by_key(batches, n_key: int):
    """(key, rows) of rows that come sorted by their first `n_key` columns; rows stream through, none is held."""
    for key, rows in groupby(_rows(batches), lambda r: r[:n_key]):
        yield key, (r[n_key:] for r in rows)


def blocks_of(named: DataFrame, tokens: int) -> DataFrame:
    """(rep, block): classes dealt to blocks of about `tokens` n-grams, those with the same hub and like sizes together.

    Classes are sorted by ranges of (hub, size, rep), so a hub that a third of all classes
    share is spread over tasks; what lies before in a hub is summed within each task and then
    over the tasks that hold a part of the hub.
    """
    spark = named.sparkSession
    ordered = named.repartitionByRange(width(spark), "hub", "n", "rep").sortWithinPartitions("hub", "n", "rep")

    @tidy
    def add(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, before, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            rep, hub, n = (b.column(i).to_numpy() for i in range(3))
            size = n + ROW
            sums = np.cumsum(size)
            first = np.flatnonzero(np.concatenate(([True], hub[1:] != hub[:-1])))[: len(hub)]
            base = np.repeat(sums[first] - size[first], np.diff(np.append(first, len(hub))))
            cum = sums - size - base + np.where(hub == last, before, 0) if len(hub) else sums
            if len(hub):
                before, last = int(cum[-1] + size[-1]), hub[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rep, hub, np.full(len(rep), part), cum, size)], names=["rep", "hub", "part", "cum", "size"])

    rows, _ = written(spark, ordered.select("rep", "hub", "n").mapInArrow(add, "rep long, hub long, part long, cum long, size long"), "ordered")
    earlier = W.partitionBy("hub").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shift = rows.groupBy("hub", "part").agg(F.sum("size").alias("v")).select("hub", "part", F.coalesce(F.sum("v").over(earlier), F.lit(0)).alias("shift"))
    place = F.floor((F.col("cum") + F.col("shift")) / tokens)
    return rows.join(shift, ["hub", "part"]).select("rep", F.xxhash64("hub", place).alias("block"))


def block_pairs(shared: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(a, b), a <= b: blocks with classes that share a prefix n-gram and have sizes that can be similar."""
    held = shared.join(placed.select("rep", "block"), "rep").groupBy("token", "block").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low"), F.max("n").alias("high"))
    other = held.select("token", F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    fit = (F.col("high") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low") * percent)
    met = held.join(other, "token").filter((F.col("block") < F.col("b")) & fit).select(F.col("block").alias("a"), "b")
    return met.unionByName(held.filter("k > 1").select(F.col("block").alias("a"), F.col("block").alias("b"))).distinct()


def block_fragments(sets: DataFrame, fragments: int) -> DataFrame:
    """(block, fragment, reps, sizes, grams): the n-grams of a block's classes, cut into fragments of the global order.

    A fragment is one range of hashes among the n-grams of like counts.  A row holds one
    fragment of all classes of a block, so it is bounded as the block is; each class is cut
    once, however many other blocks its own one meets.
    """

    @tidy
    def pack(batches):
        import pyarrow as pa

        for (block,), rows in _by_key(batches, 1):
            rows = list(rows)
            k = [len(data) // 10 for _, data in rows]
            grams = np.concatenate([np.frombuffer(data, np.uint64, n) for n, (_, data) in zip(k, rows, strict=True)])
            counts = np.concatenate([np.frombuffer(data, np.uint16, n, 8 * n) for n, (_, data) in zip(k, rows, strict=True)])
            reps, own = np.array([rep for rep, _ in rows], np.int64), np.repeat(np.arange(len(rows)), k)
            level = np.frexp(counts.astype(np.float64) - 1)[1].astype(np.int64)
            part = level * fragments + (((grams >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((grams, own, part))
            values, first = np.unique(part[order], return_index=True)
            for f, at in zip(values.tolist(), np.split(order, first[1:]), strict=True):
                held, sizes = np.unique(own[at], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.array([f], pa.int32()),
                        pa.array([reps[held]], pa.list_(pa.int64())),
                        pa.array([sizes], pa.list_(pa.int64())),
                        pa.array([grams[at].tobytes()], pa.binary()),
                    ],
                    names=["block", "fragment", "reps", "sizes", "grams"],
                )

    rows = sets.select("block", "rep", "tokens").repartition(width(sets.sparkSession), "block").sortWithinPartitions("block", "rep")
    return rows.mapInArrow(pack, "block long, fragment int, reps array<long>, sizes array<long>, grams binary")


def _sides(pairs: DataFrame) -> DataFrame:
    """(a, b, block, side): each pair of blocks with the one and, if they differ, the other."""
    first, second = (pairs.select("a", "b", F.col(x).alias("block"), F.lit(k).alias("side")) for k, x in enumerate("ab"))
    return first.unionByName(second.filter("a <> b"))


def links_of(cut: DataFrame, placed: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(u, v, links): spanning edges of the links of each pair of blocks, and rows (u, u, links) with how many rows u links with there.

    A pair of blocks is a group of the shuffle.  Its fragments come one after another; each
    one's partial overlaps are counted by themselves and added to a matrix of the pair's
    classes, which is bounded as blocks are (a class costs ROW at least).  No list of pairs is
    made: what leaves the task is a forest and a number for each class, however many links there are.
    """
    sides = _sides(pairs)
    none = F.lit(None)
    members = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("rep", "size", "copies"))).alias("m"))
    members = sides.join(members, "block").select("a", "b", F.lit(-1).alias("fragment"), "side", F.col("m.rep").alias("reps"), F.col("m.size").alias("sizes"), F.col("m.copies").alias("copies"), none.cast("binary").alias("grams"))
    jobs = sides.join(cut, "block").select("a", "b", "fragment", "side", "reps", "sizes", none.cast("array<long>").alias("copies"), "grams")
    rows = members.unionByName(jobs).repartition(width(placed.sparkSession), "a", "b").sortWithinPartitions("a", "b", "fragment", "side")

    def counted(a, b, own):
        """The members of both sides and the overlaps of their sets, fragment by fragment."""
        known, waiting = {}, {}
        total = None
        for fragment, side, reps, sizes, copies, grams in own:
            if fragment < 0:
                known[side] = [np.asarray(x, np.int64) for x in (reps, sizes, copies)]
                continue
            if total is None:
                total = np.zeros((len(known[0][0]), len(known[0 if a == b else 1][0])), np.int32)
            held = np.searchsorted(known[side][0], reps), np.asarray(sizes, np.int64), np.frombuffer(grams, np.uint64)
            if a == b:
                add_overlaps(total, held, None)
            elif side == 0:
                waiting = {fragment: held}
            elif fragment in waiting:
                add_overlaps(total, waiting.pop(fragment), held)
        return known, total

    @tidy
    def link(batches):
        import pyarrow as pa

        for (a, b), own in _by_key(batches, 2):
            known, total = counted(a, b, own)
            if total is None or not total.any():
                continue
            (ids, sizes, copies), (other, sizes_b, copies_b) = known[0], known[0 if a == b else 1]
            linked = np.empty(total.shape, bool)
            for at in range(0, len(total), 256):
                n = total[at : at + 256].astype(np.int64)
                linked[at : at + 256] = 100 * n >= percent * (sizes[at : at + 256, None] + sizes_b[None, :] - n)
            linked &= total > 0
            if a == b:
                np.fill_diagonal(linked, False)
                edges, names, degree = spanning(linked), ids, linked @ copies
            else:
                edges, names = bipartite(linked), np.concatenate((ids, other))
                degree = np.concatenate((linked @ copies_b, linked.T @ copies))
            some = np.flatnonzero(degree)
            u, v = np.array(edges, np.int64).reshape(-1, 2).T
            columns = [np.concatenate((names[u], names[some])), np.concatenate((names[v], names[some])), np.concatenate((np.zeros(len(u), np.int64), degree[some]))]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["u", "v", "links"])

    return rows.mapInArrow(link, "u long, v long, links long")


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, block: int = 300_000, portion_mb: float = 8, fragments: int = 4, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row; `node` is the same number for the rows of a component and no others.

    `carry` adds other columns of `docs`.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry or [])))
    rows, _ = written(spark, prefixes(own, n, percent, portion_mb), "prefixes")
    some = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("s1", "s2", "n_shingles").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("prefix").alias("prefix"), F.first("tokens").alias("tokens"))
    classes, _ = written(spark, classes, "classes")

    shared = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("prefix").alias("token"))
    hubs = shared.groupBy("token").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub <> last").select("token", "hub")
    shared, _ = written(spark, shared.join(hubs, "token"), "shared")
    named = shared.groupBy("rep", "n").agg(F.min("hub").alias("hub"))
    placed = blocks_of(named, block).join(classes.select("rep", F.col("n_shingles").alias("size"), "copies", "tokens"), "rep")
    placed, _ = written(spark, placed, "sets")
    pairs, _ = written(spark, block_pairs(shared, placed, percent), "pairs")
    cut, _ = written(spark, block_fragments(placed, fragments), "fragments")
    links, _ = written(spark, links_of(cut, placed, pairs, percent), "links")

    joined = connected_components(links.filter("u <> v").select("u", "v"))
    degrees = links.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    found = classes.select("s1", "s2", "n_shingles", "rep", "least", "copies").join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(degrees, "rep", "left")
    found = found.withColumn("node", F.coalesce("component", "rep"))
    smallest = found.filter("component IS NOT NULL").groupBy("node").agg(F.min("least").alias("smallest"))
    found = found.join(smallest, "node", "left").select("s1", "s2", "n_shingles", "node", F.coalesce("smallest", "least").alias("smallest"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = rows.drop("prefix", "tokens").join(found.hint("shuffle_merge"), ["s1", "s2", "n_shingles"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
        F.when(alone, F.col("row")).otherwise(F.col("node")).alias("node"),
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry or [])),
    )
