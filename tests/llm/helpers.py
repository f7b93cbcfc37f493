"""Small document tables and brute-force versions of the operators."""

from __future__ import annotations

import random

WORDS = [f"w{i}" for i in range(400)]


def corpus(n=60, seed=1):
    """(doc_id, text): prose, copies, near copies, shared passages, nulls, empty and long texts."""
    r = random.Random(seed)
    passage = " ".join(r.choices(WORDS, k=60))
    rows = []
    for i in range(n):
        words = r.choices(WORDS, k=r.randint(1, 120))
        if i % 7 == 3:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        rows.append((i, " ".join(words)))
    for i in range(6):
        words = rows[20][1].split() * 2
        words[r.randrange(len(words))] = f"edit{i}"
        rows.append((n + i, " ".join(words)))
    rows += [(n + 10, rows[5][1]), (n + 11, rows[5][1].upper()), (n + 12, None), (n + 13, ""), (n + 14, " \t\n"), (n + 15, "one"), (n + 16, "One two"), (n + 17, " ".join(r.choices(WORDS, k=9000))), (n + 18, "é ß x " * 30)]
    return rows


SCHEMA = "doc_id long, text string, g int, score string, n double, bucket int, held_out string"


def frame(spark, rows, parts=3):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(*x, 1, "s", 2.0, 3, "h") for x in rows], SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def low(text):
    return (text or "").encode().lower().split()


def subsequence(a, b):
    """Length of the longest common subsequence of two lists."""
    places = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def leaks(rows, items, window=48, lcs=0.6, paraphrase=0.45):
    """Brute force over all windows: documents that hold an item, verbatim or rephrased."""
    out = set()
    for d, text in rows:
        w = low(text)
        for item in items:
            own = low(item)
            tail = low(item.rpartition("?")[2]) if "?" in item else []
            answer = tail or own[-5:]
            for s in range(0, len(w) if own else 0, window // 2):
                around = w[max(0, s - len(own)) : s + window + len(own)]
                if len(set(own) & set(around)) * 8 < len(set(own)):
                    continue
                share = subsequence(own, around) / len(own)
                if share >= lcs or (share >= paraphrase and subsequence(answer, around) / len(answer) >= 0.8):
                    out.add(d)
                    break
            if d in out:
                break
    return out


def components(rows, n, percent):
    """Brute force over all pairs: doc_id -> (set size, component, links)."""
    sets = {}
    for d, t in rows:
        w = low(t)
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), links[d]) for d in sets}


def deduplicated(rows, window=13):
    """Brute force: doc_id -> (words, kept words)."""
    first, out = {}, {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), d) < d:
                gone[i : i + window] = [True] * window
        out[d] = (w, [x for x, y in zip(w, gone, strict=True) if not y])
    return out
