"""Licence scan by ordered signature rules (operator 8), in DataFrame functions only.

A text becomes words joined by one space.  Keywords that occur in it, together with any
match of their rules, admit these rules; only then does a rule meet the text by itself.  A
detection is the interval of words that a
pattern matched.  It is dropped where another one of higher order contains it, or
overlaps it with a higher priority; order is priority, then length, then the rule's place.
Everything happens within a row, so nothing is shuffled, and takes time in proportion to
the text and its matches.

Behaviour: null and empty texts have no words and no labels and score 0; repeated rows
give a row each; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import BASE_PHRASES, Rule, rules

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stand before and after a match; no word holds them, because they separate words.
OPEN, CLOSE = "\x01", "\x02"
SPAN = "array<struct<start:int,end:int>>"
FOUND = "array<struct<start:int,end:int,priority:int,rule_id:int,label:string,weight:double>>"


def _bind(value: Column, use) -> Column:
    """use(value), with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _places(padded: Column, pattern: Column) -> Column:
    """array<struct<start, end>> in words of a pattern's matches, in one pass over the text and one over its words."""
    marked = F.regexp_replace(padded, pattern, F.lit(f"{OPEN}$0{CLOSE}"))

    def read(words):
        numbered = F.transform(words, lambda w, i: F.struct(F.startswith(w, F.lit(OPEN)).alias("opens"), F.endswith(w, F.lit(CLOSE)).alias("closes"), i.alias("i")))
        starts = F.transform(F.filter(numbered, lambda x: x["opens"]), lambda x: x["i"] - 1)
        ends = F.transform(F.filter(numbered, lambda x: x["closes"]), lambda x: x["i"])
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    # a text begins with a space, so its first piece is empty
    return _bind(marked, lambda m: F.when(m == padded, _empty(SPAN)).otherwise(_bind(F.split(m, F.lit(" ")), read)))


def _constant(values: list, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), schema)


def _own(body: str) -> str:
    """A pattern between spaces."""
    return f"(?<= )(?:{body})(?= )"


def license_scan(docs: DataFrame, signature: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    own = rules() if signature is None else signature
    words = sorted({r.keyword for r in own})
    listed = _constant([r._asdict() | {"k": words.index(r.keyword)} for r in own], "array<struct<rule_id:int,label:string,priority:int,k:int,pattern:string,weight:double>>")

    text = F.translate(F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")), UPPER, LOWER)
    df = docs.select("doc_id", F.regexp_replace(text, SEPARATORS, " ").alias("padded"))
    spaces = F.length("padded") - F.length(F.replace("padded", F.lit(" "), F.lit("")))
    # a keyword first, then one pattern for all its rules; both are compiled once
    admits = [F.contains("padded", F.lit(w)) & F.rlike("padded", F.lit("|".join(r.pattern for r in own if r.keyword == w))) for w in words]
    hit = F.filter(F.array(*(F.when(x, F.lit(i)) for i, x in enumerate(admits))), lambda x: x.isNotNull())
    df = df.select("doc_id", "padded", (spaces - 1).cast("long").alias("n_words"), hit.alias("hit"))

    def phrase(p, v):
        named = F.transform(_places(F.col("padded"), F.lit(_own(p))), lambda x: F.struct(F.lit(v).alias("label"), x["start"].alias("start"), x["end"].alias("end")))
        return F.when(F.contains("padded", F.lit(f" {p} ")), named).otherwise(_empty("array<struct<label:string,start:int,end:int>>"))

    base = [phrase(p, v) for p, v in BASE_PHRASES.items()]

    def detect(r):
        return F.transform(_places(F.col("padded"), r["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), r["priority"].alias("priority"), r["rule_id"].alias("rule_id"), r["label"].alias("label"), r["weight"].alias("weight")))

    admitted = F.filter(listed, lambda r: F.array_contains(F.col("hit"), r["k"]))
    found = F.array_sort(F.flatten(F.transform(admitted, detect)))
    df = df.select("doc_id", "n_words", F.concat(*base).alias("bases"), F.when(F.size("hit") > 0, found).otherwise(_empty(FOUND)).alias("found"))

    def better(e, d):
        longer = (e["end"] - e["start"]) - (d["end"] - d["start"])
        return (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & ((longer > 0) | ((longer == 0) & (e["rule_id"] < d["rule_id"]))))

    def undefeated(x):
        def beaten(d, i):
            # at each word one match of a rule begins at most, so what overlaps d lies within this reach of its place
            first = F.greatest(i - x["reach"], F.lit(0))
            near = F.slice(x["found"], first + 1, i + x["reach"] + 1 - first)
            contains = lambda e: (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & better(e, d)
            overlaps = lambda e: (e["start"] < d["end"]) & (e["end"] > d["start"]) & (e["priority"] > d["priority"])
            return F.exists(near, lambda e: (e["rule_id"] != d["rule_id"]) & (contains(e) | overlaps(e)))

        return F.filter(x["found"], lambda d, i: ~beaten(d, i))

    longest = F.array_max(F.transform("found", lambda x: x["end"] - x["start"]))
    reach = longest * F.size(F.array_distinct(F.transform("found", lambda x: x["rule_id"])))
    kept = _bind(F.struct(F.col("found").alias("found"), reach.alias("reach")), undefeated)
    df = df.withColumn("detections", F.when(F.size("found") == 0, _empty(FOUND)).otherwise(kept))
    label = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.transform("bases", lambda x: x["start"])
    return df.select(
        "doc_id",
        "n_words",
        F.size("bases").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(label("bases")).alias("base_labels"),
        joined(F.concat(label("bases"), label("detections"))).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
        "detections",
    )
