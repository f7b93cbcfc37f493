"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of `documents`.  run() writes each stage's result to the
shared folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, temporary, written
from .decontamination import decontaminate
from .jaccard import jaccard_components
from .packing import best_fit_packing
from .queries import categories, tokenizer_path
from .substrings import deduplicate_substrings
from .toxicity import fit_chain, without


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go.

    Null and empty texts have no features and the model's base rate, far below its threshold
    where toxic labels are few; repeated rows are judged alike; rows with a null doc_id are
    judged by their text; without labels nothing goes; an empty table gives no rows.
    """
    chain = fit_chain(docs, table(spark, sf_dir, "labels"), categories())
    return without(docs, chain, "toxic")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8, the row with the smallest doc_id stays.

    Among rows of one doc_id that are linked, the one with the smaller hash of its text stays;
    rows that share a doc_id and are alike to nothing all stay.  Null and empty texts, and rows
    with a null doc_id, are linked with nothing and stay.  An empty table gives none.
    """
    text, row = F.xxhash64("text"), "_row" + "_" * max(map(len, docs.columns))  # no column of the documents
    with temporary(spark) as kept:
        found = jaccard_components(docs.select("doc_id", "text", text.alias("h")), n=5, percent=80, carry=["h"])
        found, path = written(spark, found.select("doc_id", "node", "h"), "classes")
        kept.append(path)
    first = found.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("k"))
    gone = found.join(first, "node").filter("doc_id IS NOT NULL AND (doc_id <> k.doc_id OR h <> k.h)")
    gone = gone.select(F.col("doc_id").alias(f"{row}d"), F.col("h").alias(f"{row}h")).distinct()
    one = W.partitionBy(F.col("doc_id").cast("long"), row).orderBy(F.lit(0))
    kept = docs.withColumn(row, text)
    kept = kept.join(gone, (F.col("doc_id").cast("long") == F.col(f"{row}d")) & (F.col(row) == F.col(f"{row}h")), "left_anti")
    # the same text twice under one doc_id is one document
    kept = kept.withColumn(f"{row}n", F.row_number().over(one))
    alone = F.col("doc_id").isNull() | (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0)
    return kept.filter((F.col(f"{row}n") == 1) | alone).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that stand in a smaller doc_id's passage of 13 words or more go; so do documents left empty by that.

    Texts that lose nothing stay as they are, null and empty ones among them; rows with a null
    doc_id lose nothing; rows of one doc_id do not remove each other's words.  `n_chars`, if the
    documents have it, follows the text.  An empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", *(F.col(c).alias(f"_x{i}") for i, c in enumerate(rest)))
    left = deduplicate_substrings(plain, with_text=True, carry=[f"_x{i}" for i in range(len(rest))])
    left = left.filter(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words"))))
    kept = {c: F.col(f"_x{i}") for i, c in enumerate(rest)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(kept["n_chars"])
    return left.select(*(kept[c].alias(c) for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or rephrased, go.

    All rows of such a doc_id go, and rows with a null doc_id stay; null and empty texts
    hold no item; without items nothing goes; an empty table gives no rows.
    """
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 ids.

    Null and empty texts are their end id; repeated rows and rows with a null doc_id are
    packed each; further columns are not returned; an empty table gives no rows.
    """
    return best_fit_packing(spark, docs, tokenizer_path("word_bpe_49k.json"), 0, 2048)


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("benchmark leaks", benchmark_leaks), ("packing", packing)]
#: No stage can be told in SQL; tests hold each stage and run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark) as kept:
            docs, path = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(path)
    return STAGES[-1][1](spark, docs, sf_dir)
