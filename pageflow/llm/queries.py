"""The operators bound to the tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_trees import context_tree_scores

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return context_tree_scores(table(spark, sf_dir, "documents"), held_out)


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from real flat files of byte-level ids without an index."""
    from .token_counts import count_documents

    return count_documents(table(spark, sf_dir, "documents"))


OP2_SQL = "SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS n_tokens FROM documents"


def categories() -> dict:
    """The chain's categories over `labels`, in order."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), categories())


def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary_output import simple8b_round_trip

    return simple8b_round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2)


def op6_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op7_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import forest_search

    return forest_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 0, 2048)


def op10_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import deduplicate_substrings

    return deduplicate_substrings(table(spark, sf_dir, "documents"))


SHARDS = 40


def op11_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 equal shards, and where each lies once a further one joins."""
    from .sharding import equal_shards, shard_slots

    return shard_slots(table(spark, sf_dir, "documents"), equal_shards(SHARDS), SHARDS)


#: CRC-32 a bit at a time: each byte is followed by seven empty steps.
OP11_SQL = """WITH x AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
b AS (SELECT doc_id, k, CAST(strlen(t) + 16 AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: [CAST('0x' || h AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
 lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), CAST(4294967295 AS BIGINT)) AS crc FROM x),
d AS (SELECT *, list_transform(range(0, 11), lambda g: md5(k || ':' || g)) AS m FROM b),
e AS (SELECT *, list_transform(range(0, 41), lambda s: substr(m[s // 4 + 1], s % 4 * 8 + 1, 8)) AS v FROM d),
f AS (SELECT *, CAST(list_position(v[1:40], list_max(v[1:40])) - 1 AS INTEGER) AS shard FROM e)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || ':' || size || ':' || crc), 1, 3), doc_id NULLS FIRST, size, crc) - 1 AS slot,
 CASE WHEN v[41] > list_max(v[1:40]) THEN 40 ELSE shard END AS grown_shard FROM f"""


def op12_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .yinyang import cluster_digest, kmeans

    return cluster_digest(spark, *kmeans(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64)).drop("scanned")


def op12_sql(rounds: int = 5, k: int = 40) -> str:
    """Full scans: a table of assignments and one of centroids for each round."""
    nearest = "SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT e.vec_id, e.v, c.c, list_sum(list_transform(e.v, lambda x, i: (x - c.v[i]) * (x - c.v[i]))) AS d FROM e, c{r} c) GROUP BY ALL"
    out = f"""WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, v FROM (SELECT v, sha256('2:' || vec_id) AS h FROM e ORDER BY h LIMIT {k}))"""
    for r in range(rounds):
        out += f""",
a{r} AS MATERIALIZED ({nearest.format(r=r)}),
s{r} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL),
m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (c))"""
    return f"""{out},
a AS MATERIALIZED ({nearest.format(r=rounds)})
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c USING (c)"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine_hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


OP13_SQL = """WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, CAST(list_sum(list_transform(a.v, lambda x, i: x * e.v[i])) AS BIGINT) AS score FROM e a, e WHERE a.vec_id % 50 = 0 AND e.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3"""


QUERIES = {
    "op1_context_trees": op1_context_trees,
    "op2_separator_scan": op2_separator_scan,
    "op3_toxicity_chain": op3_toxicity_chain,
    "op4_latent_decontamination": op4_latent_decontamination,
    "op5_simple8b": op5_simple8b,
    "op6_vertical_jaccard": op6_vertical_jaccard,
    "op7_projection_forest": op7_projection_forest,
    "op8_license_scan": op8_license_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_fingerprint_index": op10_fingerprint_index,
    "op11_rendezvous_shards": op11_rendezvous_shards,
    "op12_yinyang": op12_yinyang,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {"op2_separator_scan": OP2_SQL, "op11_rendezvous_shards": OP11_SQL, "op12_yinyang": op12_sql(), "op13_hard_negatives": OP13_SQL}
