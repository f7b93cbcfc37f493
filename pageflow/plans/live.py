"""Queries over the events of readers, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..scratch import scratch
from ..settings import restored
from ..streaming import live as L
from . import fixtures as X
from .search import latest_tasks


def version_log(spark, sf_dir):
    """Versions of each user's events by a clock that stands still and jumps back."""
    e = X.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 37).alias("now_ms"))
    return E.next_versions(e, ["user_id"], span=1000).select("user_id", "seq", "version")


version_log.sql = """WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, event_id % 37 AS now_ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
v AS (SELECT user_id, seq, n, greatest(1, 1000 * now_ms) AS version FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.seq, e.n, greatest(v.version + 1, 1000 * e.now_ms) FROM v JOIN e ON e.user_id = v.user_id AND e.n = v.n + 1)
SELECT user_id, seq, CAST(version AS BIGINT) AS version FROM v"""


def version_log_one_clock(spark, sf_dir):
    """The same for all events as one reader's, whose clock runs slower than the events come."""
    e = X.table(spark, sf_dir, "events").select(F.lit("all").alias("reader"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 1500).alias("now_ms"))
    return E.next_versions(e, ["reader"], span=1000).select("seq", "version")


version_log_one_clock.sql = """WITH e AS (SELECT event_id AS seq, event_id // 1500 AS now_ms, row_number() OVER (ORDER BY event_id) AS i FROM events)
SELECT seq, CAST(i + greatest(0, max(1000 * now_ms - i) OVER (ORDER BY seq)) AS BIGINT) AS version FROM e"""

#: Users share searches, so that bursts come about.
BURSTS, QUIET_MS = 5, 200_000


def _searches(spark, df):
    return df.select((F.col("user_id") % BURSTS).alias("reader"), "ts", "event_id")


def search_debounce(spark, sf_dir):
    """The last event of each burst."""
    return E.settled(_searches(spark, X.table(spark, sf_dir, "events")), ["reader"], "ts", "event_id", QUIET_MS).select("reader", "event_id", "quiet_at")


SETTLED = f"x AS (SELECT user_id % {BURSTS} AS reader, event_id, ts, lead(ts) OVER (PARTITION BY user_id % {BURSTS} ORDER BY ts, event_id) AS following FROM events), y AS (SELECT reader, event_id, ts, ts + INTERVAL {QUIET_MS} MILLISECOND AS quiet_at FROM x WHERE following IS NULL OR following - ts > INTERVAL {QUIET_MS} MILLISECOND)"
search_debounce.sql = f"WITH {SETTLED} SELECT reader, event_id, quiet_at FROM y"


def _stream(spark, sf_dir):
    e = spark.readStream.schema(X.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _written(spark, stream, label):
    """What a stream gives for all that is there now."""
    root = scratch(spark, label)
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def search_debounce_stream(spark, sf_dir):
    """The same as a stream: bursts whose quiet time the watermark, a minute behind the last event, has passed."""
    out = L.settled_stream(_searches(spark, _stream(spark, sf_dir)), ["reader"], "ts", "event_id", "1 minute", QUIET_MS)
    return _written(spark, out.select("reader", "event_id", F.col("quiet_at").cast("timestamp_ntz").alias("quiet_at")), "bursts")


search_debounce_stream.sql = f"WITH {SETTLED} SELECT reader, event_id, quiet_at FROM y WHERE quiet_at <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 MINUTE"


def latest_tasks_stream(spark, sf_dir):
    """Task tokens with the running tokens as a stream's state."""
    kind = F.element_at(F.array(F.lit("start"), F.lit("finish"), F.lit("cancel")), (F.col("event_id") % 3 + 1).cast("int"))
    e = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 5).cast("string").alias("token"), (F.col("event_id") % 2 == 0).alias("replace"))
    return _written(spark, L.task_tokens_stream(e), "tokens")


latest_tasks_stream.sql = latest_tasks.sql


def _loads(e):
    return e.filter("event_type = 'view'").select((F.col("user_id") % 40).alias("document_id"), (F.col("event_id") % 97).alias("sequence"), F.col("ts").alias("time"))


def _results(e):
    return e.filter("event_type <> 'view'").select((F.col("user_id") % 40).alias("document_id"), (F.col("event_id") % 97).alias("sequence"), F.col("ts").alias("time"), "event_id")


def overtaken_results(spark, sf_dir):
    """Results of loads that no newer load of the document had overtaken when they came."""
    e = X.table(spark, sf_dir, "events")
    return E.current_results(_results(e), _loads(e)).select("document_id", "event_id")


OVERTAKEN = "e AS (SELECT user_id % 40 AS document_id, event_id % 97 AS sequence, ts, event_id, event_type = 'view' AS load FROM events), x AS (SELECT *, max(CASE WHEN load THEN sequence END) OVER (PARTITION BY document_id ORDER BY ts RANGE BETWEEN {span} PRECEDING AND CURRENT ROW) AS newest FROM e)"
overtaken_results.sql = f"WITH {OVERTAKEN.format(span='UNBOUNDED')} SELECT document_id, event_id FROM x WHERE NOT load AND NOT coalesce(newest > sequence, false)"


def overtaken_results_stream(spark, sf_dir):
    """The same as a join of two streams that holds loads for six hours; results that the watermark has passed."""
    e = _stream(spark, sf_dir)
    out = L.current_results_stream(_results(e), _loads(_stream(spark, sf_dir)), "10 minutes", "6 HOURS")
    return _written(spark, out.select("document_id", "event_id"), "results")


overtaken_results_stream.sql = f"WITH {OVERTAKEN.format(span='INTERVAL 6 HOUR')}, w AS (SELECT date_trunc('millisecond', least(max(ts) FILTER (load), max(ts) FILTER (NOT load))) - INTERVAL 10 MINUTE AS passed FROM e) SELECT document_id, event_id FROM x, w WHERE NOT load AND NOT coalesce(newest > sequence, false) AND ts <= w.passed"



def settings_restored(spark, sf_dir):
    """Stored settings over the defaults: some of an older version, with fields of another kind, too slow, or no object."""
    e, i = X.table(spark, sf_dir, "events"), F.col("event_id")
    part = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    json = (
        F.when(i % 6 == 0, part('{"model":"m', i, '","concurrency":', i % 7, ',"characters_per_second":', i % 200, ',"schema_version":2}'))
        .when(i % 6 == 1, part('{"model":', i, ',"concurrency":"', i, '","characters_per_second":150,"schema_version":1}'))
        .when(i % 6 == 2, part('{"language":"it\'s","nearby_pages":2.5,"characters_per_second":true,"schema_version":2}'))
        .when(i % 6 == 3, part('["', i, '"]')).when(i % 6 == 4, part('{"model":"', i))
    )
    r = e.select("event_id", restored(json).alias("r"))
    return r.select("event_id", "r.provider", "r.model", "r.language", "r.nearby_pages", "r.concurrency", "r.characters_per_second", "r.schema_version")


settings_restored.sql = """SELECT event_id, 'default' AS provider, CASE WHEN event_id % 6 = 0 THEN 'm' || event_id ELSE '' END AS model, CASE WHEN event_id % 6 = 2 THEN 'it''s' ELSE 'English' END AS language, CAST(2 AS BIGINT) AS nearby_pages,
CASE WHEN event_id % 6 = 0 THEN event_id % 7 ELSE 4 END AS concurrency, CASE WHEN event_id % 6 = 0 AND event_id % 200 >= 10 THEN event_id % 200 ELSE 80 END AS characters_per_second, CAST(2 AS BIGINT) AS schema_version FROM events"""

QUERIES = [settings_restored, version_log, version_log_one_clock, search_debounce, search_debounce_stream, latest_tasks_stream, overtaken_results, overtaken_results_stream]
