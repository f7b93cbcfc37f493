"""Readers' events as streams: task tokens, bursts and stale results, each with a state that is bounded in time."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import SEARCH_QUIET_MS

# Times as text without loss, the largest whole number.
MICROS, MICROS_NTZ, MOST = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", (1 << 63) - 1


def task_tokens_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """`task_tokens` of a stream: (key, seq, accepted), with the running token of each key as state.

    Takes key, seq, kind, token, replace and, if `idle_ms` is given, the event time `ts` with a
    watermark: a key without events for so long is freed, as if cancelled.  Micro-batches hold
    later events than those before; within one, the order is by `seq`.  An event that is not
    above the last one of its key has been seen already and gives nothing, so deliveries may
    repeat.
    """
    timed = idle_ms is not None

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, _ = state.get
            state.update((last, None))  # the order stays known; the task does not
            return
        last, running = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for seq, kind, token, replace in zip(rows["seq"].tolist(), rows["kind"].tolist(), rows["token"].tolist(), rows["replace"].tolist(), strict=True):
            if last is not None and seq <= last:
                continue
            last = seq
            if kind == "start":
                good = running is None or bool(replace)
                running = token if good else running
            else:
                good = running is not None and (kind != "finish" or running == token)
                running = None if good else running
            out.append((key[0], seq, good))
        state.update((last, running))
        if timed:
            latest = int(rows["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["key", "seq", "accepted"])

    kind = events.schema["key"].dataType.simpleString()
    columns = ["key", F.col("seq").cast("long").alias("seq"), "kind", "token", F.coalesce("replace", F.lit(False)).alias("replace"), *(["ts"] if timed else [])]
    return events.select(*columns).groupBy("key").applyInPandasWithState(fold, f"key {kind}, seq long, accepted boolean", "last long, running string", "append", "EventTimeTimeout" if timed else "NoTimeout")


def settled_stream(events: DataFrame, by: list[str], time: str, order: str, delay: str, quiet_ms: int = SEARCH_QUIET_MS) -> DataFrame:
    """`settled` of a stream: a burst is a session, and its last event comes out once the watermark has passed its quiet time."""
    rest = [c for c in events.columns if c not in by]
    session = F.session_window(time, f"{quiet_ms} milliseconds")
    last = F.max_by(F.struct(*rest), F.struct(time, order)).alias("_last")
    kept = events.withWatermark(time, delay).groupBy(*by, session.alias("_session")).agg(last)
    return kept.select(*by, *(F.col(f"_last.{c}").alias(c) for c in rest), F.col("_session.end").alias("quiet_at"))


def current_results_stream(results: DataFrame, loads: DataFrame, delay: str, horizon: str) -> DataFrame:
    """`current_results` of two streams: a result comes out once the watermark has passed it, unless a newer load came first.

    Loads count for `horizon` (the longest time from a load to its last result).  A document's
    time is cut into blocks so long; a load is sent to its own and the next, so a block has all
    that its results can meet.  Within a block loads are sorted once and each result asks for the
    largest sequence of a range of them, so work grows with the rows and not with their pairs.
    A block's state goes once the watermark has passed its end.
    """
    span = results.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {horizon})").first()[0]
    stamps = {"timestampFormat": MICROS, "timestampNTZFormat": MICROS_NTZ, "ignoreNullFields": "false"}
    at, row = F.unix_micros(F.col("time").cast("timestamp")), F.to_json(F.struct(*results.columns), stamps)
    own = F.floor(at / span)
    # a result without a sequence is overtaken by none; loads that lack anything overtake none
    asked = results.withWatermark("time", delay).filter("time IS NOT NULL").select("document_id", own.alias("_block"), "time", at.alias("_at"), F.coalesce(F.col("sequence").cast("long"), F.lit(MOST)).alias("_seq"), row.alias("_row"))
    sent = loads.withWatermark("time", delay).filter("document_id IS NOT NULL AND sequence IS NOT NULL AND time IS NOT NULL")
    sent = sent.select("document_id", F.explode(F.array(own, own + 1)).alias("_block"), "time", at.alias("_at"), F.col("sequence").cast("long").alias("_seq"), F.lit(None).cast("string").alias("_row"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [pd.read_pickle(io.BytesIO(state.get[0]))] if state.exists else []
        if not state.hasTimedOut:
            held += [b[["_at", "_seq", "_row"]] for b in batches]
        rows = pd.concat(held, ignore_index=True).sort_values("_at", kind="stable")
        passed, end = state.getCurrentWatermarkMs(), int(key[1] + 1) * span
        result = rows["_row"].notna()
        due = rows[result & (rows["_at"] <= passed * 1000)]
        if len(due):
            known, when = rows[~result], due["_at"].to_numpy()
            newest = largest(known["_at"].to_numpy(), known["_seq"].to_numpy(), when - span, when)
            yield pd.DataFrame({"_row": due["_row"][newest <= due["_seq"].to_numpy()]})
        waiting = rows["_at"][result & (rows["_at"] > passed * 1000)]
        if waiting.empty and end <= passed * 1000:
            if state.exists:
                state.remove()
            return
        out = io.BytesIO()
        rows.drop(index=due.index).to_pickle(out)
        state.update((out.getvalue(),))
        # a time-out comes once the watermark is above it
        state.setTimeoutTimestamp(max(1, passed, -(-int(min(waiting.min(), end) if len(waiting) else end) // 1000) - 1))

    kept = asked.unionByName(sent).groupBy("document_id", "_block").applyInPandasWithState(fold, "_row string", "held binary", "append", "EventTimeTimeout")
    return kept.select(F.from_json("_row", results.schema, stamps).alias("r")).select("r.*")


def largest(order: np.ndarray, value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The largest `value` whose `order` (sorted) lies in each [first, last]; the least number there is for none."""
    low, high = np.searchsorted(order, first, "left"), np.searchsorted(order, last, "right")
    out, n = np.full(len(first), np.iinfo(np.int64).min), high - low
    level, width = value.astype(np.int64), 1
    while len(level):
        # ranges of width to 2 x width - 1 values are two of `width`, which may overlap
        own = np.flatnonzero((n >= width) & (n < 2 * width))
        out[own] = np.maximum(level[low[own]], level[high[own] - width])
        level, width = np.maximum(level[:-width], level[width:]), 2 * width
    return out
