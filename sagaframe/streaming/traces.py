"""Traces of runs as a stream with keyed state.

The calls of a run come as events. A trace is emitted when its end comes; one that hears nothing
for ``GAP`` of event time is emitted as a partial snapshot, by a timer or when the run's next event
shows that the time is up. What is kept for a run is one row of sums, not its calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds without an event after which a trace is given up, and how late events may come.
GAP, LATE = 24 * 3_600_000, "1 hour"
#: Characters of an output that count, and of an answer that are kept (fixed values).
OUTPUT, ANSWER = 6000, 2000

TRACE = "run bigint, first_event bigint, calls bigint, output_chars bigint, duration double, answer string, status string"
_STATE = "first_event bigint, calls bigint, output_chars bigint, duration double, last bigint"


def traces(events: DataFrame, end: str, gap: int = GAP, late: str = LATE) -> DataFrame:
    """``TRACE`` rows of a stream ``(event_id, ts, user_id, event_type, value, props)``; ``end`` is the type of the event that ends a trace.

    Events without a time or a user are left out; events of equal time are taken by their ids; a null
    output has no characters, a null value no duration. Status is done or in_progress."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, held = [], state.getOption

        def emit(answer: str | None, status: str) -> None:
            out.append((key[0], *held[:4], answer, status))

        if state.hasTimedOut:
            emit(None, "in_progress")
            state.remove()
        else:
            found = pd.concat(parts, ignore_index=True).sort_values(["ms", "micros", "event_id"], kind="stable")
            for r in found.itertuples(index=False):
                if held is not None and r.ms - held[4] > gap:
                    emit(None, "in_progress")
                    held = None
                first, calls, chars, duration, _ = held or (r.event_id, 0, 0, 0.0, 0)
                held = (first, calls + 1, chars + r.chars, duration + r.value, r.ms)
                if r.event_type == end:
                    emit(r.answer, "done")
                    held = None
            if held is None:
                if state.exists:
                    state.remove()
            else:
                state.update(tuple(int(x) if k != 3 else float(x) for k, x in enumerate(held)))
                state.setTimeoutTimestamp(max(int(held[4]) + gap, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRACE.split(", ")])

    known = events.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts IS NOT NULL AND user_id IS NOT NULL").withWatermark("ts", late)
    rows = known.select(
        "ts", F.col("user_id").cast("bigint").alias("run"), F.unix_millis("ts").alias("ms"), F.unix_micros("ts").alias("micros"), "event_id", F.coalesce("event_type", F.lit("")).alias("event_type"),
        F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce(F.least(F.length("props"), F.lit(OUTPUT)), F.lit(0)).cast("bigint").alias("chars"), F.substring("props", 1, ANSWER).alias("answer"),
    )
    return rows.groupBy("run").applyInPandasWithState(fold, TRACE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def trace_stream(events: DataFrame, end: str, path: str, checkpoint: str, gap: int = GAP, late: str = LATE) -> StreamingQuery:
    """Take in all events that are there now, then stop. Each batch of traces is a folder below ``path``, written anew if the batch is repeated."""

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return traces(events, end, gap, late).writeStream.foreachBatch(save).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
