"""Structured Streaming forms of the audit (T-1..T-3).

* ``split_arrivals``: every arriving row is labelled on time, repeated or late by one stateful
  operator, so a late ticket goes to a side table instead of vanishing.
* ``score_stream``: arriving tickets are cleaned and scored with the same stateless
  expressions as the batch path, against a *frozen* hours baseline (a materialised
  1-row table), so severities do not drift between micro-batches.
* ``dedupe``: a re-sent ticket is audited once (``dropDuplicatesWithinWatermark``).
* ``daily_counts``: tumbling 1-day windows of mismatch types, append mode, after the
  de-duplication in the same query (two chained stateful operators). ``end_marker`` closes the
  windows that are open when the input ends; ``daily_totals`` adds the late tickets.
* ``read_arrivals`` bounds a micro-batch in bytes, so a backlog is worked off in steps.

Event time must be ``TIMESTAMP`` (a watermark rejects ``TIMESTAMP_NTZ``). State,
checkpoints and sinks live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from prioscope.lexicon import CORE
from prioscope.operators.audit import audit
from prioscope.operators.clean import clean, time_baseline
from prioscope.session import scratch_path

WATERMARK = "1 hour"
#: Bytes of a micro-batch, and groups that hold the ids seen (their state moves as one).
BATCH_BYTES = 64 << 30
SEEN_GROUPS = 1024


def freeze_baseline(spark: SparkSession, tickets: DataFrame, path: str | None = None) -> DataFrame:
    """Compute the hours baseline once and pin it as a versioned 1-row table."""
    path = path or scratch_path(spark, "hours-baseline")
    time_baseline(tickets).write.mode("error").parquet(path)
    return spark.read.parquet(path)


def has_watermark(df: DataFrame, ts_col: str = "ts") -> bool:
    return "spark.watermarkDelayMs" in df.schema[ts_col].metadata


def timed(df: DataFrame, watermark: str | None = WATERMARK, ts_col: str = "ts") -> DataFrame:
    """``ts`` as TIMESTAMP with a watermark, unless it has one (a cast would drop it)."""
    if has_watermark(df, ts_col):
        return df
    df = df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return df.withWatermark(ts_col, watermark) if watermark else df


def read_arrivals(spark: SparkSession, path: str, schema: StructType, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Parquet files as they arrive in ``path``, at most ``batch_bytes`` of them in a micro-batch."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)


def split_arrivals(stream: DataFrame, watermark: str = WATERMARK, id_col: str = "ticket_id", ts_col: str = "ts",
                   groups: int = SEEN_GROUPS) -> DataFrame:
    """All rows of ``stream`` with a column ``arrival``.

    ``on_time``: newer than the watermark and the first with its id. ``repeat``: its id came on
    time before and is still remembered, that is until the watermark has passed its time by
    the delay. ``late``: any other row at or behind the watermark. Ids are remembered in
    ``groups`` states dealt by a hash, so neither a hot id nor many ids meet in one task
    without bound: rows are streamed, and a state holds the ids of two delays. Rows without an
    id are told apart by nothing and are never repeats; rows without a time are on time.
    """
    delay = int(pd.Timedelta(watermark).total_seconds() * 1000)
    df = timed(stream, watermark, ts_col)
    names = df.columns
    out = StructType([*df.schema.fields, StructField("arrival", StringType())])
    at = names.index(id_col)

    def label(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        edge = state.getCurrentWatermarkMs()
        seen = {i: t for i, t in zip(*state.get) if t + delay > edge} if state.exists else {}
        for frame in frames:
            frame = frame[names]
            ms = frame[ts_col].map(lambda t: None if pd.isna(t) else t.value // 1_000_000)
            how = []
            for i, t in zip(frame.iloc[:, at], ms):
                none = i is None or i != i
                if not none and i in seen:
                    how.append("repeat")
                elif t is not None and t == t and t <= edge and edge > 0:
                    how.append("late")
                else:
                    how.append("on_time")
                    if not none and t is not None and t == t:
                        seen[i] = int(t)
            yield frame.assign(arrival=how)
        state.update((list(seen), list(seen.values())))

    kind = df.schema[id_col].dataType.simpleString()
    dealt = F.pmod(F.xxhash64(id_col, F.when(F.col(id_col).isNull(), F.col(ts_col))), F.lit(groups))
    return (df.withColumn("__group", dealt).groupBy("__group")
            .applyInPandasWithState(label, out, f"ids array<{kind}>, times array<long>", "append", GroupStateTimeout.NoTimeout))


def late_tickets(on_time: DataFrame, late: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """Late rows of tickets that never came on time, one per ticket (the earliest)."""
    new = late.join(on_time.select(id_col), id_col, "left_anti")
    first = new.groupBy(id_col).agg(F.min_by(F.struct(*[c for c in new.columns if c != id_col]), "ts").alias("__row"))
    return first.select(id_col, "__row.*").select(*late.columns)


def end_marker(events: DataFrame, last: datetime.datetime, key: str = "event_id", ts_col: str = "ts",
               margin: datetime.timedelta = datetime.timedelta(days=2)) -> DataFrame:
    """One row in the form of ``events``, so far behind ``last`` that it closes every window, with
    a key (-1) that no row has. It moves the watermark and must not be counted: an inner
    join with the keyed side drops it, behind the watermark."""
    row = {key: F.lit(-1), ts_col: F.lit(last + margin)}
    return events.sparkSession.range(1).select(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])


def daily_totals(windows: DataFrame, late_audited: DataFrame) -> DataFrame:
    """``day, mismatch_type, n, n_late``: closed windows and the late tickets of their days."""
    late = late_audited.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "mismatch_type").agg(F.count(F.lit(1)).alias("n"))
    both = windows.select("day", "mismatch_type", "n", F.lit(0).cast("long").alias("n_late")).union(
        late.select("day", "mismatch_type", "n", F.col("n").alias("n_late")))
    return both.groupBy("day", "mismatch_type").agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))


def score_stream(raw_stream: DataFrame, baseline: DataFrame, lexicon=CORE,
                 mode: str = "fused", watermark: str | None = WATERMARK,
                 dedupe: bool = True) -> DataFrame:
    """Streaming raw tickets -> audited rows (one per ticket id within the watermark)."""
    df = timed(raw_stream, watermark)
    if dedupe:
        df = df.dropDuplicatesWithinWatermark(["ticket_id"])
    return audit(clean(df, impute=False), lexicon, mode, baseline=baseline)


def daily_counts(audited_stream: DataFrame, watermark: str = WATERMARK,
                 window: str = "1 day") -> DataFrame:
    """Mismatch types per tumbling event-time window (emitted once the window closes)."""
    df = audited_stream
    if "ts" in df.columns and not has_watermark(df):
        df = df.withWatermark("ts", watermark)
    return (df.groupBy(F.window("ts", window), "mismatch_type")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day"),
                    "mismatch_type", "n"))


def drain(stream: DataFrame, out: str, output_mode: str = "append", partition_by: str | None = None) -> None:
    """Work off all input that has arrived into the Parquet table ``out``. Offsets, state and
    watermark stay beside it, so the next drain goes on where this one ended."""
    w = stream.writeStream.format("parquet").option("checkpointLocation", out + "-checkpoint").outputMode(output_mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.trigger(availableNow=True).start(out).awaitTermination()


def run_to_table(spark: SparkSession, stream: DataFrame, name: str,
                 output_mode: str = "append") -> DataFrame:
    """Drain every available input once (availableNow) into a Parquet table, read it back."""
    out = scratch_path(spark, name)
    drain(stream, out, output_mode)
    return spark.read.parquet(out)
