"""Structured Streaming: equals batch on in-order input, re-sent files are not
audited twice, and rows behind the watermark are dropped."""

import os
import shutil
import time

from pyspark.sql import functions as F

from prioscope.operators.audit import audit
from prioscope.operators.clean import clean, time_baseline
from prioscope.sources.driver_tables import table, tickets_from
from prioscope.streaming.stream import daily_counts, freeze_baseline, run_to_table, score_stream
from conftest import SF001


def _write_parts(spark, root, parts):
    """Write each events slice as its own parquet file, with increasing mtimes."""
    os.makedirs(root)
    t0 = time.time() - 1000
    for i, (name, df) in enumerate(parts):
        tmp = root + f"_tmp{i}"
        df.coalesce(1).write.parquet(tmp)
        f = [x for x in os.listdir(tmp) if x.endswith(".parquet")][0]
        dst = os.path.join(root, f"{i:02d}_{name}.parquet")
        shutil.copy(os.path.join(tmp, f), dst)
        os.utime(dst, (t0 + 10 * i, t0 + 10 * i))


def _stream(spark, root, schema):
    ev = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root))
    return tickets_from(table(spark, SF001, "orders"), ev, how="inner")


def _setup(spark, tmpdir, order):
    events = table(spark, SF001, "events")
    lo, hi = [r for r in events.agg(F.min("ts"), F.max("ts")).first()]
    span = (hi - lo) / 3
    cut1, cut2 = lo + span, lo + 2 * span
    slices = {"old": events.where(F.col("ts") < cut1),
              "mid": events.where((F.col("ts") >= cut1) & (F.col("ts") < cut2)),
              "new": events.where(F.col("ts") >= cut2)}
    root = os.path.join(tmpdir, "in")
    _write_parts(spark, root, [(n, slices[n]) for n in order])
    tickets = clean(tickets_from(table(spark, SF001, "orders"), events, how="left"), impute=False)
    return root, events.schema, slices, tickets


def test_in_order_with_resent_file_equals_batch(spark, tmpdir_fresh):
    root, schema, slices, tickets = _setup(spark, tmpdir_fresh, ["old", "mid", "new", "old"])
    base = freeze_baseline(spark, tickets)
    out = run_to_table(spark, score_stream(_stream(spark, root, schema), base)
                       .select("ticket_id", "mismatch_type"), "t-stream")
    have_event = tickets.where("resolution_hours is not null").select("ticket_id")
    want = audit(tickets, baseline=time_baseline(tickets)).join(have_event, "ticket_id") \
        .select("ticket_id", "mismatch_type")
    assert out.count() == out.select("ticket_id").distinct().count()  # no double audit
    assert out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0
    assert want.count() == 1000


def test_late_rows_dropped(spark, tmpdir_fresh):
    root, schema, slices, tickets = _setup(spark, tmpdir_fresh, ["new", "mid", "old"])
    base = freeze_baseline(spark, tickets)
    out = run_to_table(spark, score_stream(_stream(spark, root, schema), base)
                       .select("ticket_id"), "t-late")
    ids = lambda df: {str(r[0]) for r in df.select("event_id").collect()}
    got = {r[0] for r in out.collect()}
    assert ids(slices["new"]) <= got          # first batch kept whole
    assert not (ids(slices["old"]) & got)     # far behind the watermark: dropped


def test_daily_counts_emit_closed_windows(spark, tmpdir_fresh):
    root, schema, slices, tickets = _setup(spark, tmpdir_fresh, ["old", "mid", "new"])
    base = freeze_baseline(spark, tickets)
    s = score_stream(_stream(spark, root, schema), base, watermark=None, dedupe=False)
    out = run_to_table(spark, daily_counts(s), "t-daily")
    days = {r.day for r in out.collect()}
    last_day = table(spark, SF001, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
    assert last_day not in days and len(days) >= 20


def _drain_parts(spark, root, parts, schema, build, out, **kw):
    from prioscope.streaming.stream import drain, read_arrivals, timed
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)
        drain(build(timed(read_arrivals(spark, root, spark.createDataFrame([], schema).schema))), out, **kw)
    return spark.read.parquet(out)


def test_split_labels_every_arriving_row(spark, tmpdir_fresh):
    import datetime as dt
    from prioscope.streaming.stream import late_tickets, split_arrivals
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    parts = [
        [("a", t(10), 1), ("b", t(9), 2), ("a", t(10), 3), (None, t(10), 4), (None, t(10), 5), ("n", None, 6)],
        # watermark 9:00 from here on; b and a are remembered, c is behind it, d at it
        [("b", t(9), 7), ("c", t(8), 8), ("c", t(8), 9), ("d", t(9), 10), ("e", t(20), 11), ("n", None, 12)],
        # watermark 19:00; a is forgotten, so its row is late
        [("a", t(10), 13), ("e", t(20), 14), ("f", t(19.5), 15)],
    ]
    rows = _drain_parts(spark, os.path.join(tmpdir_fresh, "in"), parts, "ticket_id string, ts timestamp, n int",
                        lambda s: split_arrivals(s, groups=4), os.path.join(tmpdir_fresh, "out"), partition_by="arrival")
    got = {r.n: r.arrival for r in rows.collect()}
    late, repeat = {8, 9, 10, 13}, {3, 7, 14} if got[1] == "on_time" else {1, 7, 14}
    assert got == {n: "late" if n in late else "repeat" if n in repeat else "on_time" for n in range(1, 16)}
    extra = late_tickets(rows.where("arrival = 'on_time'").drop("arrival"), rows.where("arrival = 'late'").drop("arrival"))
    assert sorted(r.ticket_id for r in extra.collect()) == ["c", "d"]


def test_daily_counts_sum_to_the_distinct_events(spark):
    from prioscope.plans.queries import q_stream_daily_counts
    got = q_stream_daily_counts(spark, SF001).collect()
    events = table(spark, SF001, "events")
    assert sum(r.n for r in got) == events.select("event_id").distinct().count()
    assert 0 < sum(r.n_late for r in got) < sum(r.n for r in got)
    assert {r.day for r in got} == {r[0] for r in events.select(F.date_format("ts", "yyyy-MM-dd")).distinct().collect()}
