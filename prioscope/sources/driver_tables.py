"""Ticket adapter over the driver's TPC-H-like tables.

One ticket per order: ``orders LEFT JOIN events ON event_id = o_orderkey``. Orders
without an event get no resolution time, which exercises the median fill. Text comes
from a 16-entry phrase bank picked by ``pmod(o_orderkey * 7 + o_custkey, 16)``: a
literal-array lookup inside the projection, so no join and nothing broadcast.

At scale this is one sort-merge join on a unique key on both sides (no hot keys);
every other column is a per-row projection.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prioscope.functions.text import sql_lit

# FIXED VALUES — phrase bank (subject, description) of the adapter; our own texts.
PHRASE_BANK = [
    ("Export stalled", "Nightly export is not working since noon"),
    ("Login", "I cannot login and my team is blocked"),
    ("Invoice copy", "Please send the March invoice again"),
    ("PRODUCTION DOWN", "Total outage, respond immediately"),
    ("Slow page", "The report page is slow"),
    ("Question", "Where can I download the manual"),
    ("Refund", "We will probably cancel the contract"),
    ("Odd total", "The total looks wrong and there is an error"),
    ("Know-how", "I need to know the opening hours"),
    ("Notice", "This looks like an illegal course of action"),
    ("Gap", "You need\nit now"),
    (None, "User can't save"),
    ("Access", "We are unable to open the archive"),
    ("Theme", "A darker theme would be nice"),
    ("Issue", "There is an issue with the label"),
    ("Crash", "The app failed to start after a system crash, data loss feared"),
]

# FIXED VALUES — order priority -> raw ticket priority text (strict and wide forms).
PRIORITY_TEXT = {
    "1-URGENT": "critical",
    "2-HIGH": " High ",
    "3-MEDIUM": "MEDIUM",
    "5-LOW": "low",
    "4-NOT SPECIFIED": "not specified",
}
PRIORITY_ALT_TEXT = {"1-URGENT": "p1", "2-HIGH": "3", "3-MEDIUM": "P3 ", "5-LOW": "1"}
CHANNELS = ["Email", "Chat", "Phone", "Social Media"]
TICKET_TYPES = ["Technical", "Billing", "Account", "General"]


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table of the driver data. The DataFrame (a lazy plan, no data) is
    reused per session so the file listing and footer read happen once."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (spark.sparkContext.applicationId, id(spark), path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a scan by ``keys`` only when it has fewer splits than the cluster
    has task slots (e.g. one small single-row-group file); large inputs already have
    one task per split and are returned untouched, so no shuffle is added at scale."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys) if keys else df.repartition(slots)


def _sql(v) -> str:
    return "CAST(NULL AS STRING)" if v is None else sql_lit(v)


def _pick(values, idx_sql: str) -> Column:
    """values[idx] (0-based) as one SQL expression."""
    return F.expr(f"element_at(array({', '.join(_sql(v) for v in values)}), CAST({idx_sql} AS INT) + 1)")


def _lookup(d: dict, key_sql: str) -> Column:
    pairs = ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in d.items())
    return F.expr(f"element_at(map({pairs}), {key_sql})")


def tickets_from(orders: DataFrame, events: DataFrame, how: str = "left") -> DataFrame:
    """Raw ticket rows from an orders and an events DataFrame (batch or stream)."""
    orders = orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    events = events.select("event_id", "value", "ts")
    if how == "left":
        joined = orders.join(events, orders.o_orderkey == events.event_id, "left")
    else:  # stream-static: the event side drives, orders are looked up
        joined = events.join(orders, events.event_id == orders.o_orderkey, "inner")
    k = "pmod(o_orderkey * 7 + o_custkey, 16)"
    return joined.select(
        F.col("o_orderkey").cast("string").alias("ticket_id"),
        F.col("o_orderkey").alias("order_key"),
        _pick([s for s, _ in PHRASE_BANK], k).alias("subject"),
        _pick([d for _, d in PHRASE_BANK], k).alias("description"),
        _lookup(PRIORITY_TEXT, "o_orderpriority").alias("priority"),
        F.coalesce(_lookup(PRIORITY_ALT_TEXT, "o_orderpriority"), F.lit("Unknown")).alias("priority_alt"),
        (F.floor(F.col("value") * 10.0) / 10.0).alias("resolution_hours"),
        _pick(CHANNELS, "pmod(o_orderkey, 4)").alias("channel"),
        _pick(TICKET_TYPES, "pmod(o_custkey, 4)").alias("ticket_type"),
        # a cast would drop a stream's watermark
        F.col("ts") if dict(events.dtypes)["ts"] == "timestamp" else F.col("ts").cast("timestamp").alias("ts"),
    )


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ticket export derived from orders and events (text fields as exported)."""
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    return tickets_from(orders, table(spark, sf_dir, "events"))
