"""Splittable CSV with quoted newlines.

Spark's own CSV reader gives a whole file to one task as soon as fields may hold newlines.
Here a file is read as lines by as many tasks as it has splits, and records are put
together again:

1. One scan per split: a line maps the state before it (outside or inside a quoted field) to
   the state after it; a split's lines compose to one such map, whatever state it starts
   in. A split gives one row: its map and the records it would start from either state; the
   split at a file's beginning also gives the header record.
2. The maps of a file's splits are composed in order (a map either keeps, swaps or sets the
   state, so a running parity of the swaps behind the last "set" is all there is to it). That
   says in which state each split starts.
3. One more scan cuts the splits into records. A record that crosses splits comes in pieces,
   which are joined; every split has at most two of them.
4. Spark's CSV parser (``from_csv``) takes the records, one schema for each distinct header, in
   the same pass.

A quote opens a field only at its beginning, and ``""`` inside a quoted field is a quote.
Lines end with ``\\n`` or ``\\r\\n``; blank records are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prioscope.session import find_package, materialize

OUT, IN = 0, 1
#: Splits that start inside a quoted field: up to so many are broadcast, more are joined by a shuffle.
BROADCAST_SPLITS = 500_000
SURPLUS = "__surplus"


def after_line(line: str, state: int) -> int:
    """State behind ``line`` (without its line end) from ``state`` before it."""
    if '"' not in line:
        return state
    at, n = 0, len(line)
    while True:
        if state == IN:
            at = line.find('"', at)
            if at < 0:
                return IN
            if line.startswith('""', at):
                at += 2
                continue
            state, at = OUT, at + 1
        elif at <= n and line.startswith('"', at) and (at == 0 or line[at - 1] == ","):
            state, at = IN, at + 1
            continue
        at = line.find(",", at)  # the rest of this field is as it stands
        if at < 0:
            return OUT
        at += 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, value``: lines in order within each split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


_SPLIT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_out", pa.int32()), ("from_in", pa.int32()),
                    ("n_out", pa.int64()), ("n_in", pa.int64()), ("head", pa.string())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def splits(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row for each split of the files of ``path`` (step 1), in one scan."""
    find_package(spark)
    after = after_line if multi_line else lambda line, state: state

    def run(batches):
        key, state, count, head, done = None, [OUT, IN], [0, 0], [], False
        out = []

        def row():
            return (*key, state[0], state[1], count[0], count[1], "\n".join(head) if key[1] == 0 else None)

        for file, block, line in _runs(batches):
            if (file, block) != key:
                if key:
                    out.append(row())
                key, state, count, head, done = (file, block), [OUT, IN], [0, 0], [], False
            for k in (0, 1):
                if state[k] == OUT and line not in ("", "\r"):
                    count[k] += 1
            if block == 0 and not done and (head or line not in ("", "\r")):
                head.append(line)
                done = after(line, state[0]) == OUT
            state = [after(line, s) for s in state]
        if key:
            out.append(row())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _SPLIT)], schema=_SPLIT)

    return lines(spark, path).mapInArrow(run, "file string, block long, from_out int, from_in int, n_out long, n_in long, head string")


def starting_states(parts: DataFrame) -> DataFrame:
    """``parts`` with the ``state`` each split starts in and ``before``, the records that earlier
    splits of all files start (step 2). The table has one row per split."""
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out"))
    swaps = F.sum((F.col("from_out") > F.col("from_in")).cast("int"))
    p = parts.withColumn("swaps", F.coalesce(swaps.over(upto), F.lit(0)))
    p = p.withColumn("last", F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("to"), F.col("swaps").alias("swaps"))), True).over(upto))
    state = (F.coalesce(F.col("last.to"), F.lit(OUT)) + F.col("swaps") - F.coalesce(F.col("last.swaps"), F.lit(0))) % 2
    p = p.withColumn("state", state.cast("int")).withColumn("n", F.when(F.col("state") == OUT, F.col("n_out")).otherwise(F.col("n_in")))
    files = p.groupBy("file").agg(F.sum("n").alias("all"))  # one row per file
    offset = F.coalesce(F.sum("all").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (p.join(files.select("file", offset.alias("offset")), "file")
            .withColumn("before", F.col("offset") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
            .select("file", "block", "state", F.when(F.col("state") == OUT, F.col("from_out")).otherwise(F.col("from_in")).alias("ends"), "before", "n", "head"))


_PIECE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("record", pa.string()), ("kind", pa.string())])
WHOLE, HEAD, TAIL, MIDDLE = "whole", "head", "tail", "middle"


def pieces(spark: SparkSession, path: str, states: DataFrame, multi_line: bool = True, torn: bool = False) -> DataFrame:
    """``file, block, n, record, kind`` (step 3): whole records with their number in the split; or,
    with ``torn``, the pieces of records that start before a split (``head``), end behind it
    (``tail``) or both, for which only splits that hold some are looked through."""
    find_package(spark)
    after = after_line if multi_line else lambda line, state: state
    wanted = states.where((F.col("state") == IN) | (F.col("ends") == IN) if torn else F.col("state") == IN).select("file", "block", "state")
    text, how = lines(spark, path), "inner" if torn else "left"
    if wanted.count() <= BROADCAST_SPLITS:
        text = text.join(F.broadcast(wanted), ["file", "block"], how)  # keeps the order of a split's lines
    else:
        text = (text.withColumn("line", F.monotonically_increasing_id()).join(wanted, ["file", "block"], how)
                .repartition("file", "block").sortWithinPartitions("file", "block", "line"))

    def run(batches):
        key, n, held, state, opened, out = None, 0, [], OUT, False, []

        def flush():
            """What is left of a split: a record that goes on, or a split all inside one."""
            if torn and state == IN and held:
                out.append((*key, n, "\n".join(held), TAIL if opened else MIDDLE))

        for file, block, line, start in _runs(batches):
            if (file, block) != key:
                flush()
                key, n, held, state, opened = (file, block), 0, [], start or OUT, False
            if state == OUT and not held:
                if line in ("", "\r"):
                    continue
                opened = True
            held.append(line)
            state = after(line, state)
            if state == OUT:
                if opened != torn:
                    out.append((file, block, n, "\n".join(held), WHOLE if opened else HEAD))
                n += opened
                held, opened = [], False
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)

    return text.select("file", "block", "value", "state").mapInArrow(run, "file string, block long, n long, record string, kind string")


def joined(torn: DataFrame) -> DataFrame:
    """Records from their pieces, two a split at most, where they start. A record left open at a
    file's end ends there."""
    order = Window.partitionBy("file").orderBy("block", F.col("kind") != HEAD)
    of = F.sum((F.col("kind") == TAIL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return torn.withColumn("of", of).groupBy("file", "of").agg(
        F.min("block").alias("block"), F.min_by("n", "block").alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "record"))), lambda x: x["record"]), "\n").alias("record"))


def clean_end(record: Column) -> Column:
    return F.regexp_replace(record, "\r$", "")


def header_names(spark: SparkSession, head: str) -> list[str]:
    """Field names of a header record, read by Spark's parser; repeated and empty ones get their place."""
    n = head.count(",") + 1
    schema = ", ".join(f"c{i} string" for i in range(n))
    row = spark.range(1).select(F.from_csv(F.lit(head.lstrip("﻿").rstrip("\r")), schema, _OPTIONS).alias("r")).first()["r"]
    names = list(row)
    while names and names[-1] is None:
        names.pop()
    seen, out = {}, []
    for i, x in enumerate(names):
        x = x or f"_c{i}"
        seen[x.lower()] = seen.get(x.lower(), 0) + 1
        out.append(x)
    return [x + str(i) if seen[x.lower()] > 1 else x for i, x in enumerate(out)]


_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}


def read_records(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[list[tuple[str, list[str]]], DataFrame]:
    """The distinct headers of ``path`` (record and field names) and one frame of all other records:
    ``file, head, record, __row_pos`` (dense position in file order, headers not counted). Two
    scans (a third, filtered one where records cross splits), and one job for all headers,
    however many files there are."""
    states = materialize(starting_states(splits(spark, path, multi_line)), "csv-splits")
    headed = states.where("block = 0 AND head <> ''")
    heads = sorted(r["head"] for r in headed.select("head").distinct().collect())  # one per distinct header
    files = headed.select("file", "head", F.row_number().over(Window.orderBy("file")).alias("nth"))  # a row per file
    records = pieces(spark, path, states, multi_line).select("file", "block", "n", "record")
    if not states.where(F.col("ends") == IN).isEmpty():
        records = records.unionByName(joined(pieces(spark, path, states, multi_line, torn=True)).drop("of"))
    at = records.join(states.select("file", "block", "before"), ["file", "block"]).join(files, "file")
    # a file's first record is its header; positions leave out the headers of it and the files before
    at = at.where(~((F.col("block") == 0) & (F.col("n") == 0))).withColumn("__row_pos", F.col("before") + F.col("n") - F.col("nth"))
    return [(h, header_names(spark, h)) for h in heads], at.select("file", "head", clean_end(F.col("record")).alias("record"), "__row_pos")


def parsed(records: DataFrame, heads: list[tuple[str, list[str]]]) -> DataFrame:
    """``records`` with one struct column ``h0, h1, ...`` for each header, null in the other files' rows."""
    def fields(names):
        return ", ".join("`" + c.replace("`", "``") + "` string" for c in [*names, SURPLUS])

    return records.select("*", *[F.when(F.col("head") == head, F.from_csv("record", fields(names), _OPTIONS)).alias(f"h{i}")
                                 for i, (head, names) in enumerate(heads)])
