"""CSV with quoted newlines, read by many tasks a file: the same rows as Spark's one-task reader."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from prioscope.sources import csv_records as R
from prioscope.sources.tickets import read_tickets, surplus_rows


def write(root, name, text):
    os.makedirs(root, exist_ok=True)
    path = os.path.join(root, name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k) if k != "spark.sql.files.minPartitionNum" else spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("line,out,inside", [
    ("a,b", 0, 1), ('a,"b', 1, 0), ('"a"', 0, 0), ('x",y', 0, 0), ('"a""b"', 0, 0), ('"', 1, 0), ('""', 0, 1),
    ('a"b,"c', 1, 1), ('5" pipe,x', 0, 0), ('"a"x"b,"c', 1, 1), ("", 0, 1), (',"",', 0, 1), ('end",""', 0, 0), ('end","', 1, 1)])
def test_state_after_a_line(line, out, inside):
    assert (R.after_line(line, R.OUT), R.after_line(line, R.IN)) == (out, inside)


def export(rnd, n, end="\n"):
    words = ["plain", 'say ""hi""', "two\nlines", "a,b", "", "long " * 30, "three\n\nlines,\n", "é ü", "x" * 700, "tail\n"]
    rows = [["Ticket Subject", "Ticket Description", "Note"]]
    for i in range(n):
        rows.append([f"s{i}", rnd.choice(words).replace('""', '"'), rnd.choice(["n", "q\nr", ""])])
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue(), rows[1:]


def test_many_tasks_give_the_same_rows(spark, tmpdir_fresh, small_splits):
    text, rows = export(random.Random(1), 300)
    path = write(os.path.join(tmpdir_fresh, "in"), "a.csv", text)
    assert R.lines(spark, path).select("block").distinct().count() > 20
    got = read_tickets(spark, path, na_tokens=[])
    want = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
            .toDF("subject", "description", "note"))
    pick = ["subject", "description", "note"]
    assert got.select(*pick).exceptAll(want).count() == 0 and want.exceptAll(got.select(*pick)).count() == 0
    assert got.count() == 300
    for r in got.collect():
        i = int(r["ticket_id"][4:])
        assert [x or "" for x in (r.subject, r.description, r.note)] == rows[i]


def test_carriage_returns_blank_lines_bom_and_an_open_quote(spark, tmpdir_fresh, small_splits):
    text, rows = export(random.Random(2), 60, "\r\n")
    path = write(os.path.join(tmpdir_fresh, "in"), "a.csv", "﻿" + text.replace("\r\n", "\r\n\r\n", 1) + '\r\ns60,"open\nto the end,')
    got = sorted(read_tickets(spark, path, na_tokens=[]).collect(), key=lambda r: r.ticket_id)
    assert [[x or "" for x in (r.subject, r.description, r.note)] for r in got[:60]] == rows
    assert len(got) == 61 and got[60].subject == "s60"


def test_headers_of_many_files_in_one_job(spark, tmpdir_fresh):
    root = os.path.join(tmpdir_fresh, "in")
    write(root, "empty.csv", "")
    write(root, "blank.csv", "\n\n")
    jobs = []
    for some in (range(3), range(3, 12)):
        for i in some:
            write(root, f"f{i:02d}.csv", ("Ticket Subject,Note\n" if i % 2 else 'Note,Ticket Subject,"Priority\n Level"\n') +
                  ("".join(f"s{i}x{k},n\n" for k in range(i)) if i % 2 else "".join(f"n,s{i}x{k},Low\n" for k in range(i))))
        spark.sparkContext.setJobGroup(f"headers {some}", "")
        rows = read_tickets(spark, root)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers {some}")))
    assert jobs[0] == jobs[1]  # stages of the same few queries, whatever the number of files
    spark.sparkContext.setJobGroup("rows", "")
    got = rows.orderBy("ticket_id").collect()
    assert [r.ticket_id for r in got] == [f"TKT_{i:05d}" for i in range(66)]
    assert [r.subject for r in got] == [f"s{i}x{k}" for i in range(12) for k in range(i)]
    assert {r["note"] for r in got} == {"n"} and set(rows.columns) >= {"note", "subject", "priority\n_level"}


def test_surplus_rows_are_refused_and_written(spark, tmpdir_fresh):
    path = write(os.path.join(tmpdir_fresh, "in"), "a.csv", 'ticket_id,subject\n1,a\n2,b,c,"d\ne"\n3\n4,"f\ng"\n')
    bin_ = os.path.join(tmpdir_fresh, "rejects")
    got = read_tickets(spark, path, rejects=bin_)
    assert sorted((r.ticket_id, r.subject) for r in got.collect()) == [("1", "a"), ("3", None), ("4", "f\ng")]
    bad = spark.read.json(bin_).collect()
    assert [(r.position, r.first_field, r.surplus_field, r.record) for r in bad] == [(1, "2", "c", '2,b,c,"d\ne"')]
    assert surplus_rows(spark, path).count() == 1
    assert read_tickets(spark, path, surplus="keep").count() == 4


def test_lines_as_records_and_no_header(spark, tmpdir_fresh):
    path = write(os.path.join(tmpdir_fresh, "in"), "a.csv", 'ticket_id,subject\n1,"a\n2,b"\n')
    assert read_tickets(spark, path).count() == 1 and read_tickets(spark, path, multi_line=False).count() == 2
    with pytest.raises(ValueError, match="no CSV file"):
        read_tickets(spark, write(os.path.join(tmpdir_fresh, "e"), "a.csv", ""))
    two = write(os.path.join(tmpdir_fresh, "t"), "a.csv", "priority,Priority Level\nx,y\n")
    with pytest.raises(ValueError, match="duplicate"):
        read_tickets(spark, two)
    assert read_tickets(spark, path).select(F.col("subject")).first()[0] == "a\n2,b"
