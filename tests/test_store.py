"""Dossier store: appends, last row of an id, pending tickets by filter and anti join."""

import os

from pyspark.sql import functions as F

from prioscope.operators import dossier as D
from prioscope.sources.dossiers import DossierStore
from test_dossier import _audited


def made(spark, ids, delta=2):
    return spark.createDataFrame([(i, (i, "Low", "High", "Hidden Crisis", delta, None, "c", 0.5)) for i in ids],
                                 "ticket_id string, dossier struct<ticket_id string, assigned_priority string, inferred_severity string, mismatch_type string, "
                                 "severity_delta int, feature_evidence array<struct<signal string, value string, weight string, interpretation string>>, "
                                 "constraint_analysis string, confidence double>")


def test_append_read_and_pending(spark, tmpdir_fresh):
    store = DossierStore(spark, os.path.join(tmpdir_fresh, "store"))
    tickets = spark.createDataFrame([(str(i), i) for i in range(500)] + [(None, -1), (None, -2), ("7", 777)], "ticket_id string, n int")
    assert store.pending(tickets).count() == 503 and store.read().count() == 0
    store.append(made(spark, [str(i) for i in range(0, 500, 3)]))
    store.append(made(spark, [str(i) for i in range(0, 500, 5)] + ["7", None], delta=3))
    got = {r.ticket_id: r.dossier.severity_delta for r in store.read().where("ticket_id IS NOT NULL").collect()}
    assert got == {str(i): 3 if i % 5 == 0 or i == 7 else 2 for i in range(500) if i % 3 == 0 or i % 5 == 0 or i == 7}
    left = sorted(r.n for r in store.pending(tickets).collect())
    assert left == [-2, -1] + [i for i in range(500) if i % 3 and i % 5 and i != 7]


def test_a_full_filter_costs_joins_and_no_ticket(spark, tmpdir_fresh):
    store = DossierStore(spark, os.path.join(tmpdir_fresh, "store"))
    store.MAX_BITS = 1 << 12  # as if there were far too many ids
    store.append(made(spark, [str(i) for i in range(0, 6000, 2)]))
    words, bits = store.id_filter()
    assert bits == 1 << 12 and len(words.first()["words"]) == 64
    tickets = spark.range(6000).select(F.col("id").cast("string").alias("ticket_id"))
    assert sorted(int(r[0]) for r in store.pending(tickets).collect()) == list(range(1, 6000, 2))


def test_store_keeps_built_dossiers(spark, tmpdir_fresh):
    d = D.build_dossiers(_audited(spark))
    store = DossierStore(spark, os.path.join(tmpdir_fresh, "store"))
    store.append(d)
    assert sorted(r.dossier for r in store.read().collect()) == sorted(r.dossier for r in d.collect())
    assert store.pending(d).count() == 0
