"""Ranked lexical search: SQL, brute force over trees, bounds, blocks of queries, defined cases."""

import random

import duckdb
import numpy as np
import pyarrow as pa

from prioscope.llm import balltree as B
from prioscope.llm import oracle, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score string, idx int, q string"


def test_terms():
    assert B.terms_of("Ab-c9_É é x\x00Y\x7fz[Q]`w`") == [b"ab", b"c9", "É".encode(), "é x".encode(), b"y", b"z", b"q", b"w"]
    assert B.terms_of(None) == B.terms_of(" ,\n") == []


def sparse(rng, n, width):
    rows = [np.sort(rng.choice(width, rng.integers(0, 12), replace=False)) for _ in range(n)]
    rows[3:40] = [rows[2]] * 37  # copies: a ball without radius
    x = [rng.integers(1, 1_000_000, len(r)) for r in rows]
    x[3:40] = [x[2]] * 37
    return np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), np.concatenate(x)


def test_tree_search_equals_brute_force_and_prunes():
    rng = np.random.default_rng(0)
    starts, idx, x = sparse(rng, 700, 60)
    w = rng.integers(0, 9000, 60)
    tree = B.BallTree(starts, idx, x, np.sqrt(w.astype(float)), leaf=7, fan=3)
    scored = 0
    for _ in range(40):
        at = rng.choice(60, 3, replace=False)
        weights, q = np.zeros(60, np.int64), np.zeros(60)
        times = rng.integers(1, 4, 3)
        weights[at], q[at] = w[at] * times, np.sqrt(w[at]) * times
        best = B.Best(5, 1)
        scored += tree.search(q, weights, best.limit, lambda a, s: best.add(s, np.zeros(len(s), bool), np.arange(a, a + len(s)), np.arange(a, a + len(s))))
        all_ = [int(x[a:b] @ weights[idx[a:b]]) for a, b in zip(starts, starts[1:])]
        want = sorted([(-s, i) for i, s in enumerate(all_) if s > 0])[:5]
        assert list(zip((-best.score).tolist(), best.id.tolist())) == want
        for number, node in enumerate(tree.nodes):
            assert max(all_[node[3]:node[4]]) <= tree.bound(number, q)
    assert scored < 40 * 100 * 0.9


def brute(items, docs):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in docs], pa.int64()), "text": pa.array([r[1] for r in docs], pa.string())}))
    con.register("benchmark", pa.table({"item_id": pa.array([r[0] for r in items], pa.int64()), "text": pa.array([r[1] for r in items], pa.string())}))
    return con.execute(oracle.LEXICAL_SEARCH).fetchall()


def frames(spark, items, docs):
    return (spark.createDataFrame(items, "item_id long, text string"),
            spark.createDataFrame([(i, t, "en", "x", 1, "y") for i, t in docs], DOCS).repartition(3))


def key(r):
    return tuple((v is None, v or 0) for v in r)


def test_lexical_search_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL["op11_lexical_search"])
    got = queries.op11_lexical_search(spark, SF)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_defined_cases_and_blocks_of_queries(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["É", "x"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 30)))) for i in range(150)]
    docs += [(900, "copy W1 w2"), (901, "copy W1 w2"), (900, "copy W1 w2"), (None, "copy w1 w2"), (902, None), (903, ""), (904, "--- \n"), (905, "w1 " * 60_000)]
    items = [(1, "w1 w1 W2, copy"), (2, None), (3, "--"), (4, "unknown"), (5, "w7 É"), (5, "w7 É"), (None, "w9"), (6, " ".join(words))]
    want = sorted(brute(items, docs), key=key)
    i, d = frames(spark, items, docs)
    assert sorted((tuple(r) for r in B.top_k(i, d).collect()), key=key) == want
    assert sorted((tuple(r) for r in B.top_k(i, d, max_terms=4).collect()), key=key) == want
    assert [r for r in want if r[0] == 1][0][2] in (900, 901)


def test_empty_tables(spark):
    i, d = frames(spark, [(1, "w1")], [(1, "w1 w2")])
    assert B.top_k(i.where("false"), d).collect() == [] == B.top_k(i, d.where("false")).collect()
    assert [tuple(r)[:3] for r in B.top_k(i, d).collect()] == [(1, 1, 1)]
