"""Quality classifier: gradients, whole texts, held-out accuracy and the defined cases."""

import zlib

import numpy as np
import pytest

from prioscope.llm import quality as Q
from prioscope.llm import queries
from prioscope.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars int, score string, n string"
GOOD = ["the river runs slowly through the green valley and the old town.", "bread, butter and a cup of tea on the table.",
        "we walked home while the evening light fell on the hills."]
BAD = ["BUY NOW!! BUY NOW!! CHEAP!! CHEAP!!", "the the the the the the", "click | here | menu | top | home | next"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in rows], DOCS)


def test_gradient_of_attention_matches_differences():
    rng = np.random.default_rng(0)
    X, counts, y = rng.normal(size=(9, 5)), np.array([1, 3, 5]), np.array([1.0, 0.0, 1.0])
    model = Q.Model(np.zeros(5), np.ones(5))
    model.parts = [p.astype(float) for p in model.parts]

    def loss():
        z = model.run(X, counts)[0]
        return float((np.log1p(np.exp(z)) - y * z).mean())

    for part, g in zip(model.parts, model.gradient(X, counts, y)):
        for k in rng.choice(part.size, min(6, part.size), replace=False):
            was, eps = part.flat[k], 1e-6
            part.flat[k] = was + eps
            up = loss()
            part.flat[k] = was - eps
            down = loss()
            part.flat[k] = was
            assert np.ravel(g)[k] == pytest.approx((up - down) / (2 * eps), abs=1e-6)


def test_passages_hold_the_whole_text():
    for n in (1, 64, 65, 16_384, 16_385, 50_000):
        text = " ".join(f"w{i}" for i in range(n)) + "\n"
        pieces = Q.passages(text)
        assert "".join(pieces) == text and len(pieces) == min(Q.MAX_PASSAGES, -(-n // 64)) or n > 16_384 and len(pieces) <= Q.MAX_PASSAGES
    assert Q.passages(None) == Q.passages("") == Q.passages(" \n") == [""]


def test_description_does_not_depend_on_its_neighbours():
    texts = [*GOOD, "", *BAD, "é", "x" * 500, "A B C 1 2 3 ...", "\U0001F600 \ud800"]
    alone = np.concatenate([Q.describe([t]) for t in texts])
    np.testing.assert_allclose(Q.describe(texts), alone, rtol=1e-6)
    assert alone.shape == (len(texts), Q.WIDTH) and np.isfinite(alone).all()
    np.testing.assert_allclose(Q.describe(["the the the"])[0, -5:-2], [1 / 3, 1, 0], rtol=1e-6)


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(1)

    def text(bad):
        parts = [" ".join(rng.choice(GOOD).split() * 6)[:380] for _ in range(4)]
        if bad:
            parts[rng.integers(4)] = " ".join(BAD[0].split() * 11)
        return " ".join(parts)

    y = np.array([i % 2 for i in range(200)], np.float32)
    counts, X = zip(*Q.bags([text(v == 0) for v in y]))
    model = Q.train(np.concatenate(X), np.concatenate(counts), y)
    seen = Q.attention(model, text(True))
    assert "BUY" in max(seen, key=lambda p: p[1])[0] and sum(w for _, w in seen) == pytest.approx(1, abs=1e-5)
    assert Q.score_texts(model, [text(True)])[0] < 0.3 < Q.score_texts(model, [text(False)])[0]


def test_quality_learns_and_scores_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op13_quality(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    rank = s.argsort().argsort()
    n1 = (y == 1).sum()
    auc = (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))
    assert auc > 0.99 and (s[y == 0] < 0.3).mean() > 0.9 and (s[y == 1] >= 0.3).mean() > 0.98


def test_defined_cases(spark):
    odd = [(1, None), (2, ""), (3, " \n"), (None, GOOD[0]), (5, BAD[0]), (5, BAD[0]), (6, "long " * 60_000)]
    docs = frame(spark, odd + [(10 + i, (GOOD + BAD)[i % 6]) for i in range(60)])
    labels = spark.createDataFrame([(10 + i, int(i % 6 < 3)) for i in range(60)] + [(None, 1), (5, None), (999, 0), (10, 0)], "doc_id long, quality int")
    got = {}
    for r in Q.score(docs, Q.fit(docs, labels)).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert len(got[5]) == 2 and got[5][0] == got[5][1] < 0.3 and got[1] == got[2] == got[3]
    assert got[None][0] > 0.3 and all(0 <= s <= 1 for v in got.values() for s in v)
    none = labels.where("quality = 7")
    assert Q.fit(docs, none) == 0.5 and {r["score"] for r in Q.score(docs, 0.5).collect()} == {0.5}
    assert Q.fit(docs, labels.where("quality = 1 AND doc_id <> 10")) == 1.0
    assert Q.score(frame(spark, []), 0.5).collect() == []


def test_sample_bounds(spark):
    docs = frame(spark, [(i, (GOOD + BAD)[i % 6]) for i in range(80)] + [(3, f"again {k}") for k in range(50)])
    labels = spark.createDataFrame([(i, int(i % 6 < 3)) for i in range(80)], "doc_id long, quality int")
    assert Q.sample(docs, labels, max_rows=20).groupBy("y").count().collect() and Q.sample(docs, labels, max_rows=20).count() == 20
    assert Q.sample(docs, labels, max_passages=10).count() == 10
