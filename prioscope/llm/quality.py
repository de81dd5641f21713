"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages of 64 words (of more, evenly, where it has over 16,384 words, so
no bag has more than 256 of them; nothing is cut off). Every passage is described by shares
of its character classes and marks, by its words (length, capitals, repeats) and by hashed
character trigrams, and encoded by a tanh layer. Only documents have labels: a gated
attention (tanh times sigmoid) learns which passages decide, and a logistic layer scores the
weighted mean of the encodings. Encoder, gates and classifier are trained together in numpy
(Adam) on a bounded sample of labelled rows: at most ``max_rows``, half of each label, and
at most ``max_passages`` of their passages. Spark tasks describe the sample and score all
texts; the model is a few thousand numbers. A fifth of the sample sets the bias, so that
THRESHOLD lies where rejecting bad texts is worth most, a lost good one counting GOOD_COST
times.

Defined results: null, empty and blank texts are one passage of zeros; null labels and
labelled ids without a document are not learnt from; of several labels of an id the largest
counts, of several documents under a labelled id the text with the least hash; with no
learnable row of one of the two classes every score is the share of good labels (0.5 without
labels); repeated rows are scored alike. Only the named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prioscope.llm.common import arrow_map
from prioscope.session import materialize

PASSAGE_WORDS = 64
MAX_PASSAGES = 256
#: Bounds of the labelled sample.
MAX_ROWS = 4000
SAMPLE_PASSAGES = 100_000
THRESHOLD = 0.3
GOOD_COST = 8
HIDDEN, GATES = 24, 12
EPOCHS, BATCH, RATE, DECAY = 24, 64, 0.005, 1e-4
TRIGRAMS = 128
#: Code points that one numpy pass describes, about.
CHUNK = 1 << 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]
LOWER, UPPER, DIGIT, SPACE, NEWLINE, OTHER = range(6)
CLASSES = 6 + len(_MARKS)


def _classes() -> np.ndarray:
    """Class of each code point of the basic plane, by Unicode's categories."""
    kind = {"Ll": LOWER, "Lo": LOWER, "Lm": LOWER, "Lu": UPPER, "Lt": UPPER, "Nd": DIGIT}
    out = np.array([kind.get(unicodedata.category(chr(i)), OTHER) for i in range(1 << 16)], np.int64)
    out[[9, 11, 12, 32]], out[[10, 13]] = SPACE, NEWLINE
    for k, mark in enumerate(_MARKS):
        out[ord(mark)] = 6 + k
    return out


_CLASS = _classes()
WIDTH = CLASSES + TRIGRAMS + 11


def passages(text: str | None) -> list[str]:
    """The whole text in pieces of equally many words, each with the white space behind it."""
    t = text or ""
    size = PASSAGE_WORDS
    if len(t) >= 2 * PASSAGE_WORDS * MAX_PASSAGES:
        size = max(size, -(-sum(1 for _ in _WORD.finditer(t)) // MAX_PASSAGES))
    return re.findall(r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){1,%d}" % size, t) or [""]


def describe(pieces: list[str]) -> np.ndarray:
    """One row of WIDTH numbers for each passage."""
    n = len(pieces)
    raw = [p.encode("utf-32-le", "surrogatepass") for p in pieces]
    sizes = np.array([len(r) // 4 for r in raw])
    code = np.frombuffer(b"".join(raw), np.uint32)
    if not len(code):
        return np.zeros((n, WIDTH), np.float32)
    own = np.repeat(np.arange(n), sizes)
    kind = _CLASS[np.minimum(code, 0xFFFF)]
    chars = np.maximum(sizes, 1)[:, None]
    shares = np.sqrt(np.bincount(own * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / chars)

    three = code[:-2] * np.uint32(2654435761) ^ code[1:-1] * np.uint32(2246822519) ^ code[2:] * np.uint32(3266489917) if len(code) > 2 else code[:0]
    inside = own[:-2] == own[2:] if len(code) > 2 else np.zeros(0, bool)
    slot = ((three ^ three >> np.uint32(15)) >> np.uint32(7) & np.uint32(TRIGRAMS - 1)).astype(np.int64)
    grams = np.sqrt(np.bincount(own[:len(slot)][inside] * TRIGRAMS + slot[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS) / chars)

    blank = (kind == SPACE) | (kind == NEWLINE)
    fresh = np.concatenate([[True], own[1:] != own[:-1]])
    starts = np.flatnonzero(~blank & (fresh | np.concatenate([[True], blank[:-1]])))
    stops = np.flatnonzero(~blank & np.concatenate([fresh[1:] | blank[1:], [True]])) + 1
    of, length = own[starts], stops - starts
    words = np.bincount(of, minlength=n)
    per = np.maximum(words, 1)

    def share(flags) -> np.ndarray:
        return np.bincount(of, flags, n) / per

    if len(starts):
        within = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))  # pieces begin with a word
        power = np.cumprod(np.full(int(within.max()) + 1, 16777619, np.uint32), dtype=np.uint32)
        hashed = np.add.reduceat(np.where(blank, np.uint32(0), code * power[within]), starts, dtype=np.uint32)
        lower, upper = np.add.reduceat(kind == LOWER, starts, dtype=np.int64), np.add.reduceat(kind == UPPER, starts, dtype=np.int64)
        again = np.concatenate([[False], (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])])
        keys, counts = np.unique(of << 32 | hashed.astype(np.int64), return_counts=True)
        who = keys >> 32
        kinds = np.bincount(who, minlength=n)
        top, first = np.zeros(n), np.flatnonzero(np.diff(who, prepend=-1))
        top[who[first]] = np.maximum.reduceat(counts, first)
        last = kind[stops - 1]
        mean = share(length)
        spread = np.sqrt(np.maximum(share(length.astype(float) ** 2) - mean ** 2, 0))
        stats = [np.log1p(words) / 4, np.minimum(mean, 40) / 8, np.minimum(spread, 40) / 8, share(kind[starts] == UPPER),
                 share((upper > 1) & (lower == 0)), share(again), kinds / per, top / per, share(last >= 6),
                 share(length == 1), share(length > 20)]
    else:
        stats = [np.zeros(n)] * 11
    return np.concatenate([shares, grams, np.stack(stats, axis=1)], axis=1).astype(np.float32)


def bags(texts: list[str | None]):
    """``(rows, described passages)`` of texts, by chunks: ``rows`` is each text's number of passages."""
    held, counts, size = [], [], 0
    for t in texts:
        pieces = passages(t)
        if held and size + len(t or "") > CHUNK:
            yield counts, describe(held)
            held, counts, size = [], [], 0
        held += pieces
        counts.append(len(pieces))
        size += len(t or "")
    if held:
        yield counts, describe(held)


class Model:
    """Encoder ``W, b``, gates ``V, U, w`` and classifier ``c, d`` over standardised descriptions."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        width = len(mean)
        self.parts = [rng.normal(0, width ** -0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATES)),
                      rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATES)), rng.normal(0, 0.3, GATES), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.parts = [p.astype(np.float32) for p in self.parts]

    def run(self, X: np.ndarray, counts: np.ndarray):
        """Logits of the bags, and what the gradient needs."""
        W, b, V, U, w, c, d = self.parts
        x = np.clip((X - self.mean) * self.scale, -6, 6)
        H = np.tanh(x @ W + b)
        A, G = np.tanh(H @ V), 1 / (1 + np.exp(-(H @ U)))
        e = (A * G) @ w
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        own = np.repeat(np.arange(len(counts)), counts)
        a = np.exp(e - np.maximum.reduceat(e, at)[own])
        a /= np.add.reduceat(a, at)[own]
        z = np.add.reduceat(a[:, None] * H, at, axis=0)
        return z @ c + d[0], (x, H, A, G, a, z, at, own)

    def gradient(self, X: np.ndarray, counts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        W, b, V, U, w, c, d = self.parts
        logit, (x, H, A, G, a, z, at, own) = self.run(X, counts)
        g = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        dz = (g[:, None] * c)[own]
        da = np.einsum("ij,ij->i", H, dz)
        de = a * (da - np.add.reduceat(a * da, at)[own])
        gate = de[:, None] * w
        rawA, rawG = gate * G * (1 - A * A), gate * A * G * (1 - G)
        dH = (a[:, None] * dz + rawA @ V.T + rawG @ U.T) * (1 - H * H)
        return [x.T @ dH, dH.sum(0), H.T @ rawA, H.T @ rawG, (A * G).T @ de, z.T @ g, np.array([g.sum()])]


def train(X: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 42) -> Model:
    """Joint training on bags: ``X`` holds their passages one bag after the other."""
    model = Model(X.mean(0), 1 / np.maximum(X.std(0), 0.02), seed)
    rng = np.random.default_rng(seed)
    at = np.concatenate([[0], np.cumsum(counts)])
    m1, m2, step = [np.zeros_like(p) for p in model.parts], [np.zeros_like(p) for p in model.parts], 0
    for epoch in range(epochs):
        order = rng.permutation(len(counts))
        rate = RATE * (1 - epoch / epochs)
        for s in range(0, len(order), BATCH):
            part = order[s:s + BATCH]
            rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in part])
            step += 1
            for p, m, v, g in zip(model.parts, m1, m2, model.gradient(X[rows], counts[part], y[part])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8) + DECAY * p)
    return model


def calibrated(X: np.ndarray, counts: np.ndarray, y: np.ndarray) -> Model:
    """Train on four fifths of the bags; the rest sets the bias (see above)."""
    check = np.arange(len(counts)) % 5 == 0
    if len(np.unique(y[check])) < 2 or len(np.unique(y[~check])) < 2:
        return train(X, counts, y)
    kept = np.repeat(check, counts)
    model = train(X[~kept], counts[~check], y[~check])
    z, t = model.run(X[kept], counts[check])[0].astype(float), y[check]
    order = np.argsort(z, kind="stable")
    worth = np.cumsum(1 - t[order]) / (1 - t).sum() - GOOD_COST * np.cumsum(t[order]) / t.sum()
    best = int(worth.argmax())
    above = z[order[best + 1]] if best + 1 < len(z) else z[order[best]] + 1
    model.parts[-1] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - (z[order[best]] + above) / 2)
    return model


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_passages: int = SAMPLE_PASSAGES, id_col: str = "doc_id",
           text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, y, n, rows``: the described sample. Its bounds hold for any input."""
    ls = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    rank = F.xxhash64("doc_id")
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = ls.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = materialize(found.where("y = 0").orderBy(rank).limit(max_rows // 2).union(found.where("y = 1").orderBy(rank).limit(max_rows // 2)), "picked")
    # at most max_rows ids, so broadcast; one text of each
    texts = ids.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))

    def run(c):
        rows = [(n, x) for counts, X in bags(c["text"]) for n, x in zip(counts, np.split(X.astype(np.float16), np.cumsum(counts)[:-1]))]
        return {"doc_id": c["doc_id"], "y": c["y"], "n": [n for n, _ in rows], "rows": [x.tobytes() for _, x in rows]}

    made = materialize(arrow_map(texts, run, f"doc_id {dict(texts.dtypes)['doc_id']}, y int, n int, rows binary"), "described")
    sofar = F.sum("n").over(Window.partitionBy("y").orderBy(rank, "doc_id"))
    few = made.select("doc_id", "y", sofar.alias("sofar"), "n").where(F.col("sofar") - F.col("n") < max_passages // 2)
    return made.join(F.broadcast(few.select("doc_id")), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Model | float:
    """A model, or the one score that all texts get."""
    got = sample(docs, labels, **bounds).toArrow().sort_by("doc_id")
    y = np.array(got["y"].to_pylist(), np.float32)
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    counts = np.array(got["n"].to_pylist())
    X = np.concatenate([np.frombuffer(r.as_py(), np.float16).reshape(-1, WIDTH) for r in got["rows"]]).astype(np.float32)
    order = np.random.default_rng(7).permutation(len(y))  # folds of mixed ids
    at = np.concatenate([[0], np.cumsum(counts)])
    rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in order])
    return calibrated(X[rows], counts[order], y[order])


def score_texts(model: Model | float, texts: list[str | None]) -> list[float]:
    if isinstance(model, float):
        return [model] * len(texts)
    out: list[float] = []
    for counts, X in bags(texts):
        z = model.run(X, np.array(counts))[0].astype(float)
        out += (1 / (1 + np.exp(-np.clip(z, -700, 700)))).tolist()
    return out


def attention(model: Model, text: str | None) -> list[tuple[str, float]]:
    """The passages of a text with their weights."""
    pieces = passages(text)
    return list(zip(pieces, model.run(describe(pieces), np.array([len(pieces)]))[1][4].tolist()))


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(c):
        return {"doc_id": c["doc_id"], "score": score_texts(sent.value, c["text"])}

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run,
                     f"doc_id {dict(docs.dtypes)[id_col]}, score double")
