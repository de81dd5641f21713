"""Log-bilinear language model, trained with noise-contrastive estimation in numpy.

The next word's score is r . p(w) + b(w), where r sums the feature vectors of the previous
two words, each scaled by its position's weights. The model's words are the commonest ones
of the training text and one class for all others, inside which a word keeps its add-one
share of that class, so the model gives every word a probability.

Everything is learnt from all training documents. Word counts are one aggregation. The
model trains where the text lies: in each round a third of the documents (by a hash of the
id) passes once through noise-contrastive minibatches in every Spark partition, and the
partitions' parameters are averaged by their numbers of tokens. Then batched matrix products
give the normaliser of every context of two model words (a table of fixed size), so that a
token's normalised log-probability is three look-ups.

Counts beyond the HEAD commonest words never leave the cluster: a scoring task knows the head
(a fixed number of words), and the other words of a text are joined to the count table.

Defined results: a null or empty text is its end token alone; with no training document
every count is 0 and the model is the base model; rows that repeat an id are scored alike;
rows without id are held in training (no remainder) and scored. Only the named columns are
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.llm.common import arrow_map, find_package, words_of
from prioscope.session import materialize

#: The end token. It holds a space, so it is no word.
END = b" end"
#: Model words (with the end and the class of the other words), dimensions, sizes of the head.
MODEL_WORDS = 1024
DIM = 24
HEAD = 200_000
ROUNDS = 3
BATCH = 4096
NOISE = 40
RATE = 0.05
#: Words a task counts, and averages that one task merges, before they move on.
COUNT_WORDS = 300_000
MERGERS = 32
#: What a batch of documents holds before it is scored or learnt from, in tokens.
STEP = 1 << 18


def held_out(id_col: str, folds: int = 7, fold: int = 2):
    """Whether crc32 of the id's text leaves the held-out remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokens_of(text: str | None) -> list[bytes]:
    return [*words_of(text), END]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n`` over all tokens of ``docs``; a task counts up to COUNT_WORDS words before it
    hands them on."""
    find_package(docs.sparkSession)
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def counted():
            return pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())}, schema=schema)

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for w in tokens_of(t):
                    seen[w] = seen.get(w, 0) + 1
                if len(seen) > COUNT_WORDS:
                    yield counted()
                    seen = {}
        if seen:
            yield counted()

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """Parameters: context vectors ``Q``, target vectors ``P``, position weights ``C`` (2 x
    DIM), biases ``b``; ``noise`` is the unigram share of each model word."""

    def __init__(self, noise: np.ndarray, seed: int = 42, dim: int = DIM):
        rng = np.random.default_rng(seed)
        v = len(noise)
        self.noise = noise
        self.Q = rng.normal(0, 0.1, (v, dim)).astype(np.float32)
        self.P = rng.normal(0, 0.1, (v, dim)).astype(np.float32)
        self.C = np.array([[1.0] * dim, [0.5] * dim], np.float32)
        self.b = np.log(noise).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.Q, self.P, self.C, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()]).astype(np.float64)

    def load(self, flat: np.ndarray) -> "Model":
        at = 0
        for x in self.parts():
            x[...] = flat[at:at + x.size].reshape(x.shape)
            at += x.size
        return self

    def learn(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray, rng, state: list[np.ndarray]) -> None:
        """One noise-contrastive minibatch with noise words shared by the batch (Adagrad)."""
        k = NOISE
        noise = rng.choice(len(self.noise), k, p=self.noise)
        lk = np.log(k * self.noise).astype(np.float32)
        q1, q2, p = self.Q[w1], self.Q[w2], self.P[w]
        r = self.C[0] * q1 + self.C[1] * q2
        data = 1 / (1 + np.exp(np.einsum("ij,ij->i", r, p) + self.b[w] - lk[w]))  # 1 - P(data)
        fake = 1 / (1 + np.exp(-(r @ self.P[noise].T + self.b[noise] - lk[noise])))  # P(data)
        n = len(w)
        gr = data[:, None] * p - fake @ self.P[noise]
        gP, gQ, gb = (np.zeros_like(x) for x in (self.P, self.Q, self.b))
        _add_rows(gP, w, data[:, None] * r)
        np.add.at(gP, noise, -(fake.T @ r))
        gb += np.bincount(w, data, len(gb)).astype(np.float32)
        np.add.at(gb, noise, -fake.sum(axis=0))
        _add_rows(gQ, w1, gr * self.C[0])
        _add_rows(gQ, w2, gr * self.C[1])
        gC = np.stack([(gr * q1).sum(axis=0), (gr * q2).sum(axis=0)])
        for x, g, s in zip(self.parts(), (gQ, gP, gC, gb), state):
            g /= n
            s += g * g
            x += RATE * g / np.sqrt(s)

    def state(self) -> list[np.ndarray]:
        return [np.full_like(x, 1e-6) for x in self.parts()]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by the previous word (with the bias), by the word before it, and the
        natural-log normaliser of each (word before, previous word)."""
        a1 = (self.Q * self.C[0]) @ self.P.T + self.b
        a2 = (self.Q * self.C[1]) @ self.P.T
        v = len(self.b)
        e1 = np.exp(a1 - a1.max(axis=1, keepdims=True))
        m2 = a2.max(axis=1, keepdims=True)
        z = np.log(np.maximum(np.exp(a2 - m2) @ e1.T, 1e-30)) + m2 + a1.max(axis=1)
        assert z.shape == (v, v)
        return a1.astype(np.float32), a2.astype(np.float32), z.astype(np.float32)


def _add_rows(out: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """out[ids] += rows, with repeated ids."""
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    out[s[first]] += np.add.reduceat(rows[order], first, axis=0)


def _contexts(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Previous word and the one before, for the concatenated tokens of documents that stop
    at ``ends``; before a document stands the end token."""
    w1 = np.concatenate([[end_id], ids[:-1]])
    w2 = np.concatenate([[end_id, end_id], ids[:-2]])[:len(ids)]
    starts = ends[:-1]
    w1[starts] = end_id
    w2[starts] = end_id
    second = starts + 1
    w2[second[second < len(ids)]] = end_id
    return w1, w2


def _train_pass(docs: DataFrame, vocabulary, start: np.ndarray, noise: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Each partition learns from its documents; returns the token-weighted mean of the
    parameters and the number of tokens. A partition sends one row of fixed size."""
    find_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, start, noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, flat, shares = sent.value
        model = Model(shares).load(flat)
        state, rng, total = model.state(), np.random.default_rng(seed), 0
        end_id, other = vocab[END], len(shares) - 1
        ids, ends = [], [0]

        def step():
            nonlocal ids, ends, total
            w = np.array(ids, np.int16)
            w1, w2 = (x.astype(np.int16) for x in _contexts(w, np.array(ends), end_id))
            order = rng.permutation(len(w))
            for at in range(0, len(w), BATCH):
                part = order[at:at + BATCH]
                model.learn(w2[part], w1[part], w[part], rng, state)
            total += len(w)
            ids, ends = [], [0]

        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids += [vocab.get(w, other) for w in tokens_of(text)]
                ends.append(len(ids))
                if len(ids) >= STEP:
                    step()
        if ids:
            step()
        if total:
            yield pa.RecordBatch.from_pydict({"n": [total], "flat": [model.flat().astype("<f4").tobytes()]},
                                             schema=pa.schema([("n", pa.int64()), ("flat", pa.binary())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = None, 0
        for batch in batches:
            for k, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(flat, "<f4").astype(np.float64) * k
                sums, n = (x if sums is None else sums + x), n + k
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "flat": [(sums / n).astype("<f4").tobytes()]},
                                             schema=pa.schema([("n", pa.int64()), ("flat", pa.binary())]))

    made = materialize(docs.mapInArrow(run, "n long, flat binary"), "model")
    # averages of averages: at most MERGERS rows of fixed size reach the driver
    rows = sorted(made.repartition(MERGERS).mapInArrow(merge, "n long, flat binary").collect(), key=lambda r: (r["n"], bytes(r["flat"])))
    n = sum(r["n"] for r in rows)
    return (sum(np.frombuffer(r["flat"], "<f4").astype(np.float64) * r["n"] for r in rows) / n if n else start), n


class LanguageModel:
    """What scoring needs: corpus totals, the head's counts and the model's tables."""

    def __init__(self, total: int, distinct: int, head: list[tuple[bytes, int]], model: Model | None, known: int):
        self.total, self.distinct = total, distinct
        self.head = dict(head)
        self.vocab = {w: i for i, (w, _) in enumerate(head[:known])}
        self.model = model
        inside = sum(n for _, n in head[:known])
        self.other_total, self.other_distinct = total - inside, distinct - known

    def base(self, count):
        return np.log10((np.asarray(count, np.float64) + 1) / (self.total + self.distinct + 1))

    def other(self, count):
        """Share of a word in the class of the words outside the model."""
        return np.log10((np.asarray(count, np.float64) + 1) / (self.other_total + self.other_distinct + 1))


def fit(docs: DataFrame, counts: DataFrame, text_col: str = "text", id_col: str = "doc_id",
        model_words: int = MODEL_WORDS, head: int = HEAD) -> LanguageModel:
    """Train on all of ``docs``; ``counts`` is their written ``word_counts`` table."""
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    top = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(head).collect()]
    if not total:
        return LanguageModel(0, 0, [], None, 0)
    known = min(model_words - 1, len(top))
    if END not in [w for w, _ in top[:known]]:  # the end is always a model word
        row = next(((w, n) for w, n in top if w == END), None) or (END, counts.where(F.col("word") == F.lit(END)).first()["n"])
        top = [x for x in top if x[0] != END]
        top.insert(known - 1, row)
    lm = LanguageModel(total, distinct, top, None, known)
    shares = np.array([n for _, n in top[:known]] + [lm.other_total + 1], np.float64)
    shares /= shares.sum()
    flat = Model(shares).flat()
    texts = docs.select(F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit("round"), F.col(id_col)), F.lit(ROUNDS)).alias("r"))
    for r in range(ROUNDS):
        flat, _ = _train_pass(texts.where(F.col("r") == r).select("text"), lm.vocab, flat, shares, seed=r)
    lm.model = Model(shares).load(flat)
    return lm


def score(docs: DataFrame, lm: LanguageModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for every row of ``docs``."""
    tables = lm.model.tables() if lm.model else None
    sent = docs.sparkSession.sparkContext.broadcast((lm, tables))
    ln10 = math.log(10)

    def run(c):
        m, tab = sent.value
        head, vocab, other = m.head, m.vocab, len(m.vocab)
        out = {k: [] for k in ("doc_id", "n_tokens", "n_known", "base", "score", "tail")}
        zero_base, zero_other = float(m.base(0)), float(m.other(0)) if tab else 0.0
        for doc, text in zip(c["doc_id"], c["text"]):
            tokens = tokens_of(text)
            counts_ = np.array([head.get(w, 0) for w in tokens], np.int64)
            tail = [w for w, n in zip(tokens, counts_) if not n]
            base = float(m.base(counts_[counts_ > 0]).sum())
            score_ = base
            if tab:
                a1, a2, z = tab
                ids = np.array([vocab.get(w, other) for w in tokens], np.int64)
                w1, w2 = _contexts(ids, np.array([0, len(ids)]), vocab[END])
                score_ = float((a1[w1, ids].astype(np.float64) + a2[w2, ids] - z[w2, w1]).sum()) / ln10
                score_ += float(m.other(counts_[(ids == other) & (counts_ > 0)]).sum())
            out["doc_id"].append(doc)
            out["n_tokens"].append(len(tokens))
            out["n_known"].append(int((counts_ > 0).sum()))
            # words outside the head enter as unseen here; the join below corrects the seen ones
            out["base"].append(base + zero_base * len(tail))
            out["score"].append(score_ + (zero_other if tab else zero_base) * len(tail))
            out["tail"].append(tail)
        return out

    kind = dict(docs.dtypes)[id_col]
    made = materialize(arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run,
                                 f"doc_id {kind}, n_tokens long, n_known long, base double, score double, tail array<binary>"), "lm")
    if lm.distinct <= len(lm.head):  # every counted word is in the head
        return made.drop("tail").withColumnRenamed("base", "base_score")
    words = made.withColumn("row", F.xxhash64("doc_id", "n_tokens", "base", "score", "tail"))
    seen = (words.dropDuplicates(["row"]).select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("k"))
            .join(counts, "word")
            .groupBy("row").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("gain")))
    return words.join(seen, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"))
