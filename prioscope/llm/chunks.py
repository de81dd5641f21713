"""Substring dedup by content-defined chunking.

A gear rolling hash runs over the UTF-8 bytes; a chunk ends where the hash matches a mask,
so boundaries depend on the few bytes before them and come back after an insertion. Chunks
are compared by a 128-bit digest. A chunk's first document (smallest id) keeps it. Runs of
neighbouring chunks that an earlier document holds, or that occurred earlier in the same
document, are extended byte by byte as long as the text beside them equals the text beside
the same chunk in its first document, and cut out when they are then long enough to be a
passage, not a phrase. A text all of whose chunks are repeated is cut whatever its length.

The digest table holds one row per distinct chunk of a document; counting is an aggregation
of minima and maxima (combined before the shuffle), and the join back is an ordinary
shuffle join whose hot digests Spark splits. Only digests that two documents share reach it.
The ends of runs ask the first documents for the bytes beside a chunk: each is asked once for
each digest, whose first place in the text answers. Only texts that are asked are read for
that, by a broadcast of their ids while those are few.

An extended end that lies inside a word goes back to the word's edge (if that is near), and
white space at the ends of a passage stays.

Defined results: a null text is returned as null, an empty one as empty; rows that repeat an
id count as one document, so they do not cut each other; rows without id are returned as
they are and take no part; other columns are handed through by ``dedup_substrings``.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.llm.common import arrow_map
from prioscope.session import materialize

#: Bytes of a chunk: at least, on average about (MIN_CHUNK + 1 / share of mask hits), at most.
MIN_CHUNK, MAX_CHUNK = 16, 256
MASK = 0xF000  # four of the hash's top bits: one byte in 16 is a boundary
WINDOW = 16  # bytes that the 16-bit gear hash remembers
#: Characters from which an extended run of repeated chunks is a passage.
MIN_PASSAGE = 120
#: Bytes beside a run that are compared on each side, and bytes within which a word's edge is near.
BESIDE, WORD = 256, 32
LEFT, RIGHT = 0, 1
#: Ids of documents that are broadcast at most when bytes beside chunks are fetched.
BROADCAST_IDS = 1 << 20
#: Bytes hashed at once; a longer text is taken in overlapping parts.
_PART = 1 << 20

#: The gear table, by rule: a 16-bit value per byte from its XXH32.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 1) & 0xFFFF for i in range(256)], dtype=np.uint16)


def _hits(data: bytes) -> np.ndarray:
    """Positions after which the gear hash meets the mask: h = (h << 1) + gear[byte], in 16
    bits, so that it sums the last WINDOW bytes; summed by doubling."""
    found = []
    for at in range(0, len(data), _PART):
        start = max(0, at - WINDOW + 1)
        h = GEAR[np.frombuffer(data[start:at + _PART], np.uint8)]
        for step in (1, 2, 4, 8):
            moved = h.copy()
            moved[step:] += h[:-step] << np.uint16(step)
            h = moved
        hit = np.flatnonzero((h & np.uint16(MASK)) == 0) + start + 1
        found.append(hit[hit > at])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of each chunk; the chunks cover ``data``."""
    out, start, n = [], 0, len(data)
    for hit in _hits(data).tolist():
        while hit - start > MAX_CHUNK:
            out.append((start, start + MAX_CHUNK))
            start += MAX_CHUNK
        if hit - start >= MIN_CHUNK:
            out.append((start, hit))
            start = hit
    while n - start > MAX_CHUNK:
        out.append((start, start + MAX_CHUNK))
        start += MAX_CHUNK
    if start < n:
        out.append((start, n))
    return out


def _digests(text: str | None) -> tuple[bytes, list[tuple[int, int]], list[bytes]]:
    data = (text or "").encode("utf-8", "surrogatepass")
    spans = chunk(data)
    return data, spans, [xxhash.xxh3_128_digest(data[a:b]) for a, b in spans]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, d1, d2``: one row per distinct chunk of each document that has an id."""

    def run(c):
        out = {"doc_id": [], "d1": [], "d2": []}
        for doc, text in zip(c["doc_id"], c["text"]):
            _, _, ds = _digests(text)
            words = np.frombuffer(b"".join(dict.fromkeys(ds)), "<i8")
            out["doc_id"] += [doc] * (len(words) // 2)
            out["d1"] += words[::2].tolist()
            out["d2"] += words[1::2].tolist()
        return out

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                     run, f"doc_id {kind}, d1 long, d2 long")


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, d1, d2, at``: one row per chunk of each document that has an id; ``at`` packs
    23 bits of the text's hash (rows of one id may differ), the chunk's start and its length."""

    def run(c):
        out = {"doc_id": [], "d1": [], "d2": [], "at": []}
        for doc, text in zip(c["doc_id"], c["text"]):
            data, spans, ds = _digests(text)
            tag = (xxhash.xxh64_intdigest(data) & 0x7FFFFF) << 40
            words = np.frombuffer(b"".join(ds), "<i8")
            out["doc_id"] += [doc] * len(ds)
            out["d1"] += words[::2].tolist()
            out["d2"] += words[1::2].tolist()
            out["at"] += [tag | a << 9 | (b - a) for a, b in spans]
        return out

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                     run, f"doc_id {kind}, d1 long, d2 long, at long")


def later_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, d1, d2, at, first``: arrays for each document with chunks of an earlier
    document: their digests, places and first documents (its own size bounds them)."""
    shared = materialize(digests(docs, id_col, text_col).groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                         .where("first < last").select("d1", "d2", "first"), "chunks")
    later = places(docs, id_col, text_col).join(shared, ["d1", "d2"]).where("doc_id > first")
    fields = ("d1", "d2", "at", "first")
    return later.groupBy("doc_id").agg(F.collect_set(F.struct(*fields)).alias("c")).select("doc_id", *[F.col(f"c.{f}").alias(f) for f in fields])


def _run_ends(later: DataFrame) -> DataFrame:
    """``doc_id, d1, d2, side, first``: the chunks at the ends of runs, beside which text may
    be repeated as well."""

    def run(c):
        out = {"doc_id": [], "d1": [], "d2": [], "side": [], "first": []}
        for doc, d1, d2, at, first in zip(c["doc_id"], c["d1"], c["d2"], c["at"], c["first"]):
            spans = [(x >> 40, x >> 9 & 0x7FFFFFFF, (x >> 9 & 0x7FFFFFFF) + (x & 0x1FF)) for x in at]
            starts, stops = {(t, a) for t, a, _ in spans}, {(t, b) for t, _, b in spans}
            asked = {}
            for i, (t, a, b) in enumerate(spans):
                if a and (t, a) not in stops:
                    asked[d1[i], d2[i], LEFT] = first[i]
                if (t, b) not in starts:
                    asked[d1[i], d2[i], RIGHT] = first[i]
            for (x, y, side), f in asked.items():
                for name, value in zip(out, (doc, x, y, side, f)):
                    out[name].append(value)
        return out

    kind = dict(later.dtypes)["doc_id"]
    return arrow_map(later, run, f"doc_id {kind}, d1 long, d2 long, side int, first {kind}")


def _beside(docs: DataFrame, ends: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``d1, d2, side, bytes``: up to ``BESIDE`` bytes beside each asked chunk in its first document."""
    asked = materialize(ends.select("first", "d1", "d2", "side").distinct().groupBy("first").agg(F.collect_list(F.struct("d1", "d2", "side")).alias("a"))
                        .select("first", *[F.col(f"a.{f}").alias(f) for f in ("d1", "d2", "side")]), "asked")
    texts = docs.select(F.col(id_col).alias("first"), F.col(text_col).alias("text"))
    if asked.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(asked.select("first")), "first", "left_semi")

    def run(c):
        out = {"d1": [], "d2": [], "side": [], "bytes": []}
        for text, d1, d2, sides in zip(c["text"], c["d1"], c["d2"], c["side"]):
            data, spans, ds = _digests(text)
            place = dict(zip(reversed(ds), reversed(spans)))
            for i, (d, side) in enumerate(zip(_joined(d1, d2), sides)):
                if at := place.get(d):
                    got = data[max(0, at[0] - BESIDE):at[0]] if side == LEFT else data[at[1]:at[1] + BESIDE]
                    for name, value in zip(out, (d1[i], d2[i], side, got)):
                        out[name].append(value)
        return out

    found = arrow_map(texts.join(asked, "first"), run, "d1 long, d2 long, side int, bytes binary")
    return found.groupBy("d1", "d2", "side").agg(F.min("bytes").alias("bytes"))  # rows that repeat an id


def _joined(d1: list[int] | None, d2: list[int] | None) -> list[bytes]:
    both = np.array([d1 or [], d2 or []], "<i8").T.tobytes()
    return [both[i:i + 16] for i in range(0, len(both), 16)]


def _common(x: bytes, y: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(x), len(y))
    return n if x[:n] == y[:n] else next(i for i in range(n) if x[i] != y[i])


_SPACE = frozenset(b" \t\n\x0b\x0c\r")
_INNER = re.compile(rb"[A-Za-z0-9_\x80-\xff]{2}")
_EDGE = re.compile(rb"[^A-Za-z0-9_\x80-\xff]")


def _trimmed(data: bytes, s: int, a: int, b: int, e: int) -> tuple[int, int]:
    """The run [a, b) extended to [s, e), with ends on code points, not inside a word that the
    extension only reached into, and not on white space."""
    n = len(data)
    if 0 < s < a and _INNER.match(data, s - 1) and (m := _EDGE.search(data, s, min(a, s + WORD))):
        s = m.start()
    if b < e < n and _INNER.match(data, e - 1):
        edges = [m.start() for m in _EDGE.finditer(data, max(b, e - WORD), e)]
        e = edges[-1] + 1 if edges else e
    while s < e and data[s] & 0xC0 == 0x80:
        s += 1
    while s < e < n and data[e] & 0xC0 == 0x80:
        e -= 1
    while 0 < s < e and data[s] in _SPACE:
        s += 1
    while s < e < n and data[e - 1] in _SPACE:
        e -= 1
    return s, e


def repeated_spans(text: str | None, seen: set[bytes], min_passage: int = MIN_PASSAGE,
                   beside: dict[tuple[bytes, int], bytes] | None = None) -> list[tuple[int, int]]:
    """Spans (code points) of the passages to cut: runs of neighbouring chunks that are in
    ``seen`` or came before in this text, extended by what equals the bytes ``beside`` the same
    chunk where it came first, then at least ``min_passage`` characters long; or all of it."""
    data, spans, ds = _digests(text)
    beside = beside or {}
    runs: list[list[int]] = []  # first chunk, and the one after the last
    own: dict[bytes, tuple[int, int]] = {}
    for i, d in enumerate(ds):
        if d in seen or d in own:
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        own.setdefault(d, spans[i])
    if runs == [[0, len(ds)]]:
        return [(0, len(text))]
    wide: list[list[int]] = []
    for i, j in runs:
        (a, _), (_, b) = spans[i], spans[j - 1]
        p, q = own[ds[i]][0], own[ds[j - 1]][1]
        before, after = data[max(0, a - BESIDE):a][::-1], data[b:b + BESIDE]
        s = a - max(_common(before, beside.get((ds[i], LEFT), b"")[::-1]), _common(before, data[max(0, p - BESIDE):p][::-1]) if p < a else 0)
        e = b + max(_common(after, beside.get((ds[j - 1], RIGHT), b"")), _common(after, data[q:q + BESIDE]) if q < b else 0)
        s, e = _trimmed(data, s, a, b, e)
        if wide and s <= wide[-1][1]:
            wide[-1] = [min(s, wide[-1][0]), max(e, wide[-1][1])]
        else:
            wide.append([s, e])
    out, at, chars = [], 0, 0

    def position(byte: int) -> int:  # code points that start before this byte
        nonlocal at, chars
        part = np.frombuffer(data[at:byte], np.uint8)
        chars += int(((part & 0xC0) != 0x80).sum())
        at = byte
        return chars

    for a, b in wide:
        s, e = position(a), position(b)
        if e - s >= min_passage:
            out.append((s, e))
    return out


def dedup_substrings(docs: DataFrame, min_passage: int = MIN_PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with repeated passages cut out of the text, and
    ``cut_spans array<struct<start,end>>``, the spans of the original text that went."""
    later = materialize(later_chunks(docs, id_col, text_col), "later")
    ends = materialize(_run_ends(later), "ends")
    answers = materialize(_beside(docs, ends, id_col, text_col), "beside")  # a scan, so that the join may split hot digests
    near = ends.join(answers, ["d1", "d2", "side"]).groupBy("doc_id").agg(
        F.collect_list(F.struct("d1", "d2", "side", "bytes")).alias("b"))
    near = near.select("doc_id", *[F.col(f"b.{f}").alias(f"__{f}") for f in ("d1", "d2", "side", "bytes")])
    later = later.join(near, "doc_id", "left").select(F.col("doc_id").alias("__doc"), F.col("d1").alias("__s1"), F.col("d2").alias("__s2"),
                                                      "__d1", "__d2", "__side", "__bytes")
    joined = docs.join(later, docs[id_col] == later["__doc"], "left").drop("__doc")
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(c):
        texts, cuts = [], []
        for doc, text, s1, s2, d1, d2, side, near in zip(c[id_col], c[text_col], *[c[f"__{x}"] for x in ("s1", "s2", "d1", "d2", "side", "bytes")]):
            seen = set(_joined(s1, s2))
            beside = {(d, x): b for d, x, b in zip(_joined(d1, d2), side or [], near or [])}
            spans = [] if doc is None or text is None else repeated_spans(text, seen, min_passage, beside)
            kept, at = [], 0
            for s, e in spans:
                kept.append(text[at:s])
                at = e
            texts.append("".join([*kept, text[at:]]) if spans else text)
            cuts.append([{"start": s, "end": e} for s, e in spans])
        return {n: c[n] for n in names} | {text_col: texts, "cut_spans": cuts}

    return arrow_map(joined, run, f"{fields}, cut_spans array<struct<start:int,end:int>>")
