"""Best-fit packing from a histogram of lengths.

Documents become token pieces of at most ``capacity`` tokens; only longer documents are cut.
The planner sees the histogram alone (at most ``capacity`` counts) and packs counts rather
than pieces: best fit, longest length first, in which equally filled sequences are taken
many at a time. The plan's rows are runs "the next n pieces of this length go to sequences
s, s+1, ... at this offset"; their number depends on the histogram's width, not on the
documents. Pieces then take the planned slots by a join on length and rank: ranks within a
length come from counts per (length, hash bucket) and a row number inside a bucket, so the
commonest length is spread over many tasks.

Defined results: a null or empty text is the end id alone, one piece of one token; rows
that repeat an id are packed separately, each its own pieces; an empty table gives an empty
result. Only the id and text columns are read.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prioscope.llm.common import arrow_map
from prioscope.session import materialize

CAPACITY = 1024
END_ID = 2
#: Hash buckets of one length; ranks are counted bucket by bucket.
RANK_BUCKETS = 256
#: Words whose ids one Python worker keeps at most.
CACHE_WORDS = 600_000

_MIXED = re.compile(r" \s|\s ")
_DOUBLE = re.compile(r"\s\s")
_TOKENIZERS: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable Latin-1 stands for itself, the other
    bytes for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in own]
    return {x: chr(x) for x in own} | {x: chr(256 + i) for i, x in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit ids."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Encoder:
    """Ids of whole texts. A byte-level vocabulary starts a new token at every space that
    follows no other white space, at a word's end and at a line's end, so the words between
    single spaces are encoded once and kept; texts with other runs of white space, and all
    texts under another kind of tokenizer, are encoded as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        cut = t.pre_tokenizer
        self.by_word = (isinstance(t.model, models.BPE) and t.normalizer is None and isinstance(cut, pre_tokenizers.ByteLevel)
                        and not cut.add_prefix_space and cut.use_regex)
        self.model = t.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.marks = {m: self._whole(m) for m in ",.\n"}

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _word(self, word: str) -> bytes:
        """Letters, with a space in front or not: one piece for the merges."""
        # ASCII letters stand for themselves, so only the space changes
        piece = word.replace(" ", self.letters[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(piece)])

    def _new(self, part: str, lead: str) -> bytes:
        if part.isalpha():
            return self._word(lead + part)
        if part[-1:] in (",", ".") and part[:-1].isalpha():
            stem = self._kept(part[:-1]) if lead else self._word(part[:-1])
            return stem + self.marks[part[-1]]
        if part.count("\n") == 1 and part[0] != "\n" and part[-1] != "\n" and not _DOUBLE.search(part):
            left, right = part.split("\n")
            return self._new(left, lead) + self.marks["\n"] + self._new(right, "")
        return self._whole(lead + part)

    def _kept(self, part: str) -> bytes:
        b = self.known.get(part)
        if b is None:
            b = self.known[part] = self._new(part, " ")
        return b

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = []
        for text in texts:
            text = text or ""
            if not self.by_word or _MIXED.search(text):
                out.append(self._whole(text))
                continue
            first, *rest = text.split(" ")
            known = self.known
            if len(known) > CACHE_WORDS:
                known.clear()
            for part in set(rest).difference(known):
                self._kept(part)
            out.append(b"".join([self._new(first, "") if first else b"", *[known[w] for w in rest]]))
        return out


def _encoder(path: str) -> _Encoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Encoder(path)
    return _TOKENIZERS[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` ids: full pieces, a shorter one in front."""
    head = n % capacity
    at = [0] if head else []
    at += range(head, n, capacity)
    return [(a, min(b, n) - a) for a, b in zip(at, [*at[1:], n])]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(c):
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, ids in zip(c["doc_id"], _encoder(path).ids(c["text"])):
            ids += end
            for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                for k, v in (("doc_id", doc), ("piece", i), ("start", start), ("length", length),
                             ("ids_crc32", zlib.crc32(ids[4 * start:4 * (start + length)]))):
                    out[k].append(v)
        return out

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run,
                     f"doc_id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: rows ``(length, first_rank, n, first_sequence, offset)``.

    Open sequences are kept as runs of neighbours with equal room. A length's pieces go to
    the tightest room that holds them, a whole run at a time, then to new sequences.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)
    open_rooms: list[int] = []  # sorted
    out, sequences = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(open_rooms, room)
            rooms[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(open_rooms, length)
            if i < len(open_rooms):
                room = open_rooms[i]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], open_rooms[i]
                use = min(n, left)
                out.append((length, rank, use, first, capacity - room))
                if use < n:
                    leave(room, first + use, n - use)
                leave(room - length, first, use)
                rank, left = rank + use, left - use
            else:
                each = capacity // length  # equal pieces side by side in new sequences
                whole = left // each
                if whole:
                    for k in range(each):
                        out.append((length, rank + k * whole, whole, sequences, k * length))
                    leave(capacity - each * length, sequences, whole)
                    sequences, rank, left = sequences + whole, rank + each * whole, left - each * whole
                if left:
                    for k in range(left):
                        out.append((length, rank + k, 1, sequences, k * length))
                    leave(capacity - left * length, sequences, 1)
                    sequences, left = sequences + 1, 0
    return out


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, rank_buckets: int = RANK_BUCKETS) -> DataFrame:
    """``cut_pieces`` with ``sequence_id`` and ``offset``. The histogram (at most
    ``capacity`` rows) is all the driver sees."""
    spark = cut_pieces.sparkSession
    rows = materialize(cut_pieces, "pieces")
    hist = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan(hist, capacity) or [(0, 0, 0, 0, 0)],
                                  "p_length long, p_rank long, p_n long, p_sequence long, p_offset long")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(rank_buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    # Slots are joined on length and on rank blocks of a power of two, so that a common
    # length with many runs stays an equality join.
    block = 1 << 12
    cells = slots.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("p_rank") / block), F.floor((F.col("p_rank") + F.greatest(F.col("p_n") - 1, F.lit(0))) / block))))
    hit = ((F.col("length") == F.col("p_length")) & (F.floor(F.col("rank") / block) == F.col("cell"))
           & (F.col("rank") >= F.col("p_rank")) & (F.col("rank") < F.col("p_rank") + F.col("p_n")))
    return ranked.join(cells, hit).select(
        *cut_pieces.columns, (F.col("p_sequence") + F.col("rank") - F.col("p_rank")).alias("sequence_id"), F.col("p_offset").alias("offset"))
