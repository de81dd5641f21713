"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

The patterns find assignments, access keys and long hex runs. The novelty method looks at
strings near sensitive words: zstandard is primed with a dictionary made of common
identifiers and the code around the string, and the string's marginal compressed bytes
(its frame less the empty frame) are measured. Ordinary identifiers and words of the
surroundings are found in the dictionary and cost little; a string that costs almost a byte
per character is incompressible there and is reported. It is measured in pieces too short for
entropy coding, so that a small alphabet (hex, base32, base64) does not make a long random
string look compressible; what came before in the string primes each piece. Strings without
a digit are measured in lower case as well, and those whose letter pairs are almost all
pairs of the identifiers (words that are not in the dictionary) are not reported.

Spans are code points, end exclusive, of the whole match. Defined results: a null text is
empty, an empty text has no spans; repeated rows get equal results; very long texts are
scanned whole, in linear time, with windows only around the strings. Only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
import re

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.llm.common import arrow_map

# FIXED VALUES — the base patterns of the contract; letters of the keywords in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
MIN_ASSIGN, MIN_ACCESS = 6, 20

#: Stems of which a text must hold one before its assignments or contexts are searched.
STEMS = ("pass", "pwd", "secret", "token", "api", "credential", "auth", "bearer", "private", "access")
SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|api[ _-]?key|credential|authorization|bearer|private[ _-]?key|access[ _-]?key", re.ASCII | re.IGNORECASE)
STRING = re.compile(r"[A-Za-z0-9+/_=-]+")
#: A string is a candidate if it starts at most REACH characters after a sensitive word, has
#: MIN_NOVEL characters or more, and holds a letter.
REACH, MIN_NOVEL = 48, 16
#: Characters of code on each side that prime the dictionary.
AROUND = 400
#: Marginal bytes per character from which a string counts as incompressible, characters of a
#: piece at most, and characters before a piece of a very long string that prime its dictionary.
MIN_RATIO = 0.9
PIECE, BEFORE = 32, 4096
#: Share of letter pairs known from identifiers from which a string without a digit is words.
WORDLIKE = 0.85

IDENTIFIERS = """
abstract access account action address algorithm application argument array async attribute authentication
authorization background base64 boolean buffer button bytes cache callback certificate character charset
class client collection command comment component config configuration connection const constructor
container content context controller cookie count create credential customer data database date debug
default delete description destination development device directory document domain download element
email enable encoding encryption endpoint environment error event example exception execute export
extension factory false field file filter final finally float folder format function generate get global
group handler hash header height host html http https identifier image implementation import index
information initialize input insert instance integer interface internal item iterator json key language
length library limit list listener load local location logger login main manager map message metadata
method model module name namespace network null number object offset operation option order output
package page parameter parent parse password path pattern payload permission plugin policy port post
prefix primary print private process production profile project property protected protocol provider
proxy public query queue random read record reference region register registry remote remove render
replace repository request required reset resource response result return role root route schema script
search secret security select self sequence server service session setting size socket source state
static status storage stream string structure submit subscription success suffix switch system table
target task template test text thread time timestamp title token transaction true type undefined unique
update upload user username utils validate value variable vector version view virtual void volume
warning width window worker write xml yaml 0123456789 2020 2021 2022 2023 2024 2025
""".encode()


def marginal_bytes(string: str, around: str) -> int:
    """Compressed bytes that ``string`` adds when the identifiers and its surroundings are known."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=12, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(pack.compress(string.encode("utf-8", "replace"))) - len(pack.compress(b""))


PAIRS = frozenset(w[i:i + 2] for w in IDENTIFIERS.decode().split() for i in range(len(w) - 1) if w.isalpha())


def incompressible(text: str, s: int, e: int, low: bool = False) -> bool:
    """Whether the pieces of ``text[s:e]`` cost ``MIN_RATIO`` bytes a character in all; in lower
    case, with its surroundings, if ``low``. Ends as soon as they cannot reach it."""
    n = -(-(e - s) // PIECE)
    edges = [s + (e - s) * i // n for i in range(n + 1)]
    spare = (1 - MIN_RATIO) * (e - s)
    cased = str.lower if low else str
    for a, b in zip(edges, edges[1:]):
        around = text[max(0, s - AROUND, a - BEFORE):a] + "\n" + text[e:e + AROUND]
        spare -= (b - a) - marginal_bytes(cased(text[a:b]), cased(around))
        if spare < -1e-9:
            return False
    return True


def wordlike(string: str) -> bool:
    low = string.lower()
    pairs = [low[i:i + 2] for i in range(len(low) - 1) if low[i:i + 2].isalpha()]
    return sum(p in PAIRS for p in pairs) >= WORDLIKE * len(pairs)


def base_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    out = []
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def novel_spans(text: str, low: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Incompressible strings in sensitive contexts that no base span touches."""
    if not any(s in low for s in STEMS):
        return []
    out, done = [], 0
    taken = sorted(taken)
    at = 0
    for word in SENSITIVE.finditer(text):
        for m in STRING.finditer(text, max(word.end(), done)):
            if m.start() > word.end() + REACH:
                break
            done = m.end()
            s, e = m.span()
            if e - s < MIN_NOVEL:
                continue
            got = m.group()
            if not any(c.isalpha() for c in got):
                continue
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if any(b < e and a > s for b, a, _ in taken[at:at + len(KINDS)]):
                continue
            words = not any(c.isdigit() for c in got)
            if words and wordlike(got):
                continue
            if incompressible(text, s, e) and not (words and not incompressible(text, s, e, low=True)):
                out.append((s, e, "novel"))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(text: str | None) -> dict:
    text = text or ""
    low = text.lower()
    order = lambda x: (x[0], KINDS.index(x[2]))
    base = sorted(base_spans(text, low), key=order)
    found = sorted(base + novel_spans(text, low, base), key=order)
    n = lambda k: sum(x[2] == k for x in found)
    return {"n_assign": n("assign"), "n_access": n("access"), "n_hex": n("hex"),
            "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(),
            "spans": _joined(found), "n_novel": n("novel")}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts by kind, the digest of the base spans, all spans."""

    def run(c):
        rows = [scan(t) for t in c["text"]]
        return {"doc_id": c["doc_id"]} | {k: [r[k] for r in rows] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")}

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run,
                     f"doc_id {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
