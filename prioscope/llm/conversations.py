"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's rows are read in order of their turns. Keeping, re-roling or deleting rows
and inserting empty ones must give roles of the form ``(s?(ua)+)?`` at the least cost; among
the cheapest edit sequences the one whose initials (the audit) are least in ASCII counts.

What has been given so far is one of four states (nothing, s, u, a). A row is a 4 x 4 table
of costs between the states before and after it, insertions before the row included.
Forward cost vectors of the first half and backward ones of the second half meet in the
middle; the cheapest crossing state is taken, then both halves are solved alone, in linear
space. Beside each forward cost goes the *rank* of its state's least audit among the four
states. Audits that end with the same row's edit are never prefixes of one another, so the
rank alone settles ties between crossings, and no audit is kept during the passes.

The same halving runs over Spark. Rows get a position (a range sort), and 4,096 consecutive
positions of a conversation make a block, which one task sums up as a 4 x 4 table of
costs and ranks. Up to 4,096 tables of blocks make the table of a larger node, until a
conversation is one node; going down again each node fixes the crossing states between its
children, and at last every block is solved alone between its two states. So no task holds
a conversation, however long. Only two columns of the report grow with a conversation: its
audit, and the SHA-256 of the repaired text, which is streamed row by row by one task (the
hash has no parallel form). ``repaired_rows`` gives the rows themselves, block by block.

Defined results: null roles and texts are one space; null turns come first; rows of one turn
go by role, then by the text's MD5; equal rows are told apart by nothing and the first is
kept; null conversation ids are one conversation; role initials are case-sensitive, and a
role without a known initial (an empty one too) cannot be kept. Only the named columns are
read, so clashing extra columns do no harm. An empty table gives an empty report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prioscope.llm.common import SPACES, arrow_map, find_package
from prioscope.session import materialize

KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3
#: Bits of the positions in a block, and of the nodes under one node.
BLOCK_BITS = 12
FAN_BITS = 12
INF = 1 << 60

#: States: nothing given, s, u, a. Roles: s, u, a, any other.
_NEXT = (2, 2, 3, 2)  # the state after an inserted or re-roled row
_KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # (state, role) -> state
_ROLE = {2: "user", 3: "assistant"}
#: Insertions that end a conversation from each state.
TAIL = ("", "II", "I", "")

OK, BLANK, DUPLICATE, TRUNCATED = range(4)
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _step(role: int, fault: int) -> list[tuple[int, str]]:
    """Least (cost, edits) of one row from state p to state q, at 4 p + q."""
    best = [(INF, "")] * 16
    for p in range(4):
        at = p
        for k in range(3):  # a third insertion only comes back to a state of the first
            moves = [("D", DELETE, at)]
            if fault in (OK, TRUNCATED):
                more = MEND if fault == TRUNCATED else 0
                moves.append(("R", REROLE + more, _NEXT[at]))
                if (at, role) in _KEPT:
                    moves.append(("K", KEEP + more, _KEPT[at, role]))
            for name, cost, q in moves:
                best[4 * p + q] = min(best[4 * p + q], (INSERT * k + cost, "I" * k + name))
            at = _NEXT[at]
    return best


#: A row's code is 4 x fault + role.
STEPS = [_step(code % 4, code // 4) for code in range(16)]


def _advance(vector: tuple, step) -> tuple[tuple, int]:
    """(cost, rank) of each state after ``step``, less the least cost, and that cost."""
    found = []
    for q in range(4):
        ways = [(vector[p][0] + step[4 * p + q][0], vector[p][1], step[4 * p + q][1]) for p in range(4)
                if vector[p][0] < INF and step[4 * p + q][0] < INF]
        found.append(min(ways) if ways else None)
    order = sorted(w[1:] for w in found if w)
    low = min(w[0] for w in found if w)
    return tuple((w[0] - low, order.index(w[1:])) if w else (INF, -1) for w in found), low


def _retreat(costs: tuple, step) -> tuple:
    got = [min(step[4 * p + r][0] + costs[r] for r in range(4)) for p in range(4)]
    low = min(got)
    return tuple(c - low if c < INF else INF for c in got)


@lru_cache(maxsize=1 << 16)
def _advance_code(vector: tuple, code: int) -> tuple[tuple, int]:
    """Vectors less their least cost are few, so rows become look-ups."""
    return _advance(vector, STEPS[code])


@lru_cache(maxsize=1 << 16)
def _retreat_code(costs: tuple, code: int) -> tuple:
    return _retreat(costs, STEPS[code])


def forward(steps, p: int) -> tuple[tuple, int]:
    """Costs and ranks after ``steps`` (codes as bytes, or tables of nodes) from state ``p``."""
    vector, base = tuple((0, 0) if s == p else (INF, -1) for s in range(4)), 0
    go = _advance_code if isinstance(steps, bytes) else _advance
    for s in steps:
        vector, low = go(vector, s)
        base += low
    return vector, base


def backward(steps, q: int) -> tuple:
    """Costs, less the least, from each state before ``steps`` to state ``q`` behind them."""
    costs = tuple(0 if s == q else INF for s in range(4))
    go = _retreat_code if isinstance(steps, bytes) else _retreat
    for s in reversed(steps):
        costs = go(costs, s)
    return costs


def crossings(steps, p: int, q: int) -> list[int]:
    """The state after each step on the audit-least of the cheapest ways from ``p`` to ``q``."""
    if len(steps) <= 1:
        return [q] * len(steps)
    mid = len(steps) // 2
    ahead, behind = forward(steps[:mid], p)[0], backward(steps[mid:], q)
    r = min((ahead[s][0] + behind[s], ahead[s][1], s) for s in range(4) if ahead[s][0] < INF and behind[s] < INF)[2]
    return crossings(steps[:mid], p, r) + crossings(steps[mid:], r, q)


def table_of(steps) -> list[tuple[int, int]]:
    """(cost, rank) between the states around ``steps``, at 4 p + q."""
    out = []
    for p in range(4):
        vector, base = forward(steps, p)
        out += [(c + base, r) if c < INF else (INF, -1) for c, r in vector]
    return out


def last_state(row: list[tuple[int, int]]) -> int:
    """The state to end in, given costs and ranks from the empty state."""
    return min((c + INSERT * len(TAIL[q]), r, q) for q, (c, r) in enumerate(row) if c < INF)[2]


def audit_between(codes: bytes, p: int, q: int) -> str:
    out = []
    for code, s in zip(codes, crossings(codes, p, q)):
        out.append(STEPS[code][4 * p + s][1])
        p = s
    return "".join(out)


@lru_cache(maxsize=1 << 16)
def _solve(codes: bytes) -> tuple[int, int, str, str, int]:
    """Cost, end state, audit, tail and illegal neighbours of a conversation in one block."""
    vector, base = forward(codes, 0)
    q = last_state([(c + base, r) if c < INF else (INF, -1) for c, r in vector])
    return vector[q][0] + base + INSERT * len(TAIL[q]), q, audit_between(codes, 0, q), TAIL[q], illegal_pairs(codes)


def solve(codes: bytes) -> tuple[int, int, str, str, int]:
    return _solve(codes) if len(codes) <= 32 else _solve.__wrapped__(codes)


def illegal_pairs(codes: bytes) -> int:
    return sum((a % 4, b % 4) not in _LEGAL for a, b in zip(codes, codes[1:]))


# --- rows ------------------------------------------------------------------------------------

def damaged(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Rows spoilt by a checksum of their place: some dropped, emptied, cut, repeated or re-roled."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    r = convs.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"),
                     (F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")) % 20).alias("kind"))
    spoilt = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return r.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), spoilt.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def ordered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows written once in reading order under a position ``pos``. The range keys go down to the
    row, so a conversation, a turn and a group of equal rows may all span many tasks."""
    r = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                    F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    r = r.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("n", F.monotonically_increasing_id())
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "n"]
    r = r.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(r.select(F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text", "digest"), "turns")


def coded(turns: DataFrame) -> DataFrame:
    """``pos, conv_id, turn, code``: each row's first fault and role initial. The first of equal
    rows is found by a pre-aggregated minimum and joined back by position, which no group skews."""
    body = F.btrim("text", F.lit(SPACES))
    first = turns.where(body != "").groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    light = turns.select("pos", "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), (body == "").alias("blank"), F.right(body, F.lit(1)).alias("end"))
    fault = (F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE)
             .when(~F.col("end").isin(".", "!", "?"), TRUNCATED).otherwise(OK))
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    return light.join(first, "pos", "left").select("pos", "conv_id", "turn", (fault * 4 + role).alias("code"))


def facts(codes: DataFrame) -> DataFrame:
    """Counts per conversation and the positions it spans; ``lo`` is its key from here on."""
    def count(fault: int) -> Column:
        return F.count(F.when(F.floor(F.col("code") / 4) == fault, 1))

    return codes.groupBy("conv_id").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"))


# --- blocks and nodes ------------------------------------------------------------------------

_NODE = "lo long, hi long, at long, cost array<long>, rank array<int>, first int, last int, illegal long"


def _tables(costs, ranks) -> list[tuple[int, int]]:
    return list(zip(costs, ranks))


def _node(table, first, last, illegal) -> dict:
    return {"cost": [c for c, _ in table], "rank": [r for _, r in table], "first": first, "last": last, "illegal": illegal}


def _columns(rows: list[dict], names) -> dict[str, list]:
    return {n: [r[n] for r in rows] for n in names}


def _summarise(c: dict[str, list]) -> dict[str, list]:
    rows = []
    for lo, hi, at, codes in zip(c["lo"], c["hi"], c["at"], map(bytes, c["codes"])):
        rows.append({"lo": lo, "hi": hi, "at": at, **_node(table_of(codes), codes[0] % 4, codes[-1] % 4, illegal_pairs(codes))})
    return _columns(rows, ("lo", "hi", "at", "cost", "rank", "first", "last", "illegal"))


def _combine(c: dict[str, list]) -> dict[str, list]:
    rows = []
    for lo, hi, kids in zip(c["lo"], c["hi"], c["kids"]):
        table = table_of([_tables(k["cost"], k["rank"]) for k in kids])
        illegal = sum(k["illegal"] for k in kids) + sum((a["last"], b["first"]) not in _LEGAL for a, b in zip(kids, kids[1:]))
        rows.append({"lo": lo, "hi": hi, "at": kids[0]["at"], "kids": kids, **_node(table, kids[0]["first"], kids[-1]["last"], illegal)})
    return _columns(rows, ("lo", "hi", "at", "cost", "rank", "first", "last", "illegal", "kids"))


def _descend(c: dict[str, list]) -> dict[str, list]:
    """States around each child; a conversation's own node (p null) starts empty and picks its end."""
    out = {"at": [], "p": [], "q": []}
    for costs, ranks, kids, p, q in zip(c["cost"], c["rank"], c["kids"], c["p"], c["q"]):
        if p is None:
            p, q = 0, last_state(_tables(costs, ranks)[:4])
        for kid, s in zip(kids, crossings([_tables(k["cost"], k["rank"]) for k in kids], p, q)):
            out["at"].append(kid["at"])
            out["p"].append(p)
            out["q"].append(s)
            p = s
    return out


def _ends(c: dict[str, list]) -> dict[str, list]:
    out = {"lo": c["lo"], "cost": [], "illegal": c["illegal"]}
    for costs, ranks in zip(c["cost"], c["rank"]):
        q = last_state(_tables(costs, ranks)[:4])
        out["cost"].append(costs[q] + INSERT * len(TAIL[q]))
    return out


_SOLVED = "lo long, at long, conv_id {}, p int, audit string, tail string, cost long, illegal long"


def solved_blocks(codes: DataFrame, found: DataFrame, block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame]:
    """``(blocks, ends)``: the audit of each block with its first state, and cost and illegal
    neighbours of the conversations that span several blocks (the others have them in their block)."""
    kind = dict(codes.dtypes)["conv_id"]
    per_block = codes.groupBy("conv_id", F.shiftright("pos", block_bits).alias("b")).agg(
        F.min("pos").alias("at"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("codes"))
    spans = found.select(F.col("conv_id").alias("c"), "lo", "hi")
    blocks = materialize(per_block.join(spans, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "lo", "hi", "at", "codes"), "blocks")

    def alone(bits: int) -> Column:
        bits = min(bits, 62)
        return F.shiftright("lo", bits) == F.shiftright("hi", bits)

    def whole(c):
        got = [solve(bytes(x)) for x in c["codes"]]
        return {"lo": c["lo"], "at": c["at"], "conv_id": c["conv_id"], "p": [0] * len(got), "audit": [g[2] for g in got],
                "tail": [g[3] for g in got], "cost": [g[0] for g in got], "illegal": [g[4] for g in got]}

    one = arrow_map(blocks.where(alone(block_bits)), whole, _SOLVED.format(kind))
    many = blocks.where(~alone(block_bits))
    spark = codes.sparkSession
    if many.isEmpty():
        return one, spark.createDataFrame([], "lo long, cost long, illegal long")

    nodes, levels, bits = materialize(arrow_map(many.drop("conv_id"), _summarise, _NODE), "nodes"), [], block_bits
    while True:
        bits += fan_bits
        parts = nodes.groupBy("lo", "hi", F.shiftright("at", min(bits, 62)).alias("b")).agg(
            F.sort_array(F.collect_list(F.struct("at", "cost", "rank", "first", "last", "illegal"))).alias("kids")).drop("b")
        kids = dict(parts.dtypes)["kids"]
        nodes = materialize(arrow_map(parts, _combine, f"{_NODE}, kids {kids}"), "nodes")
        levels.append((bits, nodes))
        nodes = nodes.where(~alone(bits)).drop("kids")
        if nodes.isEmpty():
            break

    given, ends = None, []
    for bits, nodes in reversed(levels):
        done = nodes.where(alone(bits))
        ends.append(arrow_map(done.select("lo", "cost", "rank", "illegal"), _ends, "lo long, cost long, illegal long"))
        work = done.select("cost", "rank", "kids", F.lit(None).cast("int").alias("p"), F.lit(None).cast("int").alias("q"))
        if given is not None:
            work = work.union(nodes.where(~alone(bits)).join(given, "at").select("cost", "rank", "kids", "p", "q"))
        given = materialize(arrow_map(work, _descend, "at long, p int, q int"), "crossings")

    def between(c):
        return {"lo": c["lo"], "at": c["at"], "conv_id": c["conv_id"], "p": c["p"],
                "audit": [audit_between(bytes(x), p, q) for x, p, q in zip(c["codes"], c["p"], c["q"])],
                "tail": [TAIL[q] if end else "" for q, end in zip(c["q"], c["end"])],
                "cost": [None] * len(c["lo"]), "illegal": [None] * len(c["lo"])}

    end = F.shiftright("at", block_bits) == F.shiftright("hi", block_bits)
    several = arrow_map(many.join(given, "at").withColumn("end", end), between, _SOLVED.format(kind))
    all_ends = ends[0]
    for e in ends[1:]:
        all_ends = all_ends.union(e)
    return one.union(several), materialize(all_ends, "ends")


# --- repaired rows ---------------------------------------------------------------------------

def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(lo, pos, place, role, text)`` of repaired rows, from blocks and rows sorted by position."""
    audit, at, state, lo, tail = "", 0, 0, None, ""
    for b in batches:
        for pos, kind, key, p, edits, end, role, text in zip(*(b.column(n).to_pylist() for n in ("pos", "kind", "lo", "p", "audit", "tail", "role", "text"))):
            if kind == 0:
                audit, at, state, lo, tail = edits, 0, p, key, end
                if not audit:
                    yield lo, None, 0, "", ""
                continue
            place = 0
            while audit[at] == "I":
                state = _NEXT[state]
                yield lo, pos, place, _ROLE[state], ""
                at, place = at + 1, place + 1
            if audit[at] == "R":
                state = _NEXT[state]
                yield lo, pos, 2, _ROLE[state], text
            elif audit[at] == "K":
                state = _KEPT[state, "sua".index(role[0])]
                yield lo, pos, 2, role, text
            else:
                yield lo, None, 0, "", ""
            at += 1
            if at == len(audit):
                for k in range(len(tail)):
                    state = _NEXT[state]
                    yield lo, pos, 3 + k, _ROLE[state], ""


def _merged(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    rows = turns.select("pos", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("int").alias("p"),
                        null.alias("audit"), null.alias("tail"), "role", "text", "conv_id")
    heads = blocks.select(F.col("at").alias("pos"), F.lit(0).alias("kind"), "lo", "p", "audit", "tail", null.alias("role"), null.alias("text"), "conv_id")
    return heads.union(rows)


def repaired_rows(turns: DataFrame, blocks: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``lo, pos, place, role, text``: the repaired rows, in order of ``pos, place`` within a
    conversation ``lo``; inserted rows carry the position of the row they stand beside."""
    find_package(turns.sparkSession)
    schema = pa.schema([("lo", pa.int64()), ("pos", pa.int64()), ("place", pa.int32()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        held: list[tuple] = []
        for row in _replayed(batches):
            if row[1] is not None:
                held.append(row)
            if len(held) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*held), schema)], schema=schema)

    together = _merged(turns, blocks).drop("conv_id").repartition(F.shiftright("pos", block_bits)).sortWithinPartitions("pos", "kind")
    return together.mapInArrow(run, "lo long, pos long, place int, role string, text string")


def digests(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    """``lo, repaired_sha256``: SHA-256 of the repaired ``role:text`` rows, newline-joined, streamed."""
    find_package(turns.sparkSession)
    schema = pa.schema([("lo", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches):
        lo, sha, some, out = None, None, False, []
        for key, pos, _, role, text in _replayed(batches):
            if key != lo:
                if lo is not None:
                    out.append((lo, sha.hexdigest()))
                lo, sha, some = key, hashlib.sha256(), False
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], schema=schema)
                    out = []
            if pos is not None:
                sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True
        if lo is not None:
            out.append((lo, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], schema=schema)

    together = _merged(turns, blocks).repartition("conv_id").sortWithinPartitions("pos", "kind").drop("conv_id")
    return together.mapInArrow(run, "lo long, repaired_sha256 string")


def report(rows: DataFrame, block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text)``: faults, the cheapest
    repair's cost and audit, and the digest of the repaired text."""
    turns = ordered(rows)
    codes = materialize(coded(turns), "codes")
    found = materialize(facts(codes), "conversations")
    blocks, ends = solved_blocks(codes, found, block_bits, fan_bits)
    blocks = materialize(blocks, "solved")
    audits = blocks.groupBy("lo").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.concat("audit", "tail").alias("a")))), lambda x: x["a"]), "").alias("audit"),
        F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    ends = ends.select("lo", F.col("cost").alias("c"), F.col("illegal").alias("i"))
    return (found.join(audits, "lo").join(ends, "lo", "left").join(digests(turns, blocks), "lo")
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", "i").alias("illegal"),
                    F.coalesce("cost", "c").alias("cost"), "audit", "repaired_sha256"))


def repair_report(convs: DataFrame, **bits: int) -> DataFrame:
    """``report`` over the damaged rows, with every conversation of ``convs``; one of which no row
    is left has zeros, an empty audit and the digest of the empty text."""
    ids = convs.select(F.col("conv_id").alias("original")).distinct()
    got = report(damaged(convs), **bits)
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(got, F.col("original").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("original").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
