"""Conversation repair: brute force, blocks and nodes of small sizes, SQL and the defined cases."""

import hashlib
import itertools
import random

import duckdb
import pyarrow as pa
import pytest

from prioscope.llm import conversations as C
from prioscope.llm import oracle, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, pos string, digest int, code string"


def brute(codes):
    """Every cheapest edit sequence over all rows, the least of them."""
    best = {0: (0, "")}
    for code in codes:
        role, fault, after = "sua?"[code % 4], code // 4, {}
        for state, (cost, audit) in best.items():
            for k in range(4):
                s, text = state, audit + "I" * k
                for _ in range(k):
                    s = {0: 2, 1: 2, 2: 3, 3: 2}[s]
                ways = [(s, 4, "D")]
                if fault in (0, 3):
                    more = 3 if fault == 3 else 0
                    ways.append(({0: 2, 1: 2, 2: 3, 3: 2}[s], 3 + more, "R"))
                    if role in {0: "su", 1: "u", 2: "a", 3: "u"}[s]:
                        ways.append(("sua".index(role) + 1, more, "K"))
                for q, c, op in ways:
                    after[q] = min(after.get(q, (1 << 60, "")), (cost + 3 * k + c, text + op))
        best = after
    return min((cost + 3 * len(t), audit + t) for s, (cost, audit) in best.items() for t in [{0: "", 1: "II", 2: "I", 3: ""}[s]])


def test_halving_equals_brute_force():
    rnd = random.Random(3)
    short = [bytes(x) for n in range(4) for x in itertools.product((0, 1, 2, 3, 4, 12, 13, 14), repeat=n)]
    long_ = [bytes(rnd.choices(range(16), k=rnd.randrange(4, 70))) for _ in range(300)]
    for codes in short[1:] + long_:
        cost, _, audit, tail, _ = C.solve(codes)
        assert (cost, audit + tail) == brute(codes), codes


def test_tables_of_parts_make_the_table_of_the_whole():
    rnd = random.Random(4)
    for _ in range(100):
        codes = bytes(rnd.choices(range(16), k=40))
        parts = [codes[i:i + 7] for i in range(0, 40, 7)]
        tables = [C.table_of(p) for p in parts]
        assert C.table_of(tables) == C.table_of(codes)
        q = C.last_state(C.table_of(codes)[:4])
        p, audit = 0, ""
        for part, s in zip(parts, C.crossings(tables, 0, q)):
            audit += C.audit_between(part, p, s)
            p = s
        assert audit + C.TAIL[q] == brute(codes)[1]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def check(spark, rows, **bits):
    got = C.repair_report(frame(spark, rows), **bits)
    con = duckdb.connect()
    con.register("conversations", pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(
        (("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}))
    want = con.execute(oracle.CONVERSATION_REPAIR)
    names = [d[0] for d in want.description]
    assert got.columns == names
    key = lambda r: (r[0] is not None, r[0] or 0)
    out = sorted((tuple(r) for r in got.collect()), key=key)
    assert out == sorted(want.fetchall(), key=key)
    return {r[0]: r for r in out}


def test_conversation_repair_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = sorted(con.execute(queries.ORACLE_SQL["op12_conversation_repair"]).fetchall())
    assert sorted(tuple(r) for r in queries.op12_conversation_repair(spark, SF).collect()) == want


ROLES = ["user", "assistant", "system", "tool", "User", "", None]
TEXTS = ["Yes.", "no", "Well!", "", " \n", None, "What? ", "é ü.", "a.b"]


def test_defined_cases(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([0, 1, 2, 9, None]), rnd.choice(ROLES), rnd.choice(TEXTS)) for _ in range(120)]
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", "word " * 40_000 + ".") for t in range(4)]
    gone = next(i for i in range(1000, 2000) if __import__("zlib").crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Lost."))
    got = check(spark, rows)
    assert got[gone][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert None in got


def test_long_conversation_over_many_blocks_and_nodes(spark):
    rnd = random.Random(6)
    rows = [(7, t, rnd.choice(["user", "assistant", "assistant", "user", "system"]), rnd.choice(["Fine.", "cut", f"t{t}.", f"u{t}!", ""])) for t in range(400)]
    rows += [(8, 0, "user", "Same.")] * 90 + [(9, t, "user" if t % 2 == 0 else "assistant", f"ok {t}.") for t in range(6)]
    check(spark, rows, block_bits=3, fan_bits=6)


def test_repaired_rows_give_the_digest(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("assistant", "Hi."), ("user", "a"), ("user", "b."), ("system", "c.")] * 5)]
    turns = C.ordered(frame(spark, rows))
    codes = C.coded(turns)
    blocks, _ = C.solved_blocks(codes, C.facts(codes), 2, 6)
    got = sorted(tuple(r) for r in C.repaired_rows(turns, blocks, 2).collect())
    text = "\n".join(f"{r[3]}:{r[4]}" for r in got)
    assert C.digests(turns, blocks).first()["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert C.repair_report(frame(spark, [])).collect() == []
    with pytest.raises(Exception, match="conv_id"):
        C.repair_report(spark.createDataFrame([(1,)], "x int"))
