"""The corpus pipeline, stage by stage against brute force, and its registration."""

import re

import numpy as np

import __spark_entry__ as E
import corpus_pipeline as P
from prioscope.llm import mixing, packing, simhash, toxicity
from prioscope.llm.common import table
from prioscope.session import materialize
from test_group_operators import brute_fingerprint, brute_lines, check_packing, union, whole_ids

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_query_is_registered():
    names = E.queries()
    assert [n for n in names if re.match(r"op\d+_", n)] == sorted((n for n in names if re.match(r"op\d+_", n)), key=lambda n: int(n[2:].split("_")[0]))
    assert sum(bool(re.match(r"op\d+_", n)) for n in names) == 13 and "pipeline" in names
    assert [s for s, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]


def test_stages_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    # toxicity: what the same model rejects goes, all else stays as it is
    clean = materialize(P.drop_toxic(spark, docs, SF), "t")
    model = toxicity.fit(docs, table(spark, SF, "labels").where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert clean.columns == COLUMNS
    assert {r["doc_id"]: r for r in clean.collect()} == {i: rows[i] for i, s in scores.items() if s < 0.7}
    # lines
    lined = materialize(P.drop_repeated_lines(spark, clean, SF), "l")
    before = [(r["doc_id"], r["text"]) for r in clean.collect()]
    gone = brute_lines(before)
    got = {r["doc_id"]: r for r in lined.collect()}
    assert lined.columns == COLUMNS and len(got) == len(before)
    kept = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in before}
    same = sum(got[i]["text"] == kept[i] for i in kept)
    assert same >= 0.99 * len(kept) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    # SimHash: the smallest id of each component
    first = materialize(P.drop_near_copies(spark, lined, SF), "s")
    fp = {i: brute_fingerprint(r["text"]) for i, r in got.items()}
    ids = sorted(fp)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (fp[a] ^ fp[b]).bit_count() <= simhash.MAX_BITS]
    comp = union(pairs, ids)
    assert {r["doc_id"]: r["text"] for r in first.collect()} == {i: got[i]["text"] for i in ids if comp[i] == i}
    # mixing: as many words of each document as the plan says
    mixed = materialize(P.mix_sources(spark, first, SF), "m")
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(first).collect() if r["taken"]}
    words: dict = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert mixed.columns == COLUMNS and words == plan
    # packing: every token of every row is in one place
    packed = materialize(P.pack_sequences(spark, mixed, SF), "p").collect()
    lengths = sorted(n for r in mixed.collect() for _, n in packing.cut(len(whole_ids(r["text"]))))
    assert sorted(r["length"] for r in packed) == lengths
    once = {r["doc_id"]: whole_ids(r["text"]) for r in mixed.collect()}
    unique = {i for i in once if plan[i] <= rows_size(once, i)}
    seqs: dict = {}
    for r in packed:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(np.cumsum([0, *[n for _, n in sorted(p)]])[:-1].tolist() == [o for o, _ in sorted(p)] for p in seqs.values())
    assert unique


def rows_size(once, i):
    return len(once[i])


def test_run_writes_and_rereads(spark):
    out = P.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(out.columns)
    assert out.count() > 0 and P.ORACLE_SQL is None


def plain(i, n=40):
    return " ".join(f"w{i}x{k}" for k in range(n))


def row(i, text, source="s"):
    return (i, text, "en", source, len(text or ""))


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    shared = "a line that two texts of one id share, long enough to be compared"
    rows = [row(1, f"{plain('a')}\n{shared}"), row(1, f"{shared}\n{plain('b')}"), row(None, f"{plain('c')}\n{shared}"), row(None, plain("d")), row(None, plain("d"))]
    kind = "doc_id long, text string, lang string, source string, n_chars int"
    lined = sorted((r["doc_id"] or 0, r["text"]) for r in P.drop_repeated_lines(spark, spark.createDataFrame(rows, kind), SF).collect())
    # the first place is line 0 of the second text; line 1 of the first and of the text without id go
    assert lined == sorted([(1, plain("a")), (1, f"{shared}\n{plain('b')}"), (0, plain("c")), (0, plain("d")), (0, plain("d"))])
    # one of each text: a near copy under one id, copies without id; the unique text of a repeated id stays
    near = [row(5, plain("e")), row(5, plain("e")), row(6, plain("e")), row(6, plain("f")), row(None, plain("g")), row(None, plain("g")), row(None, plain("f"))]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in P.drop_near_copies(spark, spark.createDataFrame(near, kind), SF).collect())
    assert got == sorted([(5, plain("e")), (6, plain("f")), (0, plain("g"))])
    # each row's words as planned, in all as many as the budgets
    some = [row(None, plain(f"n{i}"), "t") for i in range(5)] + [row(7, plain(f"r{i}"), "s") for i in range(4)] + [row(8, plain("q"), "s")] * 3
    docs = spark.createDataFrame(some, kind)
    plan = mixing.mix(docs).collect()
    words: dict = {}
    for r in P.mix_sources(spark, docs, SF).collect():
        key = (r["source"], r["text"].split()[0])
        words[key] = words.get(key, 0) + len(r["text"].split())
    assert sum(words.values()) == sum(r["taken"] for r in plan)
    size = {("s", "wqx0"): 120}
    assert all(n <= 3 * size.get(k, 40) for k, n in words.items())
    assert sum(n for (s, _), n in words.items() if s == "t") == sum(r["taken"] for r in plan if r["doc_id"] is None) > 0
