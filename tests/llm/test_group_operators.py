"""Near-duplicate operators, search, mixing and packing: brute force and the defined cases."""

import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from prioscope.llm import embedding_dedup, line_dedup, mixing, mtree, packing, queries, simhash
from prioscope.llm.common import table
from prioscope.llm.components import bucket_components, connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int, size string, piece string"


def frame(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 1, "x", "y") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (None, "no id"), (5, "copy copy\ncopy copy"), (5, "copy copy\ncopy copy"), (6, "long " * 60_000)]


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(pairs, {x for a, b in pairs if a != b for x in (a, b)})
    assert got == want


# --- SimHash -------------------------------------------------------------------------------

def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "").encode())
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs}
    a = np.array(list(fp.values()), np.uint64)
    ids = list(fp)
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[:i]) <= 4).tolist()]
    want = union(pairs, ids)
    got = {r["doc_id"]: r for r in queries.op5_simhash_dedup(spark, sf).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fp.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_no_pair_of_fingerprints_is_lost(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:  # chains of up to four flipped bits, and a dense group around the first
        for _ in range(3):
            for bit in rnd.sample(range(64), rnd.randint(1, 6)):
                b ^= 1 << bit
            fps.add(b)
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i, j in itertools.combinations(range(12), 2)}
    fps = sorted(fps)
    pairs = [(x, y) for x, y in itertools.combinations(fps, 2) if (x ^ y).bit_count() <= 4]
    signed = simhash._signed
    want = union([(signed(x), signed(y)) for x, y in pairs], [signed(x) for x in fps])
    got = simhash.link_fingerprints(spark.createDataFrame([(signed(x),) for x in fps], "fp long"))
    got = {r["node"]: r["component"] for r in got.collect()}
    assert {n: got.get(n, n) for n in want} == want


def test_simhash_defined_cases(spark):
    got = simhash.near_dedup(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["component_id"] for i in (1, 2, 3)} == {1} and by[1]["fingerprint"] == "0" * 16
    assert by[None]["component_id"] is None and by[5]["component_id"] == 5
    assert simhash.near_dedup(frame(spark, [])).collect() == []
    assert simhash.fingerprint("w " * 20_000) == brute_fingerprint("w " * 20_000)


# --- embeddings ----------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, n_links string")


def near_copies(seed=0, n=300, d=64):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        base = rng.normal(size=d)
        for _ in range(int(rng.integers(1, 5))):
            out.append(base + rng.normal(size=d) * rng.uniform(0.05, 0.5))
    hub = rng.normal(size=d)
    out += [hub + rng.normal(size=d) * 0.1 for _ in range(120)]  # a group of near copies
    out += [hub] * 30  # and of exact ones
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]


@pytest.mark.parametrize("block", [512, 16])
def test_embedding_links_equal_brute_force(spark, block):
    rows = near_copies()
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, 0)
    want = s >= 0.9
    got = {r["vec_id"]: r for r in embedding_dedup.near_dedup(vectors(spark, rows), block=block).collect()}
    n = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (n <= want.sum(axis=1)).all() and n.sum() >= 0.99 * want.sum()
    if n.sum() == want.sum():
        comp = union([(int(a), int(b)) for a, b in zip(*np.nonzero(want))], range(len(rows)))
        assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_cross_polytope_recall():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    for cosine, least in ((0.9, 0.99), (0.95, 0.999)):
        b = cosine * a + np.sqrt(1 - cosine**2) * r
        x, y = embedding_dedup.entries(a), embedding_dedup.entries(b)
        met = [bool(set(p) & set(q)) for p, q in zip(x.tolist(), y.tolist())]
        assert np.mean(met) >= least


def test_embedding_defined_cases(spark):
    big = [3.0e38, 0.0, 3.0e38]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, float("nan"), 0.0]), (5, [1.0, None, 0.0]), (6, [float("inf"), 0.0, 0.0]),
            (7, [1.0, 0.0, 1.0]), (8, big), (9, [1.0, 0.0]), (None, [1.0, 0.0, 1.0]), (10, [1.0, 0.0, 1.0]), (10, [1.0, 0.0, 1.0])]
    got = embedding_dedup.near_dedup(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (1, 2, 3, 4, 5, 6, 9))
    assert by[7]["n_links"] == 2 and by[8]["component_id"] == by[10]["component_id"] == 7 and not by[8]["kept"]
    assert by[None]["n_links"] == 0 and by[None]["kept"] is False
    assert embedding_dedup.near_dedup(vectors(spark, [])).collect() == []


def test_classes_of_equal_vectors_hold_no_list_of_ids(spark, monkeypatch):
    written = {}

    def kept(df, name, write=embedding_dedup.materialize):
        written[name] = dict(df.dtypes)
        return write(df, name)

    monkeypatch.setattr(embedding_dedup, "materialize", kept)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 0.0 if i % 2 else -0.0, 3.0]) for i in range(400)]  # one class, also with a signed zero
    rows += [(1000 + i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(40)] + [(2000 + i, [-9.0, 1.0, 4.0, 0.5]) for i in range(2)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_dedup(vectors(spark, rows)).collect()}
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    assert len(got) == len(rows) and all(399 <= got[i]["n_links"] <= near[i].sum() - 1 and got[i]["component_id"] == 0 for i in range(400))
    assert got[2001]["component_id"] == got[2000]["component_id"] and got[2000]["n_links"] >= 1
    assert "array<bigint>" not in written["classes"].values()


# --- top k ---------------------------------------------------------------------------------

def brute_top(rows, k=10):
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]
    out = set()
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("group,block", [(16_384, 1024), (40, 2)])
def test_top_k_equals_brute_force_with_ties(spark, group, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)]) for i in range(400)]
    rows += [(i, rows[i % 7][1]) for i in range(400, 700)]  # many equal vectors: ties
    q = mtree.quantised(vectors(spark, rows))
    got = mtree.top_k(q.where("vec_id % 100 = 0"), q, 10, group, block)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()} == brute_top(rows)


def test_registered_top_k(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    got = queries.op8_top_k(spark, SF).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == brute_top(rows)


def test_m_tree_skips_distances():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(4000, 3))
    tree = mtree.MTree(points)
    q = np.array([0.3, -0.2, 0.1])
    d = np.sqrt(((points - q) ** 2).sum(axis=1))
    best: list = []

    def better(rows):
        best.extend(d[rows].tolist())
        best.sort()

    done = tree.search(q, better, lambda: best[4] if len(best) > 4 else np.inf)
    assert np.allclose(best[:5], np.sort(d)[:5]) and done < 1500
    for node in tree.nodes:  # covering radii hold
        if not node["leaf"]:
            assert (node["radius"] >= 0).all()


def test_top_k_defined_cases(spark):
    rows = [(0, None), (100, [1.0, None]), (200, [1.0, float("nan")]), (300, []), (400, [1.0, 2.0]), (500, [1.0]), (1, [1.0, 2.0]), (2, [3.0e30, 1.0]), (None, [1.0, 1.0])]
    q = mtree.quantised(vectors(spark, rows))
    got = [tuple(r) for r in mtree.top_k(q.where("vec_id % 100 = 0"), q).orderBy("query_id", "rank").collect()]
    assert [(a, b, c) for a, b, c, _ in got] == [(400, 1, 2), (400, 2, 1)] and got[1][3] == 1024 * 1024 * 5
    none = mtree.quantised(vectors(spark, []))
    assert mtree.top_k(none, none).collect() == []


def test_top_k_repeated_queries_lose_no_neighbour(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, rnd.normal(size=4).tolist()) for i in range(1, 40)]
    q = [(100, [1.0, 2.0, 0.0, 1.0])] * 3 + [(200, [0.5, 0.0, 1.0, 0.0]), (200, [0.0, 1.0, 0.0, 0.0])]
    v = mtree.quantised(vectors(spark, rows + q))
    got = [tuple(r) for r in mtree.top_k(v.where("vec_id % 100 = 0"), v).collect()]
    grid = lambda x: np.floor(np.array(x) * 1024).astype(int)
    want = [(i, r + 1, n, -s) for i, x in {(i, tuple(x)) for i, x in q}
            for r, (s, n) in enumerate(sorted((-int(grid(x) @ grid(y)), n) for n, y in rows + q if n != i)[:10])]
    assert sorted(got) == sorted(want) and len(got) == 30


# --- lines ---------------------------------------------------------------------------------

def jaccard(a, b, k=line_dedup.SHINGLE):
    x, y = ({s[i:i + k] for i in range(max(1, len(s) - k + 1))} for s in (a, b))
    return len(x & y) / len(x | y)


def brute_lines(rows):
    places = [(i, p, line) for i, t in sorted(rows) if t is not None for p, line in enumerate(t.split("\n")) if line.strip(" \t\n\x0b\x0c\r")]
    texts = sorted({x[2] for x in places})
    at = {t: n for n, t in enumerate(texts)}
    pairs = [(at[a], at[b]) for a, b in itertools.combinations(texts, 2)
             if min(len(a), len(b)) >= 0.7 * max(len(a), len(b)) and jaccard(a, b) >= line_dedup.MIN_JACCARD]
    comp = union(pairs, range(len(texts)))
    seen, gone = set(), set()
    for i, p, line in places:
        c = comp[at[line]]
        if c in seen:
            gone.add((i, p))
        seen.add(c)
    return gone


def test_lines_equal_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuéü") for _ in range(rnd.randint(2, 8)))
    base = [" ".join(word() for _ in range(rnd.randint(8, 40))) for _ in range(60)]
    rows = []
    for i in range(50):
        text = []
        for _ in range(rnd.randint(1, 8)):
            line = rnd.choice(base)
            if rnd.random() < 0.5:  # a letter changed, or a word added
                p = rnd.randrange(len(line))
                line = line[:p] + rnd.choice("xyz") + line[p + 1:] if rnd.random() < 0.7 else line + " " + word()
            text.append(line)
        rows.append((i, "\n".join(text + ["", "ok", "  "])))
    got = {(r["doc_id"], r["pos"]) for r in line_dedup.removed_lines(frame(spark, rows)).collect()}
    want = brute_lines(rows)
    # the signature's recall is a little below one; nothing else may go
    assert got <= want and len(got) >= 0.99 * len(want)


def test_line_texts_and_report(spark):
    a = "The licence of this file allows every use of it, with this notice kept."
    rows = [(1, f"{a}\nfirst own line of text\n\nshort"), (2, f"second own line\n{a[:-1]}!\nshort"), (3, a), (4, None)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "second own line" and got[3]["text"] == "" and got[4]["text"] is None
    assert got[1]["size"] == "x" and set(got[1].asDict()) == set(frame(spark, rows).columns)
    rep = {r["doc_id"]: (r["n_lines"], r["n_removed"], list(r["removed"])) for r in line_dedup.line_report(frame(spark, rows)).collect()}
    assert rep == {1: (4, 0, []), 2: (3, 2, [1, 2]), 3: (1, 1, [0]), 4: (0, 0, [])}


def test_line_plan_is_native(spark):
    plan = line_dedup.bands(line_dedup.signatures(line_dedup.lines(frame(spark, ODD))))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_defined_cases(spark):
    got = line_dedup.dedup_lines(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r["text"] for r in got}
    assert by[1] is None and by[2] == "" and by[3] == " \n\t " and by[5] == "copy copy" and by[None] == "no id"
    assert line_dedup.line_report(frame(spark, [])).collect() == []


# --- mixing --------------------------------------------------------------------------------

def test_mix_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.ORACLE_SQL["op10_mix"])
    cols = [c[0] for c in want.description]
    key = lambda r: (r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"])
    want = sorted(key(dict(zip(cols, r))) for r in want.fetchall())
    assert sorted(key(r.asDict()) for r in queries.op10_mix(spark, SF).collect()) == want


def test_targets_share_the_excess():
    t = mixing.targets({"b": 10, "a": 10, None: 1000, "c": 0})
    assert t["a"] == 30 and t["b"] == 30 and t["c"] == 0 and t[None] == pytest.approx(960)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_mix_cuts_and_repeats(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(rnd.randint(1, 30))) + "\n", "en", rnd.choice("abc") if i % 3 else "a", 1, "x", "y") for i in range(200)]
    rows += [(500, None, "en", "a", 1, "x", "y"), (501, "", "en", None, 1, "x", "y")]
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.mix(docs)
    got = plan.collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    src = {r[0]: r[3] for r in rows}
    for s in {r[3] for r in rows}:
        mine = [r for r in got if src[r["doc_id"]] == s]
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"])
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    out = mixing.apply_mix(docs, plan)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").split())
    assert words == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def test_mix_defined_cases(spark):
    got = mixing.mix(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r["doc_id"]: r["size"] for r in got}[1] == 0
    assert mixing.mix(frame(spark, [])).collect() == []


def test_bucket_components_of_a_dense_bucket_equal_those_of_all_pairs(spark):
    n, modulus = 120, 60  # few of a bucket's pairs are links, and none with its smallest id
    members = spark.range(n).select(F.explode(F.array(F.lit(1), F.col("id") % 2 + 2)).alias("bucket"), F.col("id"), (F.col("id") * 3).alias("sketch"))
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        return pairs.where(f"a > 0 and (a * 7 + b * 11) % {modulus} = 5")

    got = {r["node"]: r["component"] for r in bucket_components(members, verify, lambda x, y: F.abs(x - y) <= 3 * 90, "sketch").collect()}
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(1, n):
        for b in range(a + 1, n):
            if (a * 7 + b * 11) % modulus == 5 and b - a <= 90:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(n)}
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert got == {i: c for i, c in want.items() if sizes[c] > 1} and len(seen) > 2


# --- packing -------------------------------------------------------------------------------

def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_as_best_fit_does(seed):
    rnd = random.Random(seed)
    capacity = 64
    hist = {n: rnd.randint(1, 40) for n in rnd.sample(range(1, capacity + 1), 25)}
    runs = packing.plan(hist, capacity)
    fill: dict = {}
    ranks: dict = {}
    for length, rank, n, first, offset in runs:
        ranks.setdefault(length, []).extend(range(rank, rank + n))
        for s in range(first, first + n):
            fill.setdefault(s, []).append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in hist.items()}
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(fill) == best_fit([n for n, c in hist.items() for _ in range(c)], capacity)


def check_packing(rows, want_ids):
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = want_ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(seqs)


def whole_ids(text):
    from tokenizers import Tokenizer

    whole_ids.t = getattr(whole_ids, "t", None) or Tokenizer.from_file(packing.default_tokenizer())
    return [*whole_ids.t.encode(text or "", add_special_tokens=False).ids, 2]


def test_registered_packing(spark):
    ids = {r["doc_id"]: whole_ids(r["text"]) for r in table(spark, SF, "documents").collect()}
    rows = queries.op4_best_fit_packing(spark, SF).collect()
    n = check_packing(rows, ids)
    pieces = [length for x in ids.values() for _, length in packing.cut(len(x))]
    assert sorted(r["length"] for r in rows) == sorted(pieces) and n == best_fit(pieces, 1024)
    for i, x in ids.items():
        mine = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == i)
        assert [m[0] for m in mine] == list(range(len(mine))) and sum(m[2] for m in mine) == len(x)
        assert all(m[2] == 1024 for m in mine[1:])


@pytest.mark.parametrize("text", ["a  b", " a b", "a b ", "a\n b", "a \n\n b  ", "x  y  z", "it's 12 o'clock!! <|endoftext|> end", "\t\ttab \t x", "   ", "é è 　 ü", "Word, word. word,, 3rd, a.b", "one.\ntwo three\n\nfour five\n", "a\t\nb c\rd\u2028e f", "ﬁ ª² x² ʰ,"])
def test_cached_words_give_the_same_ids(text):
    got = np.frombuffer(packing._encoder(packing.default_tokenizer()).ids([text])[0], "<u4").tolist()
    assert got == whole_ids(text)[:-1]


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(2050) == [(0, 2), (2, 1024), (1026, 1024)] and packing.cut(0) == []


def test_packing_defined_cases(spark):
    rows = packing.pack(packing.pieces(frame(spark, ODD))).collect()
    assert check_packing(rows, {i: whole_ids(t) for i, t in ODD}) >= 1
    assert sum(r["doc_id"] == 5 for r in rows) == 2 and [r["length"] for r in rows if r["doc_id"] == 1] == [1]
    assert packing.pack(packing.pieces(frame(spark, []))).collect() == []


def test_simhash_keys_of_any_width_lose_no_pair(spark):
    rnd = random.Random(12)
    base = [rnd.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 6))) for b in base for _ in range(8)]
    fps = sorted(set(base + near))
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    want = union([(a, b) for (a, x), (b, y) in itertools.combinations(list(zip(signed, fps)), 2) if bin(x ^ y).count("1") <= 4], signed)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for keep in (2, 3, 4):
        got = {r["node"]: r["component"] for r in simhash.link_fingerprints(df, keep=keep).collect()}
        assert {n: got.get(n, n) for n in signed} == want
    assert [simhash.blocks_kept(n) for n in (0, 40_000, 50_000, 256_000, 7_000_000, 100_000_000)] == [2, 2, 3, 3, 4, 5]


def test_pairs_of_texts_are_compared_within_their_row(spark):
    texts = ["abcdefghij" * 3, "abcdefghij" * 4, "abcdefghijk" * 3, "short", "short", "", "äöü\U0001f600 and more text here", "äöü\U0001f600 and more text heres"]
    rows = [(i, j, texts[i], texts[j]) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    got = line_dedup._similar(spark.createDataFrame(rows, "a long, b long, x string, y string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()

    def shingles(text):
        units = text.encode("utf-16-be")
        return {units[i:i + 14] for i in range(0, max(1, len(units) - 13), 2)}

    want = {(a, b) for a, b, x, y in rows if len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y))}
    assert {(r["a"], r["b"]) for r in got.collect()} == want and (3, 4) in want and (6, 7) in want


def test_bitmaps_drop_no_similar_pair_and_most_others(spark):
    rnd = random.Random(8)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(400))

    def variant(edits):
        line = list(base[:rnd.randint(300, 400)])
        for _ in range(edits):
            line[rnd.randrange(len(line))] = rnd.choice("xyzü")
        return "".join(line)

    lines = [base, "short", "shorter", "abcabcabc" * 9, "abcabcabc" * 12] + [variant(k % 20) for k in range(60)]
    maps = line_dedup.bitmaps(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    x, y = maps.alias("x"), maps.alias("y")
    passed = {(r[0], r[1]) for r in x.join(y, F.col("x.id") < F.col("y.id")).where(
        line_dedup.may_be_similar(F.col("x.sketch"), F.col("y.sketch"))).select("x.id", "y.id").collect()}
    similar = {p: jaccard(lines[p[0]], lines[p[1]]) for p in itertools.combinations(range(len(lines)), 2)}
    links = {p for p, j in similar.items() if j >= line_dedup.MIN_JACCARD}
    # repeats within a line (numbers 3 and 4) only widen the bound
    assert links and links <= passed and not any(similar[p] < 0.65 for p in passed if not {3, 4} & set(p))


def test_lines_of_a_near_group_are_compared_as_sets_only_if_they_may_be_similar(spark, monkeypatch):
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    lines = []
    for _ in range(80):  # most of the pairs have a similarity of 0.5 to 0.75
        line = list(base)
        for p in rnd.sample(range(400), 9):
            line[p] = rnd.choice("xyz")
        lines.append("".join(line))
    seen, similar = [], line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda both: seen.append(both.count()) or similar(both))
    got = {(r["doc_id"], r["pos"]) for r in line_dedup.removed_lines(frame(spark, list(enumerate(lines)))).collect()}
    assert got <= brute_lines(list(enumerate(lines)))
    assert sum(seen) < 400  # of 3,160 pairs


def test_joined_up_buckets_leave_the_rounds(spark, monkeypatch):
    from prioscope.llm import components
    sizes, write = {}, components.materialize

    def counted(df, name):
        out = write(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(components, "materialize", counted)
    # buckets 0..49: a pair linked at once; bucket 1000: forty that are linked in part; 2000..: alone
    members = spark.createDataFrame([(b, 1000 + 2 * b + k) for b in range(50) for k in (0, 1)] + [(1000, i) for i in range(40)]
                                    + [(2000 + i, i) for i in range(40)], "bucket long, id long")
    links = bucket_components(members, lambda pairs: pairs.where("a >= 1000 or (a > 0 and (a + b) % 8 = 1)"))
    got = {r["node"]: r["component"] for r in links.collect()}
    assert all(got[1000 + 2 * b + 1] == 1000 + 2 * b for b in range(50))
    assert sizes["shared"] == [51] and sizes["buckets"] == [140] and set(sizes["mixed"]) == {40}


def test_words_have_the_ids_of_the_whole_tokenizer():
    coder = packing._encoder(packing.default_tokenizer())
    assert packing._packed([]) == b"" and packing._packed([1, 0x01020304]) == bytes([1, 0, 0, 0, 4, 3, 2, 1])
    for word in (" plain", "plain", " Ünïcode", "straße", " дом", "中文", " x" * 1, " " + "Long" * 90):
        assert coder._word(word) == coder._whole(word)
