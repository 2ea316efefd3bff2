import random
import re

import xxhash
from loomgraph.llm import queries
from loomgraph.llm.hamming import BKTree, plan
from loomgraph.llm.simhash_dedup import fingerprint, keep_one, near_duplicates

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    if not text:
        return 0
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps, radius):
    """fps: {id: fingerprint}"""
    ids = sorted(fps)
    comp = {i: i for i in ids}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_matches_definition():
    for text in ["", " \t", "One", "a b c", "A b C d", "a b c d e", "É è x y z w", "w " * 700, "İ K\x0bx\x0cY\n1 2 3 4"]:
        assert fingerprint(text.encode()) == slow_fingerprint(text), text


def test_bk_tree_finds_all_components():
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = list({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(20)})
    tree, comp = BKTree(4), list(range(len(values)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for v in values:
        for i, j in tree.add(v):
            a, b = sorted((find(i), find(j)))
            assert a != b
            comp[b] = a
    want = slow_components(dict(enumerate(values)), 4)
    assert [find(i) for i in range(len(values))] == [want[i] for i in range(len(values))]


def test_every_plan_is_exact():
    for rows in (10, 10**5, 10**7, 10**10):
        tables = plan(rows, 4)
        assert {sum(w for _, w in t) > 0 for t in tables} == {True}
        pieces = sorted({p for t in tables for p in t})
        assert sum(w for _, w in pieces) == 64
        assert len(pieces) - 4 == len(tables[0])


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    want = slow_components(fps, 4)
    got = queries.op7_simhash_dedup(spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in docs}


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "  ", 7), (None, "", 1), (None, "only here it stands", 1), (9, "x" * 100_000, 2), (9, "x" * 100_000, 2), (5, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(((r.id is None, r.id or 0, r.component) for r in near_duplicates(docs).collect()), key=str)
    assert sorted(g[1] for g in got) == [0, 0, 1, 2, 3, 5, 9, 9]
    assert {g[1]: g[2] for g in got if not g[0]} == {1: 1, 2: 1, 3: 1, 5: 5, 9: 9}
    assert {g[2] for g in got if g[0]} == {1, None}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 5, 9]
    assert near_duplicates(docs.limit(0)).collect() == [] and keep_one(docs.limit(0)).collect() == []


def test_near_copies_form_one_component(spark):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    rows = [(i, " ".join(words)) for i in range(30)]
    for i in range(30, 60):
        some = list(words)
        some[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(some)))
    rows += [(i, " ".join(f"v{rng.randint(0, 5000)}" for _ in range(400))) for i in range(60, 70)]
    fps = {i: slow_fingerprint(t) for i, t in rows}
    got = {r.id: r.component for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_components(fps, 4)
