"""What line dedup hands on grows with the lines, not with the pairs of a block."""

import random

import numpy as np
import pyarrow as pa
import pytest
from loomgraph.llm import line_dedup
from loomgraph.llm.line_dedup import Marks, _tied, edit_distance, edit_distances, forest, most_edits, near_links, stars


def marks(rng, n, groups):
    """Lines of one length that share all block bytes; those of a group differ in few bits, groups in half of them."""
    group = rng.integers(0, groups, n)
    fps = [rng.integers(0, 1 << 63, groups, dtype=np.int64)[group] ^ (np.int64(1) << rng.integers(0, 63, n)) for _ in range(2)]
    return group, [*fps, np.full(n, np.int64(100) << np.int64(48))]


def test_small_blocks_give_a_forest():
    rng = np.random.default_rng(1)
    n = 60 * 20
    group, rows = marks(rng, n, 8)
    keys = np.repeat(np.arange(20), 60)
    left, right, deferred = near_links(keys, Marks(*rows), 0.8)
    assert not deferred and len(left) == n - len(set(zip(keys.tolist(), group.tolist())))
    assert (keys[left] == keys[right]).all() and (group[left] == group[right]).all()


def test_lines_apart_are_tied_without_a_row_a_pair():
    rng = np.random.default_rng(2)
    group, rows = marks(rng, 400, 3)
    ids = np.arange(400)
    part = np.where(ids < 390, group, ids)
    texts = [" ".join(f"w{g}x{k}" for k in range(20)) + f" {i}" for i, g in enumerate(group.tolist())]
    # Two keys that all lines share: the first of them looks at each pair.
    own = pa.array([[0, 1, 2, 3, 4, 5]] * 800, pa.list_(pa.int32()))
    twice = [np.concatenate([x, x]) for x in (*rows, ids, part)]
    table = pa.RecordBatch.from_arrays([*map(pa.array, (np.repeat([0, 1], 400).astype(np.int32), *twice)), own, pa.array(texts * 2)], names=["k", "fp", "fp2", "sig", "node", "part", "keys", "text"])
    got = pa.Table.from_batches(list(_tied(0.8)(iter([table])))).to_pydict()
    assert len(got["a"]) == 10 and {x for ab in zip(got["a"], got["b"]) for x in ab if x >= 390} == set(range(390, 400))
    assert all(group[a] == group[b] for a, b in zip(got["a"], got["b"]))


def test_pairs_that_lie_too_far_apart_leave_early():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    pairs = [(word(rng.randrange(300)), word(rng.randrange(300))) for _ in range(40)]
    for _ in range(40):
        a = list(word(rng.randrange(1, 300)))
        for _ in range(rng.randrange(60)):
            a.insert(rng.randrange(len(a) + 1), rng.choice("abé"))
        pairs.append(("".join(a), "".join(x for x in a if rng.random() < 0.95)))
    true, most = [edit_distance(a, b) for a, b in pairs], [most_edits(a, b, 0.8) for a, b in pairs]
    assert edit_distances(pairs) == true
    got = edit_distances(pairs, most)
    assert all(g == d if d <= m else m < g <= d for g, d, m in zip(got, true, most))
    assert got != true


def test_a_dense_block_yields_a_forest_of_all_its_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    fp = (base[rng.integers(0, 6, 700)] ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))).view(np.int64)
    marks = Marks(fp, fp.copy(), np.full(700, 50 << 48, np.int64))
    for left, right in ((np.arange(700), np.zeros(0, np.int64)), (np.arange(300), np.arange(300, 700))):
        i, j = np.triu_indices(700, 1) if not len(right) else (np.repeat(left, len(right)), np.tile(right, len(left)))
        hit = marks.apart(i, marks, j, 0.8) < 255
        want = linked(700, i[hit].tolist(), j[hit].tolist())
        a, b = forest(marks, left, right, 0.8)
        assert linked(700, a, b) == want
        assert len(a) == 700 - len(set(want))


def linked(n, a, b):
    root = list(range(n))
    for x, y in zip(a, b):
        u, v = root[x], root[y]
        if u != v:
            root = [min(u, v) if r in (u, v) else r for r in root]
    return root


def test_stars_have_the_parts_of_chains():
    rng = np.random.default_rng(4)
    chain = rng.permutation(5000) * 3
    assert [x.tolist() for x in stars(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [[], []]
    cut = np.flatnonzero(np.arange(4999) % 1000 != 999)
    got = dict(zip(*(x.tolist() for x in stars(chain[:-1][cut], chain[1:][cut]))))
    want = {x: min(part) for part in chain.reshape(5, 1000).tolist() for x in part if x != min(part)}
    assert got == want


@pytest.mark.parametrize(("chunk", "searches"), [(250, 1), (8, 2)])
def test_only_what_lies_in_several_tasks_is_searched_again(spark, monkeypatch, chunk, searches):
    """A group in one chunk is settled there; a larger one by the lines that its chunks share."""
    rng = random.Random(11)
    rows = []
    for i in range(4):
        base = [f"w{i}{rng.randint(0, 999)}" for _ in range(30)]
        for _ in range(30):
            line = list(base)
            line[rng.randrange(30)] = f"v{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(line)))
    calls, search = [], line_dedup.connected_components
    monkeypatch.setattr(line_dedup, "connected_components", lambda *a, **k: calls.append(1) or search(*a, **k))
    monkeypatch.setattr(line_dedup.verified_links, "__defaults__", (chunk,))
    got = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.text}
    assert got == {0, 30, 60, 90} and len(calls) <= searches


def test_lines_are_handed_on_packed():
    """A task hands on its lines, and their blocks, as a row for each bucket; each line comes out once, with its first occurrence."""
    texts = [f"one two three four five six {i % 7}\n\nshort {i % 3}\nonly here {i}" for i in range(60)]
    ids = pa.array([None if i % 10 == 9 else 60 - i for i in range(60)], pa.int64())
    number = pa.array(np.arange(60) * 3)
    batch = pa.RecordBatch.from_arrays([number, number, ids, pa.array(texts)], names=["k1", "k2", "id", "text"])
    rows = pa.Table.from_batches(list(line_dedup._lines(5, 4)(iter([batch]))))
    narrow = [r for r in rows.to_pylist() if r["bucket"] is None]
    packed = rows.select(["bucket", "packed"]).filter(rows["bucket"].is_valid())
    assert len(packed) <= 4 and len([r for r in narrow if r["line"] < 0]) == 60
    want = {}
    for r in narrow:
        if r["line"] >= 0:
            i = r["k1"] // 3
            want.setdefault((r["h1"], r["h2"]), []).append((ids[i].as_py() is None, ids[i].as_py() or 0, r["k1"], r["k2"], r["line"]))
    assert len(want) == 7 + 3 + 60
    out = pa.Table.from_batches(list(line_dedup._distinct(iter(packed.to_batches()))))
    assert {(r["h1"], r["h2"]): (r["n"], tuple(r["first"].values())) for r in out.to_pylist()} == {k: (len(v), min(v)) for k, v in want.items()}
    assert out.num_rows == len(want) and all(out["lead"].to_pylist())
    fuzzy = [r for r in out.to_pylist() if r["keys"]]
    lines = pa.RecordBatch.from_pylist([{c: r[c] for c in ("h1", "fp", "fp2", "sig", "keys")} for r in fuzzy])
    blocks = list(line_dedup._blocks(4)(iter([lines])))
    assert sum(b.num_rows for b in blocks) <= 4
    got = line_dedup.unpacked(iter(blocks), line_dedup.BLOCK)
    assert {(x["k"], x["node"], x["sig"]) for x in got} == {(k, r["h1"], r["sig"]) for r in fuzzy for k in r["keys"]}
    assert len(got) == len({(x["k"], x["node"]) for x in got})


def test_the_filter_of_texts_loses_none(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER", 1 << 17)
    rng = random.Random(3)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), i, "x") for i in range(3000)]
    texts = spark.createDataFrame(rows, "k1 long, k2 long, text string")
    got = {r.k2 for r in line_dedup.maybe(texts, texts.where("k2 < 300")).collect()}
    assert set(range(300)) <= got and len(got) < 400
