import random

import pytest
from loomgraph.llm.line_dedup import dedup_lines, edit_distance, edit_similar

SF = "/root/testdata/sf0.001"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def norm(line):
    spaced = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in line.lower())
    return " ".join(w for w in spaced.split(" ") if w)


def slow_groups(lines, min_words=5):
    """Groups of normalised lines by edit similarity alone, each pair looked at."""
    comp = list(range(len(lines)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    fuzzy = [i for i, c in enumerate(lines) if len(c.split(" ")) >= min_words]
    for i in fuzzy:
        for j in fuzzy:
            if j >= i:
                break
            if find(i) != find(j) and min(len(lines[i]), len(lines[j])) >= 0.8 * max(len(lines[i]), len(lines[j])) - 1e-9 and edit_similar(lines[i], lines[j]):
                comp[find(i)] = find(j)
    return [find(i) for i in range(len(lines))]


def slow_dedup(docs, min_words=5):
    """docs: [(id, text)], ids distinct -> {id: text}"""
    first = {}
    for i, text in sorted(docs):
        for n, line in enumerate((text or "").split("\n")):
            if norm(line):
                first.setdefault(norm(line), (i, n))
    lines = sorted(first)
    group = slow_groups(lines, min_words)
    keep = {}
    for g, c in zip(group, lines):
        keep[g] = min(keep.get(g, first[c]), first[c])
    stays = {c: keep[g] for g, c in zip(group, lines)}
    out = {}
    for i, text in docs:
        rest = [line for n, line in enumerate((text or "").split("\n")) if not norm(line) or stays[norm(line)] == (i, n)]
        out[i] = None if text is None else "\n".join(rest)
    return out


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in "xy")
        assert edit_distance(a, b) == slow_distance(a, b)
        longest = max(len(a), len(b))
        assert edit_similar(a, b) == (longest == 0 or slow_distance(a, b) <= int(0.2 * longest + 1e-9))


def test_whole_table_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    got = {r.doc_id: r for r in dedup_lines(table).collect()}
    want = slow_dedup(docs)
    # Of all similar pairs at most a few in a hundred share no block; what is cut is cut by brute force too.
    kept = {i: r.text.split("\n") for i, r in got.items()}
    assert sum(r.text != want[i] for i, r in got.items()) <= 2
    assert all(set(want[i].split("\n")) - {""} <= set(kept[i]) for i in want)
    assert all(r.n_lines == len(t.split("\n")) and r.n_lines - r.n_dropped == (len(kept[i]) if r.n_dropped < r.n_lines else 0) for i, t in docs for r in [got[i]])


def test_fuzzy_lines_keep_one_a_group(spark):
    rng = random.Random(2)
    base = [f"word{rng.randint(0, 9999)}" for _ in range(60)]
    rows = []
    for i in range(200):
        line = list(base)
        if i % 2:
            line[rng.randrange(60)] = "other"
        rows.append((i, "Short line.\n" + " ".join(line) + f"\n\nnothing like it {rng.random()} {rng.random()} here"))
    # Lines with the same words in other orders: neighbours by SimHash that the texts keep apart.
    for i in range(200, 230):
        at = rng.randrange(60)
        base = base[at:] + base[:at]
        rows.append((i, " ".join(base) + (" tail" if i % 3 else "")))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(table).collect()}
    assert got == slow_dedup(rows)
    got = {i: t for i, t in got.items() if i < 200}
    assert sum("word" in t for t in got.values()) < 20
    assert [i for i, t in got.items() if "Short line." in t] == [0]


@pytest.mark.parametrize(("chunk", "hot"), [(5, 4), (16, 10**6), (10**6, 4)])
def test_split_groups_and_blocks_give_the_same(spark, monkeypatch, chunk, hot):
    from loomgraph.llm import line_dedup

    rng = random.Random(7)
    rows = []
    for i in range(6):
        base = [f"w{i}{rng.randint(0, 999)}" for _ in range(30)]
        for _ in range(40):
            line = list(base)
            for _ in range(rng.choice([0, 1, 2, 9])):
                line[rng.randrange(30)] = f"v{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(line)))
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "TILE", 3)
    monkeypatch.setattr(line_dedup.verified_links, "__defaults__", (chunk,))
    monkeypatch.setattr(line_dedup, "SMALL", 3)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    split = {r.doc_id: r.text for r in dedup_lines(table).collect()}
    monkeypatch.undo()
    assert split == {r.doc_id: r.text for r in dedup_lines(table).collect()}
    want = slow_dedup(rows)
    assert sum(split[i] != want[i] for i in want) <= 0.02 * len(rows)


def test_odd_rows(spark):
    long = "many words " * 30_000
    rows = [
        (1, None, 1, 1),
        (2, "", 1, 1),
        (3, "a b c d e\na  B, c d e", 2, 2),
        (4, "A b c d e", 3, None),
        (None, "a b c d e\nmy own line is this", None, 4),
        (5, long, 0, 0),
        (6, long, 0, 0),
        (7, "x y z x y\n\n", 0, 0),
        (7, "x y z x y\n\n", 0, 0),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, gone long, n_lines long")
    got = dedup_lines(table)
    assert got.columns == ["doc_id", "text", "gone", "n_lines", "n_dropped"]
    by = {(r.doc_id or 0): (r.text, r.n_dropped) for r in got.collect() if r.text != long}
    assert {i: x for i, x in by.items() if i != 7} == {1: (None, 0), 2: ("", 0), 3: ("a b c d e", 1), 4: ("", 1), 0: ("my own line is this", 1), 6: ("", 1)}
    assert dedup_lines(table.limit(0)).collect() == []
    assert sorted((r.text, r.n_dropped) for r in got.collect() if r.doc_id == 7) == [("\n", 1), ("x y z x y\n\n", 0)]
    assert got.count() == len(rows)


def test_rows_without_an_id_and_repeated_rows(spark):
    rows = [(None, "one line of its own here"), (None, "one line of its own here"), (7, "x\n***\nsecond"), (7, "x\n***\nsecond"), (7, "x\n***\nsecond"), (8, "x\n中文字\n中文字"), (9, "...\n\n...")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got) == [
        ("7", "***", 3, 2), ("7", "***", 3, 2), ("7", "x\n***\nsecond", 3, 0), ("8", "中文字", 3, 2), ("9", "...\n\n...", 3, 0), ("None", "", 1, 1), ("None", "one line of its own here", 1, 0)
    ]


@pytest.mark.parametrize("bad", [None, ""])
def test_only_empty_texts(spark, bad):
    assert [r.text for r in dedup_lines(spark.createDataFrame([(1, bad)], "doc_id long, text string")).collect()] == [bad]
