"""Links of lines against the texts alone, whatever their SimHashes are."""

import random

from loomgraph.llm.line_dedup import dedup_lines, edit_similar


def test_similar_lines_meet_whatever_their_simhash(spark):
    rng = random.Random(4)
    rows = []
    for n in (12, 16, 24, 40):
        for _ in range(15):
            words = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
            other = list(words)
            for k in range(max(1, n // 12)):
                other[-1 - k] = f"v{rng.randint(0, 10**6)}"
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    assert all(edit_similar(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t if i % 2 == 0 else "" for i, t in rows}
