"""Links of documents against the Jaccard similarity of their shingle sets alone, whatever their SimHashes are."""

import random

import numpy as np
import pyarrow as pa
import pytest
from loomgraph.llm.common import Workspace, connected_components
from loomgraph.llm.simhash_dedup import common_tokens, shingle_sets, similar_documents
from test_pipeline import slow_kept


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"v{rng.randint(0, 10**6)}"
    return words


def kept(spark, rows, **more):
    work = Workspace(spark, "test")
    links = similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", work, **more)
    return {i for i, _ in rows} - {r.node for r in connected_components(links, work).where("node <> component").collect()}


def test_no_pair_at_the_threshold_is_left_out(spark):
    rng = random.Random(8)
    rows = [(1000, None), (1001, " \t"), (1002, "one two"), (1003, "One  two"), (1004, "a b c d e")]
    for n in (30, 60, 120, 400):
        for edits in (1, 2, n // 50, n // 45):
            for _ in range(12):
                words = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(edited(rng, words, edits)))]
    texts = dict(rows)
    want = slow_kept(texts, texts)
    assert len(rows) - 150 < len(want) + 150 and kept(spark, rows) == want


@pytest.mark.parametrize("most", [2, 16])
def test_tokens_that_many_share(spark, most):
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    base = [f"b{k}" for k in range(80)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 6])))) for i in range(60)]
    rows += [(i, " ".join(passage + [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 40))])) for i in range(60, 140)]
    texts = dict(rows)
    assert kept(spark, rows, most=most) == slow_kept(texts, texts)


def test_common_tokens_reach_the_driver_alone(spark, monkeypatch):
    """However many tasks hold the counts; a limit had so many rows sent from each of them."""
    rng = random.Random(10)
    often = " ".join(f"o{k}" for k in range(54))
    some = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(104)) for _ in range(40)]
    rows = [(i, f"{some[i % 40]} u{i} {often}") for i in range(120)]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(8)
    kind, sent = type(texts), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: sent.append((df, collect(df))) or sent[-1][1])
    got = common_tokens(texts, 120, Workspace(spark, "test"), most=400)
    monkeypatch.undo()
    often, some = (set(shingle_sets(pa.array(x), np.zeros(0, np.uint64))[0].tolist()) for x in ([often], some))
    assert len(often) == 50 and len(some) == 4000
    assert often <= set(got.tolist()) <= often | some and 250 < len(got) < 550 and (np.diff(got.astype(np.int64)) > 0).all()
    assert all("TakeOrdered" not in df._jdf.queryExecution().executedPlan().toString() and len(rows) < 550 for df, rows in sent)
