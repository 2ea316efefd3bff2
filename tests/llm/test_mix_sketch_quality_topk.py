import hashlib
import random

import numpy as np
import pytest
from loomgraph.llm import queries
from loomgraph.llm.common import Workspace
from loomgraph.llm.quality import LEAST, classify, keep_good
from loomgraph.llm.scaled_sketch import FRACTION, LEAST_KEPT, SHINGLE, contained, containment, fingerprints_with_edits, merge, with_sketch
from loomgraph.llm.source_mixing import mix, probabilities, rake, sample
from loomgraph.llm.topk import BallTree, quantised, top_k, usable
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


# Mixing


def test_raking_meets_all_margins(spark):
    rng = random.Random(3)
    rows = [(f"s{i}", f"l{j}", f"t{k}", rng.randint(1, 5000)) for i in range(6) for j in range(3) for k in range(2)]
    targets = {"source": {f"s{i}": (i + 1) / 21 for i in range(6)}, "lang": {"l0": 0.2, "l1": 0.3, "l2": 0.5}, "topic": {"t0": 0.6, "t1": 0.4}}
    work = Workspace(spark, "test")
    raked = rake(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), work, targets).collect()
    total = sum(r[3] for r in rows)
    for margin, goal in targets.items():
        for name, share in goal.items():
            got = sum(r.tokens / total * r.factor for r in raked if r[margin] == name)
            assert abs(got - share) < 1e-4
    probs = probabilities(spark.createDataFrame(raked), work, 0.5).collect()
    assert abs(sum(r.tokens * r.probability for r in probs) / total - 0.5) < 0.02
    assert all(0 < r.probability <= 1 for r in probs)


def test_sampling_follows_the_probabilities(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"), F.lit("en").alias("lang"), F.lit("some words of text").alias("text"))
    marks, _ = mix(docs)
    by = {r.source: r for r in marks.groupBy("source").agg(F.avg("probability").alias("p"), F.avg(F.col("sampled").cast("int")).alias("got")).collect()}
    assert by["hot"].p < by["s1"].p
    assert all(abs(r.p - r.got) < 0.03 for r in by.values())
    assert sample(docs).count() == marks.where("sampled").count()


def test_given_topics_and_tokens_and_rows_without_ids(spark):
    rows = [(None, f"text number {i}", "s", "en", f"t{i % 2}", 1 + 9 * (i % 2)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, subject string, counted long")
    marks, cells = mix(docs, topic=F.col("subject"), tokens=F.col("counted"))
    assert {(r.topic, r.tokens) for r in cells.collect()} == {("t0", 2000), ("t1", 20000)}
    got = {r.topic: (r.p, r.s) for r in marks.groupBy("topic").agg(F.avg("probability").alias("p"), F.avg(F.col("sampled").cast("int")).alias("s")).collect()}
    assert got["t0"][0] > got["t1"][0] and all(abs(p - s) < 0.05 for p, s in got.values())


def test_mixing_odd_rows(spark):
    rows = [(1, None, None, None, "x"), (2, "", "src", "en", "x"), (None, "a b c", None, "en", "x"), (4, "a b " * 50_000, "src", None, None), (4, "a b", "src", "en", "x"), (4, "a b", "src", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, probability string")
    marks, _ = mix(docs)
    assert marks.count() == len(rows)
    assert {r.n_tokens: r.sampled for r in marks.collect() if not r.n_tokens} == {0: True}
    assert sample(docs).columns == docs.columns
    assert sample(docs.limit(0)).collect() == []


# Sketches


def slow_sketch(spark, texts):
    """Hashes by the JVM's hash on single values, the rest by hand."""
    words = [t.split() for t in texts]
    flat = sorted({w for ws in words for w in ws})
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in flat] or [("",)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    shingles = {i: [tuple(hashed[w] for w in ws[k : k + SHINGLE]) for k in range(max(1, len(ws) - SHINGLE + 1))] if ws else [] for i, ws in enumerate(words)}
    flat = sorted({s + (None,) * (SHINGLE - len(s)) for x in shingles.values() for s in x}, key=str)
    cols = ", ".join(f"c{i} long" for i in range(SHINGLE))
    rows = spark.createDataFrame(flat or [(None,) * SHINGLE], cols).select("*", F.xxhash64(*(f"c{i}" for i in range(SHINGLE))).alias("h")).collect()
    of = {tuple(r[:SHINGLE]): r.h for r in rows}
    out = []
    for x in shingles.values():
        hs = sorted({of[s + (None,) * (SHINGLE - len(s))] for s in x})
        fraction = 1.0
        while fraction > FRACTION and len(hs) * fraction / 2 >= LEAST_KEPT:
            fraction /= 2
        out.append((fraction, [h for h in hs if fraction == 1 or h < -(2**63) + fraction * 2**64]))
    return out


def slow_containment(a, b):
    if len(a[1]) / a[0] > len(b[1]) / b[0]:
        a, b = b, a
    if not a[1]:
        return float(not b[1])
    limit = -(2**63) + min(a[0], b[0]) * 2**64
    mine = {h for h in a[1] if h < limit or a[0] == b[0] == 1}
    return len(mine & set(b[1])) / len(mine) if mine else 0.0


def check_edits(spark, rows, got):
    order = sorted(rows)
    texts = [t or "" for _, t in order]
    following = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, following)]
    sk, ek = slow_sketch(spark, texts), slow_sketch(spark, edited)
    for i, (doc, text) in enumerate(order):
        r = got[doc]
        assert r.n_chars == len(text or "") and r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        assert r.fingerprint == "".join(f"{h & (1 << 64) - 1:016x}" for h in sk[i][1])
        assert r.edited_fingerprint == "".join(f"{h & (1 << 64) - 1:016x}" for h in ek[i][1])
        assert r.near_edited == pytest.approx(slow_containment(sk[i], ek[i])) and r.near_next == pytest.approx(slow_containment(sk[i], sk[(i + 1) % len(sk)]))


def test_sketch_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_edits(spark, rows, {r.doc_id: r for r in queries.op8_scaled_sketch(spark, SF).collect()})


def test_next_document_with_scattered_ids(spark, tmp_path):
    rng = random.Random(9)
    ids = sorted({rng.choice([rng.randint(-50, 50), rng.randint(0, 10**15)]) for _ in range(150)})
    rows = [(i, rng.choice([None, "", " ", "w " * rng.randint(1, 30), f"text {i} é "]) if rng.random() < 0.3 else " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 80)))) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    check_edits(spark, rows, {r.doc_id: r for r in queries.op8_scaled_sketch(spark, str(tmp_path)).collect()})


def test_sketches_merge(spark):
    rng = random.Random(5)
    texts = [" ".join(f"{p}{rng.randint(0, 10**6)}" for _ in range(n)) for p, n in (("a", 40), ("b", 5000), ("c", 300))]
    df = spark.createDataFrame([(a, b, f"{a} {b}") for a in texts for b in texts if a != b], "a string, b string, both string")
    for name in ("a", "b", "both"):
        df = with_sketch(df, name, f"s{name}")
    a, b, m = F.col("sa"), F.col("sb"), merge(F.col("sa"), F.col("sb"))
    for r in df.select("sa", "sb", "sboth", m.alias("m"), contained(a, m).alias("c"), contained(a, b).alias("none")).collect():
        assert r.m.fraction == min(r.sa.fraction, r.sb.fraction) and r.c in (1.0, None) and r.none in (0.0, None)
        # The words around the seam make a few shingles of their own.
        assert r.m.fraction >= r.sboth.fraction and set(h for h in r.m.hashes if h < -(2**63) + r.sboth.fraction * 2**64) <= set(r.sboth.hashes)


def test_short_texts_inside_a_long_one(spark):
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(4000)]
    long = " ".join(words)
    rows = [(" ".join(words[i : i + n]), long) for n in (6, 12, 60) for i in range(0, 3900, 13)]
    df = with_sketch(with_sketch(spark.createDataFrame(rows, "a string, b string"), "a", "sa"), "b", "sb")
    got = [(len(r.a.split()), r.c) for r in df.select("a", containment(F.col("sa"), F.col("sb")).alias("c")).collect()]
    assert {c for _, c in got} == {1.0, None}
    assert sum(c is None for n, c in got if n == 60) < 0.1 * sum(n == 60 for n, _ in got)


def test_sketch_odd_rows(spark):
    rows = [(None, "has no id here at all", 1), (None, None, 1), (3, "x" * 90_000, 2), (3, "x" * 90_000, 2), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cell long")
    got = fingerprints_with_edits(docs).collect()
    assert sorted((r.id or 0, r.n_chars) for r in got) == [(0, 0), (0, 21), (3, 90_000), (3, 90_000), (4, 0)]
    assert fingerprints_with_edits(docs.limit(0)).collect() == []
    assert len(fingerprints_with_edits(docs.where("doc_id is null")).collect()) == 2


# Quality


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = classify(docs, labels.where("doc_id % 2 = 0"))
    held = got.join(labels.where("doc_id % 2 = 1"), got.id == labels.doc_id)
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    keep = F.col("probability") >= LEAST
    r = held.select(F.count_if(good & ~keep).alias("lost"), F.count_if(good).alias("good"), F.count_if(bad & ~keep).alias("caught"), F.count_if(bad).alias("bad")).first()
    assert r.good > 100 and r.bad > 10 and r.lost == 0
    assert r.caught > 0.75 * r.bad, r


def test_sparse_sites_shrink_to_the_global_share(spark):
    rows = [(i, "the same text", "big" if i < 900 else "tiny" if i < 901 else "good", "p") for i in range(2000)]
    labels = [(i, int(i >= 901 or i % 2 == 0), 0) for i in range(2000) if i != 900]
    got = {r.host: r.prior for r in classify(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got["big"] < got["tiny"] < got["good"]
    assert abs(got["big"] - 0.5) < 0.05


def test_quality_odd_rows(spark):
    rows = [(1, None, None, None, "x"), (2, "", "h", "p", "y"), (None, "a b c", "h", None, None), (4, "word " * 60_000, "h", "p", "z"), (4, "word", "h", "p", "z"), (4, "word", "h", "p", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, prior string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (4, None, 0), (4, 0, 0), (4, 1, 0), (99, 0, 0), (2, 0, None), (2, 7, None)], "doc_id long, quality int, toxic int")
    assert classify(docs, labels).count() == len(rows)
    assert {r.probability for r in classify(docs, labels.limit(0)).collect()} and keep_good(docs, labels).columns == docs.columns
    assert classify(docs.limit(0), labels).collect() == [] and keep_good(docs.limit(0), labels.limit(0)).collect() == []


# Top-k


def slow_top(rows, k, queries_):
    ok = {i: np.floor(1024 * np.array(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in queries_:
        if q in ok:
            scored = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_topk_against_brute_force(spark, monkeypatch):
    from loomgraph.llm import topk

    monkeypatch.setattr(topk, "BLOCK", 20 * 72)
    monkeypatch.setattr(topk, "SHARD", 300)
    monkeypatch.setattr(topk, "AHEAD", 1)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8) / 8]) for i in range(2000)]  # many ties
    rows += [(3000, None), (3001, [1.0, None] + [0.0] * 6), (3002, [float("nan")] * 8), (3003, [1.0, 2.0]), (3004, [2.0, 1.0]), (3005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).where(usable("embedding")).select("vec_id", quantised("embedding").alias("v"))
    ids = [i for i, _ in rows if i % 50 == 0 or i > 2999]
    got = top_k(df, df.where(F.col("vec_id").isin(ids)), "vec_id", "v", 7)
    assert sorted(tuple(r) for r in got.collect()) == slow_top(rows, 7, ids)


def test_topk_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op10_topk(spark, SF).collect()) == slow_top(rows, 10, [i for i, _ in rows if i % 100 == 0])


def test_topk_few_rows(spark):
    df = spark.createDataFrame([(100, [1.0]), (7, [2.0]), (None, [5.0])], "vec_id long, v array<double>")
    assert [tuple(r) for r in top_k(df, df.where("vec_id = 100"), "vec_id", "v", 10).collect()] == [(100, 1, 7, 2)]
    assert top_k(df.limit(0), df, "vec_id", "v").collect() == [] and top_k(df, df.limit(0), "vec_id", "v").collect() == []


def test_the_bound_spares_leaves_of_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 400
    rows = [(i, [float(v) for v in np.floor(centres[i % 40] + rng.normal(size=16) * 10)]) for i in range(8000)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    report = {}
    got = top_k(df, df.where("vec_id % 200 = 0"), "vec_id", "v", 10, report)
    x = np.array([v for _, v in rows])
    want = []
    for q in range(0, 8000, 200):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(8000), -s)).tolist() if i != q][:10]
        want += [(q, n + 1, i, int(s[i])) for n, i in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert 0 < report["read"] < 0.5 * report["leaves"], report


def test_scores_beyond_doubles(spark):
    big = 2.0**29
    df = spark.createDataFrame([(i, [big + i, big - i]) for i in range(150)], "vec_id long, v array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, df.where("vec_id = 100"), "vec_id", "v", 3).collect()]
    assert [r[2] for r in sorted(got)] == [149, 148, 147]


def test_ball_tree_bound_holds():
    rng = np.random.default_rng(1)
    tree = BallTree(rng.normal(size=(700, 5)) * 100)
    q = rng.normal(size=5)
    for (a, b, _, _), c, r in zip(tree.nodes.tolist(), tree.centre, tree.radius):
        assert (tree.points[a:b] @ q).max() <= q @ c + np.linalg.norm(q) * r + 1e-6
