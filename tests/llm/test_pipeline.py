"""The pipeline against a version of each stage that is written another way: SQL, brute force, the library."""

import corpus_pipeline
import duckdb
import sentencepiece
from loomgraph.llm.oracle import ORACLE
from loomgraph.llm.sentencepiece_codec import MODEL
from test_line_dedup import slow_dedup

SF = "/root/testdata/sf0.001"


COLUMNS = "doc_id, text, lang, source, n_chars"


def slow_kept(rows, earlier):
    """Ids that stay: the smallest of each group of texts with equal words or a Jaccard similarity of 0.8 of their five-word shingles, now or before."""

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    ids = sorted(rows)
    group = {i: i for i in ids}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for texts in (rows, earlier):
        made = {i: shingles(texts[i]) for i in ids}
        for i in ids:
            for j in ids:
                if j >= i:
                    break
                n = len(made[i] & made[j])
                if find(i) != find(j) and n >= 0.8 * (len(made[i]) + len(made[j]) - n):
                    a, b = sorted((find(i), find(j)))
                    group[b] = a
    return {i for i in ids if find(i) == i}


def test_each_stage_on_its_own_input(spark, tmp_path):
    c = duckdb.connect()
    c.sql(f"create view labels as select * from '{SF}/labels.parquet'")
    stages = dict(corpus_pipeline.STAGES)

    def staged(name, docs):
        stages[name](spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        return out, {r.doc_id: r for r in out.collect()}

    def by_sql(name, rows):
        c.sql(f"create or replace table documents as select {COLUMNS} from '{SF}/documents.parquet' limit 0")
        c.executemany("insert into documents values (?, ?, ?, ?, ?)", [[r.doc_id, r.text, r.lang, r.source, r.n_chars] for r in rows.values()])
        return {r[0] for r in c.sql(name).fetchall()}

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    first = {i: r.text for i, r in rows.items()}
    good, kept = staged("quality", docs)
    assert set(kept) == by_sql(f"select doc_id from ({ORACLE['op9_quality']}) where keep", rows)
    cut, lines = staged("line_dedup", good)
    want = slow_dedup([(i, r.text) for i, r in kept.items()])
    want = {i: t for i, t in want.items() if t == kept[i].text or t.strip(" \t\r\n")}
    assert sum(i not in lines or lines[i].text != t for i, t in want.items()) + len(set(lines) - set(want)) <= 3
    assert all(r.n_chars == len(r.text) for r in lines.values())
    once, single = staged("simhash_dedup", cut)
    best = slow_kept({i: r.text for i, r in lines.items()}, first)
    assert best <= set(single) and len(set(single) - best) <= 0.1 * (len(lines) - len(best)) and len(best) < len(lines)
    sampled, some = staged("mixing", once)
    assert set(some) == by_sql(f"select doc_id from ({ORACLE['op5_source_mixing']}) where sampled", single)
    _, last = staged("sentencepiece", sampled)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {i: (r.text, list(r.piece_ids), r.n_pieces) for i, r in last.items()} == {i: (r.text, sp.encode(r.text), len(sp.encode(r.text))) for i, r in some.items()}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*COLUMNS.split(", "), "piece_ids", "n_pieces"]
    assert {r.doc_id: r.text for r in got.collect()} == {i: r.text for i, r in last.items()}


def test_stages_take_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone_id long, n_lines string, N_Dropped string, piece_ids int, n_pieces int, decoded int, evidence int, topic int"
    more = (None, "a", "b", 1, 2, 3, 4, 5)
    two = "a line of five words\na line of five words"
    rows = [
        (1, None, None, None, None, *more), (2, "", "en", "s", 0, *more), (None, "no id but words of its own here", "en", "s", 31, *more), (4, two, "en", "s", 41, *more),
        (4, two, "en", "s", 41, *more), (5, "many words " * 30_000, "en", "s", 330_000, *more), (6, "x" * 100_000, "en", "s", 100_000, *more),
    ]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert set(docs.columns) <= set(out.columns) and (i == 4 or out.columns == docs.columns), name
            out.write.mode("overwrite").parquet(f"{tmp_path}/out-{name}")
            if "N_Dropped" in docs.columns:
                assert {r.N_Dropped for r in spark.read.parquet(f"{tmp_path}/out-{name}").collect()} <= {"b"}


def test_tables_of_a_run_go(spark):
    from loomgraph.llm.common import Workspace

    before = list(Workspace.live)
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert len([w for w in Workspace.live if w not in before]) == 1
