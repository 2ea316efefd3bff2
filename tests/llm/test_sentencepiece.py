import random

import pyarrow as pa
import pytest
import sentencepiece
from loomgraph.llm import queries
from loomgraph.llm.sentencepiece_codec import MODEL, Encoder, decode, encode_and_decode
from loomgraph.llm.spm import UNIGRAM, Vocabulary
from loomgraph.llm.token_counts import Counter, count_tokens

SF = "/root/testdata/sf0.001"


def unigram_model(byte_fallback=True, scores=None):
    """The public pieces as a unigram vocabulary: same pieces, scores falling with the rank."""
    from math import log

    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = UNIGRAM
    m.trainer_spec.byte_fallback = byte_fallback
    for i, p in enumerate(m.pieces):
        if p.type == 6 and not byte_fallback:
            p.type = 5  # unused
        if p.type == 1:
            p.score = scores(i, p.piece) if scores else -round(log(i + 2) * 64) / 64  # sums are exact
    return m.SerializeToString()


def texts(n=300):
    rng = random.Random(4)
    alphabet = "abcdeeeettth  \n▁éü日本\x00#$7.,!AZ"
    out = ["", " ", "  ", "a", "\n", " lead", "trail ", "two  spaces", "   ▁▁ x", "▁", "日本 語", "naïve 😀😀 x", "x" * 300, "the " * 50]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(n)]


# Whole numbers add up exactly in any precision, and make many ties.
TIES = lambda i, piece: -float(2 + len(piece) % 3)


@pytest.mark.parametrize("model", ["bpe", "unigram", "unigram-ties", "unigram-unk"])
def test_same_as_the_library(model):
    raw = open(MODEL, "rb").read() if model == "bpe" else unigram_model(model != "unigram-unk", TIES if model == "unigram-ties" else None)
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    v = Vocabulary(raw)
    sample = texts()
    got = Encoder(v).encode(pa.array(sample)).to_pylist()
    want = library.encode(sample)
    assert [(t, g) for t, g, w in zip(sample, got, want) if g != w] == []
    assert Counter(v).counts(pa.array(sample)).tolist() == [len(w) for w in want]
    assert decode(pa.array(want, pa.list_(pa.int32())), v).to_pylist() == library.decode(want)


def test_decoding_odd_ids():
    raw = open(MODEL, "rb").read()
    v, library = Vocabulary(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    lists = [[3 + 0xE6, 3 + 0x97], [1, 264, 2], [0], [3 + 0xFF, 264], [264, 3 + 0xF0, 3 + 0x9F, 3 + 0x98, 3 + 0x80]]
    assert decode(pa.array(lists, pa.list_(pa.int32())), v).to_pylist() == library.decode(lists)
    assert decode(pa.array([[99999, 264], []], pa.list_(pa.int32())), v).to_pylist() == ["a", ""]


def test_whole_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = list(docs)
    want = dict(zip(ids, library.encode([docs[i] for i in ids])))
    got = {r.doc_id: r for r in queries.op1_sentencepiece(spark, SF).collect()}
    assert {i: list(r.piece_ids) for i, r in got.items()} == want
    assert all(r.lossless and r.n_pieces == len(want[i]) for i, r in got.items())
    assert {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, SF).collect()} == {i: len(w) for i, w in want.items()}


def test_odd_rows(spark):
    long = "ab cd " * 50_000 + "e" * 5_000
    rows = [(1, None, "x"), (2, "", "y"), (None, "one two", None), (4, long, "z"), (4, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = encode_and_decode(docs)
    assert got.columns == ["doc_id", "text", "piece_ids", "decoded"]
    assert sorted(((r.doc_id or 0), len(r.piece_ids), r.decoded) for r in got.collect()) == sorted(((i or 0), len(library.encode(t or "")), t or "") for i, t, _ in rows)
    counts = count_tokens(docs)
    assert counts.columns == ["doc_id", "decoded", "n_tokens"]
    assert sorted(r.n_tokens for r in counts.collect()) == sorted(len(library.encode(t or "")) for _, t, _ in rows)
    assert encode_and_decode(docs.limit(0)).collect() == [] and count_tokens(docs.limit(0)).collect() == []


def test_one_very_long_unit():
    import random
    import time

    import pyarrow as pa
    import sentencepiece
    from loomgraph.llm.sentencepiece_codec import MODEL, Encoder
    from loomgraph.llm.spm import Vocabulary

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghij中文字é") for _ in range(n)) for n in (40_000, 3000, 3000, 7)]
    began = time.process_time()
    got = Encoder(Vocabulary.read(MODEL)).encode(pa.array(texts)).to_pylist()
    assert time.process_time() - began < 20
    assert got[1:] == [sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(t) for t in texts[1:]]
