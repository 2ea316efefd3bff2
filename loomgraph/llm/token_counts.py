"""Token counts without ids: an Aho-Corasick automaton lists the pieces that end at each character.

For each different unit the dynamic programme carries, a position, the best
score and the number of pieces of the best path.  Ties go to the piece that
starts first, as in the tokenizer: the automaton lists the longest match first
and only a greater score replaces it.  An unknown character counts its bytes
where the model falls back to bytes; else a run of unknowns counts once.

A BPE file is read by its merges instead of by sums of scores: a match counts
if it fits the piece before it as merges would leave the two (one match a
position does), so the state is the last piece and the count.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches, unused_name
from .sentencepiece_codec import MODEL, SLICE
from .spm import BPE, Vocabulary, probe, units

REMEMBERED = 500_000


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.p = probe(vocabulary)
        self.matcher = ahocorasick.Automaton()
        for i, piece in enumerate(vocabulary.pieces):
            self.matcher.add_word(piece, (len(piece), i))
        self.matcher.make_automaton()
        self.scores = list(vocabulary.scores)
        self.count = self.by_merges if vocabulary.kind == BPE else self.by_score
        self.known: dict[str, int] = {}

    def _unknown(self, ch: str) -> int:
        return len(ch.encode()) if self.v.fallback else 1

    def by_score(self, unit: str) -> int:
        n = len(unit)
        best, count, unknown = [np.float32(0)] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        scores, penalty = self.scores, self.v.unknown_score
        matches = self.matcher.iter(unit)
        end, (length, piece) = next(matches, (n, (0, 0)))
        for at in range(n):
            top, pieces, single = None, 0, False
            while end == at:
                start = at + 1 - length
                value = best[start] + scores[piece]
                if top is None or value > top:
                    top, pieces = value, count[start] + 1
                single = single or length == 1
                end, (length, piece) = next(matches, (n, (0, 0)))
            lost = False
            if not single:
                value = best[at] + penalty
                if top is None or value > top:
                    lost = True
                    top = value
                    pieces = count[at] + (0 if unknown[at] and not self.v.fallback else self._unknown(unit[at]))
            best[at + 1], count[at + 1], unknown[at + 1] = top, pieces, lost
        return count[n]

    def by_merges(self, unit: str) -> int:
        n, size = len(unit), self.p.size
        last, count = [-1] * (n + 1), [0] * (n + 1)
        fits = self.p.pair_fits_one
        matches = self.matcher.iter(unit)
        end, (length, piece) = next(matches, (n, (0, 0)))
        for at in range(n):
            chosen = size
            while end == at:
                start = at + 1 - length
                if chosen == size:
                    before = last[start]
                    if fits(-1 if before == size else before, piece):
                        chosen = piece
                        count[at + 1] = count[start] + 1
                end, (length, piece) = next(matches, (n, (0, 0)))
            if chosen == size:
                count[at + 1] = count[at] + (0 if last[at] == size and not self.v.fallback else self._unknown(unit[at]))
            last[at + 1] = chosen
        return count[n]

    def counts(self, texts: pa.Array) -> np.ndarray:
        codes, offsets, names = units(texts, self.v)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, count = self.known, self.count
        each = np.zeros(len(names) + 1, np.int64)
        for i, w in enumerate(names):
            c = known.get(w)
            if c is None:
                c = known[w] = count(w)
            each[i] = c
        total = np.concatenate([[0], np.cumsum(each[codes])])
        return np.diff(total[offsets])


_counters: dict[str, Counter] = {}


def counter(vocabulary: Vocabulary) -> Counter:
    """One for each worker process and model, so that tasks share what it remembers."""
    if vocabulary.digest not in _counters:
        _counters.clear()
        _counters[vocabulary.digest] = Counter(vocabulary)
    return _counters[vocabulary.digest]


def _counted(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(vocabulary)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            sizes = pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False)
            got = [known.counts(text.slice(a, b - a)) for a, b in byte_batches([range(n) for n in sizes.tolist()], SLICE)]
            total = np.concatenate(got) if got else np.zeros(0, np.int64)
            rest = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(total)], names=[*batch.schema.names[:-1], "n"])

    return run


def count_tokens(docs: DataFrame, text_col: str = "text", model: str = MODEL, name: str = "n_tokens") -> DataFrame:
    """docs without the text column, with the number of tokens of the text (long).

    Null and empty texts count 0; repeated rows count each for itself; a very
    long text or unit takes time in proportion to its length.  A column of docs that bears the new name is
    replaced.  No shuffle; the model file is read by the driver.
    """
    vocabulary = Vocabulary.read(model)
    keep = [c for c in docs.columns if c not in (text_col, name)]
    narrow = docs.select(*keep, F.col(text_col))
    count = T.StructField(unused_name(narrow, "loom_count"), T.LongType())
    schema = T.StructType([*docs.select(*keep).schema.fields, count])
    return narrow.mapInArrow(_counted(vocabulary), schema).withColumnRenamed(count.name, name)
