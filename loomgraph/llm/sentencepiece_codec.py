"""SentencePiece encoding and decoding by a batched lattice search in numpy.

Different units of a slice are sorted by length, and units of equal length
advance together: at each end position the substrings of up to the longest
piece are hashed from prefix hashes and probed in the sorted keys of the
pieces; the best arc into the position is a vectorised maximum (earlier start
on ties) that leaves a backpointer.

The weight of an arc depends on the model file.  Unigram: the piece's score,
which is the Viterbi search itself; an unknown character costs the lowest score
less 10.  BPE: such sums are not what the file means, so an arc weighs 0 if its
piece fits the piece before it as merges would leave them, else minus infinity;
just one arc a position fits, and the ids are those of the merges.  Scores are
32-bit floats summed unit by unit; the library sums them over the whole text,
so for a unigram file sums that differ by less than its rounding can fall
otherwise late in a long text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches, freed, unused_name
from .spm import BPE, Probe, Vocabulary, probe, units

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text encoded at once, units advanced at once, and units remembered by a worker.
SLICE = 4 << 20
BLOCK = 1 << 15
#: Long units of equal length that are too few for columns: each is walked by itself, so that one very long unit costs a step a character.
FEW, LONG = 12, 64
REMEMBERED = 800_000


def _advance(words: list[str], length: int, p: Probe) -> np.ndarray:
    """Backpointers: the piece that ends at each position (p.size: an unknown character) of words of equal length."""
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)
    prefix = p.prefix(chars)
    bpe = p.vocabulary.kind == BPE
    best = np.full((len(words), length + 1), -np.inf, np.float32)
    best[:, 0] = 0
    back = np.full((len(words), length + 1), -1, np.int64)
    for end in range(1, length + 1):
        for start in range(max(0, end - p.vocabulary.longest), end):
            piece = p.find(chars, prefix, start, end)
            if start == end - 1:
                piece = np.where(piece < 0, p.size, piece)
            rows = np.flatnonzero(piece >= 0)
            if not len(rows):
                continue
            piece = piece[rows]
            if bpe:
                weight = np.zeros(len(rows), np.float32)
                known = piece < p.size
                last = back[rows, start]
                after_unknown = last == p.size  # nothing merges with an unknown character
                fits = p.pair_fits(np.where(after_unknown, -1, last)[known], piece[known])
                weight[known] = np.where(fits, 0.0, -np.inf)
            else:
                weight = p.scores[piece]
            value = best[rows, start] + weight
            better = value > best[rows, end]
            best[rows[better], end] = value[better]
            back[rows[better], end] = piece[better]
    return back


def _walk(word: str, p: Probe) -> list[tuple[int, int]]:
    """(piece, start) of the best path of one unit, by the rules of _advance."""
    n, longest = len(word), p.vocabulary.longest
    index, scores = p.index, p.scores
    bpe = p.vocabulary.kind == BPE
    best = [np.float32(0)] + [None] * n
    back: list[tuple[int, int]] = [(-1, 0)] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            piece = index.get(word[start:end], -1)
            if piece < 0:
                if start < end - 1:
                    continue
                piece = p.size
            if best[start] is None:
                continue
            if bpe:
                last = back[start][0]
                if piece < p.size and not p.pair_fits_one(-1 if last == p.size else last, piece):
                    continue
                value = best[start]
            else:
                value = best[start] + scores[piece]
            if best[end] is None or value > best[end]:
                best[end], back[end] = value, (piece, start)
    out = []
    while n:
        out.append(back[n])
        n = back[n][1]
    return out[::-1]


def encode_units(words: list[str], p: Probe) -> list[list[int]]:
    """Ids of each unit."""
    out: list[list[int]] = [[]] * len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    ids, v = p.vocabulary.ids, p.vocabulary
    at = 0
    while at < len(order):
        length = int(lengths[order[at]])
        end = min(int(np.searchsorted(lengths[order], length, "right")), at + max(1, BLOCK // max(1, length)) * 8)
        chosen = [words[i] for i in order[at:end].tolist()]
        if length >= LONG and len(chosen) < FEW:
            for i, word in zip(order[at:end].tolist(), chosen):
                found = []
                for piece, start in _walk(word, p):
                    if piece < p.size:
                        found.append(int(ids[piece]))
                    elif v.fallback:
                        found.extend(v.unknown_ids(word[start]))
                    elif not found or found[-1] != v.unk:
                        found.append(v.unk)
                out[i] = found
        elif length:
            back = _advance(chosen, length, p)
            width = np.append(p.lengths[: p.size], 1)
            where = np.full(len(chosen), length)
            rows = np.arange(len(chosen))
            steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            while len(rows):
                piece = back[rows, where]
                where = where - width[piece]
                steps.append((rows, piece, where))
                rows, where = rows[where > 0], where[where > 0]
            found: list[list[int]] = [[] for _ in chosen]
            known = np.append(ids, -1)
            for rows, piece, where in reversed(steps):
                for r, i, s in zip(rows.tolist(), known[piece].tolist(), where.tolist()):
                    if i >= 0:
                        found[r].append(i)
                    elif v.fallback:
                        found[r].extend(v.unknown_ids(chosen[r][s]))
                    elif not found[r] or found[r][-1] != v.unk:
                        found[r].append(v.unk)
            for i, x in zip(order[at:end].tolist(), found):
                out[i] = x
        at = end
    return out


class Encoder:
    """Encodes slices of texts; remembers the units that it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.p = probe(vocabulary)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.bounds = np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        codes, offsets, names = units(texts, self.p.vocabulary)
        if len(self.place) > REMEMBERED:
            self.clear()
        new = [w for w in dict.fromkeys(names) if w not in self.place]
        if new:
            got = encode_units(new, self.p)
            for w in new:
                self.place[w] = len(self.place)
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in got for i in x), np.int32, int(sizes.sum()))])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        place = np.fromiter((self.place[w] for w in names), np.int64, len(names))
        at = place[codes]
        sizes = self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(self.bounds[at] - (ends - sizes), sizes)
        starts = np.concatenate([[0], ends])[offsets]
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(self.flat[index], pa.int32()))


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One for each worker process and model, so that tasks share its tables."""
    if vocabulary.digest not in _encoders:
        _encoders.clear()
        _encoders[vocabulary.digest] = Encoder(vocabulary)
    return _encoders[vocabulary.digest]


def decode(ids: pa.ListArray, v: Vocabulary) -> pa.Array:
    """Texts of id lists; ids outside the vocabulary give nothing, bytes that are no UTF-8 give U+FFFD each."""
    size = len(v.surface)
    bare = [x[1:] if x[:1] == b" " and i != v.unk else x for i, x in enumerate(v.surface)]
    table = pa.array([*v.surface, b"", *bare], pa.binary())
    flat = np.asarray(ids.flatten().fill_null(size))
    flat = np.where((flat >= 0) & (flat < size), flat, size)
    offsets = ids.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    if v.dummy:  # the first piece that shows loses its mark
        shows = np.flatnonzero(np.array([bool(x) for x in v.surface] + [False])[flat])
        first = np.searchsorted(shows, offsets[:-1])
        some = first < len(shows)
        at = shows[first[some]]
        at = at[at < offsets[1:][some]]
        flat[at] += size + 1
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), table.take(pa.array(flat)))
    joined = pc.binary_join(lists, b"")
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([_lenient(x) for x in joined.to_pylist()], pa.string())


def _lenient(raw: bytes) -> str:
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


def _codec(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            sizes = pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in byte_batches([range(n) for n in sizes.tolist()], SLICE):
                ids = coder.encode(text.slice(a, b - a))
                rest = [batch.column(c).slice(a, b - a) for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, text.slice(a, b - a), ids, decode(ids, vocabulary)], names=[*batch.schema.names, "ids", "decoded"])
        coder.clear()

    return freed(run)


def encode_and_decode(docs: DataFrame, text_col: str = "text", model: str = MODEL, ids: str = "piece_ids", decoded: str = "decoded") -> DataFrame:
    """docs with two more columns: the piece ids of the text and the text that they decode to.

    Null and empty texts have no pieces and decode to an empty text.  Repeated
    rows are encoded each for itself; a very long text, or one long unit without
    spaces, takes time in proportion to its length.  Decoding
    gives the text back, but for U+2581, which a model file cannot tell from a
    space.  Columns of docs that bear the new names are replaced.  No shuffle.
    The model file is read by the driver.
    """
    vocabulary = Vocabulary.read(model)
    keep = [c for c in docs.columns if c not in (ids, decoded) and c != text_col]
    narrow = docs.select(*keep, F.col(text_col))
    more = [T.StructField(unused_name(narrow, "loom_ids"), T.ArrayType(T.IntegerType())), T.StructField(unused_name(narrow, "loom_decoded"), T.StringType())]
    schema = T.StructType([*narrow.schema.fields, *more])
    out = narrow.mapInArrow(_codec(vocabulary), schema)
    back = [F.col(c) for c in docs.columns if c not in (ids, decoded)]
    return out.select(*back, F.col(more[0].name).alias(ids), F.col(more[1].name).alias(decoded))
