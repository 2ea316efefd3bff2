"""SentencePiece model files: vocabulary, units of text, and merge-consistent pairs.

A text is cut into units that no piece can cross: a run of the space mark and
the characters up to the next one.  Equal units are worked out once a slice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Fixed values of the file format: what an unknown character costs beside the lowest piece.
UNKNOWN_PENALTY = 10.0
P = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20


class Vocabulary:
    """What encoding and decoding need of a model file; small, and sent to the executors once.

    Supported: unigram and BPE models whose normaliser is the identity, without
    user-defined pieces.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        train, norm = proto.trainer_spec, proto.normalizer_spec
        if train.model_type not in (UNIGRAM, BPE) or norm.precompiled_charsmap or any(p.type == USER for p in proto.pieces) or train.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with the identity normaliser and no user-defined pieces are supported")
        self.kind = train.model_type
        self.dummy = norm.add_dummy_prefix
        self.squeeze = norm.remove_extra_whitespaces
        self.fallback = train.byte_fallback
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.surface = [p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.surface[self.unk] = train.unk_surface.encode()
        self.bytes = np.zeros(256, np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == CONTROL:
                self.surface[i] = b""
        normal = [i for i, p in enumerate(proto.pieces) if p.type == NORMAL]
        self.ids = np.array(normal, np.int32)
        self.pieces = [proto.pieces[i].piece for i in normal]
        self.scores = np.array([proto.pieces[i].score for i in normal], np.float32)
        self.unknown_score = self.scores.min() - np.float32(UNKNOWN_PENALTY)
        self.longest = max(map(len, self.pieces))
        self.digest = hashlib.sha256(model).hexdigest()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read())

    def unknown_ids(self, text: str) -> list[int]:
        return self.bytes[list(text.encode())].tolist() if self.fallback else [self.unk]


class Probe:
    """Pieces by substring hash: sorted keys for whole columns, and what BPE merges make of a string."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        n, w = len(v.pieces), v.longest
        self.size = n
        self.points = np.zeros((n + 1, w), np.uint32)
        self.lengths = np.zeros(n + 1, np.int64)
        for i, p in enumerate(v.pieces):
            self.points[i, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
            self.lengths[i] = len(p)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(w + 1, P, np.uint64)) // np.uint64(1)
            self.powers = np.concatenate([[np.uint64(1)], self.powers[:-1]]).astype(np.uint64)
            keys = np.zeros(n, np.uint64)
            for i in range(w):
                more = self.lengths[:n] > i
                keys[more] = keys[more] * P + self.points[:n][more, i].astype(np.uint64) + np.uint64(1)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        #: By the highest bits of a hash: whether a piece can have it.
        self.likely = np.zeros(1 << FILTER_BITS, bool)
        self.likely[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.scores = np.append(v.scores, v.unknown_score)
        self.rank = dict(zip(v.pieces, v.scores.tolist()))
        self.index = {x: i for i, x in enumerate(v.pieces)}
        self._pairs: dict[int, bool] = {}
        self._none = self._main = self._recent = (np.zeros(0, np.int64), np.zeros(0, bool))

    def prefix(self, chars: np.ndarray) -> np.ndarray:
        out = np.zeros((chars.shape[0], chars.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(chars.shape[1]):
                out[:, i + 1] = out[:, i] * P + chars[:, i].astype(np.uint64) + np.uint64(1)
        return out

    def find(self, chars: np.ndarray, prefix: np.ndarray, start: int, end: int) -> np.ndarray:
        """Index of the piece that stands at start..end of each row, -1 where none does (hash hits are compared in full)."""
        length = end - start
        with np.errstate(over="ignore"):
            key = prefix[:, end] - prefix[:, start] * self.powers[length]
        out = np.full(len(key), -1, np.int64)
        hit = np.flatnonzero(self.likely[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if len(hit):
            at = np.minimum(np.searchsorted(self.keys, key[hit]), self.size - 1)
            equal = self.keys[at] == key[hit]
            hit = hit[equal]
            piece = self.order[at[equal]]
            same = (self.lengths[piece] == length) & (self.points[piece, :length] == chars[hit, start:end]).all(axis=1)
            out[hit[same]] = piece[same]
        return out

    def pair_fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of two pieces gives just these two (left -1: right alone).

        Merges never cross a boundary that stays, so a row of pieces is what the
        merges give if and only if each neighbouring pair is.
        """
        key = (left + 1) * (self.size + 1) + right
        out = np.zeros(len(key), bool)
        rest = np.arange(len(key))
        for keys, values in (self._main, self._recent):
            if len(keys) and len(rest):
                at = np.minimum(np.searchsorted(keys, key[rest]), len(keys) - 1)
                known = keys[at] == key[rest]
                out[rest[known]] = values[at[known]]
                rest = rest[~known]
        if len(rest):
            new, back = np.unique(key[rest], return_inverse=True)
            fits = np.fromiter((self._fits(k) for k in new.tolist()), bool, len(new))
            out[rest] = fits[back]
            self._recent = self._joined(self._recent, (new, fits))
            if len(self._recent[0]) > 1 << 14:
                if len(self._main[0]) > 1 << 22:  # a bound on memory; what is forgotten is worked out again
                    self._main = self._none
                self._main, self._recent = self._joined(self._main, self._recent), self._none
        return out

    @staticmethod
    def _joined(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order]

    def _fits(self, key: int) -> bool:
        left, right = key // (self.size + 1) - 1, key % (self.size + 1)
        pieces = self.vocabulary.pieces
        a, b = pieces[left] if left >= 0 else "", pieces[right]
        return self.merge_text(a + b) == ([a, b] if a else [b])

    def pair_fits_one(self, left: int, right: int) -> bool:
        key = (left + 1) * (self.size + 1) + right
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) > 1 << 20:
                self._pairs.clear()
            got = self._pairs[key] = self._fits(key)
        return got

    def merge_text(self, text: str) -> list[str]:
        """What the merges make of a string: adjacent symbols are joined, best score first, leftmost on ties."""
        rank = self.rank.get
        parts = list(text)
        values = [rank(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, where = None, -1
            for i, x in enumerate(values):
                if x is not None and (best is None or x > best):
                    best, where = x, i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
            del values[where]
            if where:
                values[where - 1] = rank(parts[where - 1] + parts[where])
            if where < len(values):
                values[where] = rank(parts[where] + parts[where + 1])


_probes: dict[str, Probe] = {}


def probe(vocabulary: Vocabulary) -> Probe:
    """One for each worker process and model."""
    if vocabulary.digest not in _probes:
        _probes.clear()
        _probes[vocabulary.digest] = Probe(vocabulary)
    return _probes[vocabulary.digest]


def units(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of each unit, offsets of the texts in them, the different units).  Null counts as empty."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    if v.squeeze:
        texts = pc.utf8_trim(pc.replace_substring_regex(texts, " +", " "), " ")
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(texts, " ")
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = parts.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy().astype(np.int64)
    different = [MARK + w for w in names]
    if "" not in names and v.dummy:
        return codes, offsets, different
    # Runs of marks: an empty part hands its mark to the part that follows it.
    extra: dict[str, int] = {}
    blank = codes == names.index("") if "" in names else np.zeros(len(codes), bool)
    stays = ~blank
    starts = offsets[:-1][np.diff(offsets) > 0]
    first = np.zeros(len(codes), bool)
    first[starts] = True
    ends = np.zeros(len(codes), bool)
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    odd = np.flatnonzero(blank | (first & (not v.dummy)) | np.concatenate([[False], blank[:-1]]))
    of = np.searchsorted(offsets, odd, "right") - 1
    run = 0
    for i, d in zip(odd.tolist(), of.tolist()):
        own = 0 if first[i] and not v.dummy else 1
        run = own if first[i] else run + own
        if empty[d]:
            continue
        if blank[i]:
            if not ends[i]:
                continue
            name = MARK * run
            stays[i] = bool(name)
        else:
            name = MARK * run + names[codes[i]]
        run = 0
        codes[i] = extra.setdefault(name, len(different) + len(extra))
    total = np.concatenate([[0], np.cumsum(stays)])
    return codes[stays], total[offsets], different + list(extra)
