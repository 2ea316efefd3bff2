"""Fuzzy line dedup: SimHash of normalised lines, blocks of shared sketch values, edit similarity, one line a group.

A line is what stands between two line feeds.  Its normalised form is lower
case with every run of ASCII characters other than letters and digits as one
space, none at the ends.  Lines without a letter or digit are left alone.  Equal
normalised lines are one group, however short.  Two different ones of
``min_words`` words or more are linked if their edit similarity, 1 - distance /
longer length, is at least ``similarity``.  Of each connected group only the
first occurrence stays (smallest document id, then line number).

Candidates.  Edit similarity 0.8 leaves SimHashes so far apart that blocks of
their bits do not serve: within 3 of 64 bits lies less than a third of the pairs
that brute force finds, within 5 bits three fifths.  So the blocks are those of
a sketch: BLOCKS MinHashes of a line's word triples, one of which two lines must
share, as the pigeonhole principle asks of sketches that differ in fewer than
BLOCKS places.  A 128-bit SimHash of the words then admits a pair to the edit
distance: within NEAR bits, and STEP more for each block that the two share.

Work is split so that no key is one task's lot: a block of over HOT lines is
compared in tiles, and a group of over CHUNK candidates is verified in chunks.
Each chunk also holds a few leaders of its group, which ties the chunks of a
large group of near copies together; lines that are not tied to the largest part
of a block by that are then held against all lines of the block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, byte_batches, connected_components, freed, is_empty, text_or_empty, unused_name

MIN_WORDS = 5
SIMILARITY = 0.8
#: Words of a shingle, and MinHashes of a line's shingles, one of which two lines must share to be compared.
SHINGLE = 3
BLOCKS = 6
#: Differing bits of 128 up to which two lines are compared: NEAR + STEP for each block that they share.
NEAR, STEP = 16, 3
#: Lines at one key that are compared in one piece, and lines of a tile beyond that.
HOT, TILE = 2048, 1024
#: Lines of a group that are verified in one piece, and lines of a larger group that each of its chunks holds too.
CHUNK, LEADERS = 250, 8
#: Pairs of lines that are looked at side by side.
PIECE = 1 << 18
#: Characters of groups that wait for their distances at once.
HELD = 1 << 24
#: Pairs whose distances are worked out side by side.
SIDE = 192
#: Characters after which pairs that are sure to lie too far apart leave.
LOOK = 64
#: Bytes of text that a worker turns into lines at once; the arrays of a slice should fit a cache.
SLICE = 1 << 18
#: Blocks of up to so many rows are compared by shifting the whole array.
SMALL = 64
#: Lines that a task packs at once.
PACKED = 1 << 17
#: Bits of the filter that keeps texts without a wanted line out of a shuffle.
FILTER = 1 << 24
#: What normalising makes of each byte; bytes of non-ASCII characters stay.
TABLE = bytes(b if b >= 128 or b == 10 or chr(b).isalnum() else 32 for b in range(256)).lower()
P = 0x9E3779B97F4A7C15
#: A line with something in it besides ASCII marks and white space.
WORDED = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit-parallel columns over whole integers (Myers 1999, Hyyro 2003)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | (1 << i)
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    plus, minus, score = full, 0, len(b)
    for ch in a:
        eq = where.get(ch, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) | 1
        down <<= 1
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal & full
    return score


def most_edits(a: str, b: str, similarity: float) -> int:
    return int((1.0 - similarity) * max(len(a), len(b)) + 1e-9)


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Without common start and end, which leaves the distance as it is."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid :] == b[len(b) - mid :] else (lo, mid - 1)
    return a[: len(a) - lo], b[: len(b) - lo]


def quickly_similar(a: str, b: str, similarity: float = SIMILARITY) -> bool | None:
    """Whether 1 - distance / longer length >= similarity, as far as lengths or one way to edit tell; None if they don't."""
    most = most_edits(a, b, similarity)
    if abs(len(a) - len(b)) > most:
        return False
    a, b = trimmed(a, b)
    if max(len(a), len(b)) <= most or by_words(a.split(" "), b.split(" "), most) <= most:
        return True
    return None


def edit_similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """1 - distance / longer length >= similarity."""
    got = quickly_similar(a, b, similarity)
    return edit_distance(*trimmed(a, b)) <= most_edits(a, b, similarity) if got is None else got


def edit_distances(pairs: list[tuple[str, str]], most: list[int] | None = None) -> list[int]:
    """Levenshtein distances of many pairs at once: edit_distance with the columns of all pairs as fields of one whole number.

    A field has a bit more than its pattern, so that sums do not run into the
    next one; bits above a shorter pattern never reach those below.  The
    distance is the text's length and the sum of the last column's steps.
    ``most``: a pair leaves as soon as its distance is sure to be larger, with
    a number between the two.
    """
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    size = max(len(a) for a, _ in pairs) // 8 + 1
    masks = []
    for a, _ in pairs:
        where: dict[str, int] = {}
        for i, ch in enumerate(a):
            where[ch] = where.get(ch, 0) | (1 << i)
        masks.append({ch: x.to_bytes(size, "little") for ch, x in where.items()})
    none = bytes(size)
    sizes = np.array([(len(a), len(b)) for a, b in pairs])
    ends: dict[int, list[int]] = {}
    for k, n in enumerate(sizes[:, 1].tolist()):
        ends.setdefault(n, []).append(k)
    out, alive, at = [0] * len(pairs), list(range(len(pairs))), 0

    def of(x: int) -> np.ndarray:
        return np.frombuffer(x.to_bytes(size * len(alive), "little"), np.uint8).reshape(-1, size)

    def over() -> None:
        for k in ends.get(at, ()):
            if k in place:
                low, shift = (1 << len(pairs[k][0])) - 1, 8 * size * place[k]
                out[k] = at + (plus >> shift & low).bit_count() - (minus >> shift & low).bit_count()

    plus, minus = (1 << 8 * size * len(pairs)) - 1, 0
    while alive:
        place = {k: p for p, k in enumerate(alive)}
        ones = int.from_bytes((1).to_bytes(size, "little") * len(alive), "little")
        full = ones * ((1 << (8 * size - 1)) - 1)
        plus &= full
        lists = []
        for k in alive:
            get = masks[k].get
            lists.append([get(ch, none) for ch in pairs[k][1][at : at + LOOK]])
        for column in zip_longest(*lists, fillvalue=none):
            if at in ends:
                over()
            eq = int.from_bytes(b"".join(column), "little")
            level = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
            down = plus & level
            up = (((minus | (full ^ (plus | level))) << 1) | ones) & full
            plus = ((down << 1) & full) | (full ^ (level | up))
            minus = up & level
            at += 1
        over()
        n, m = sizes[alive].T
        stays = m > at
        if most is not None and stays.any():
            # No way to the end is shorter than what it took to this column and the difference of the lengths that are left.
            steps = np.unpackbits(of(plus), axis=1, bitorder="little").astype(np.int8) - np.unpackbits(of(minus), axis=1, bitorder="little").astype(np.int8)
            row = np.arange(1, 8 * size + 1)
            least = np.cumsum(steps, axis=1, dtype=np.int32) + np.abs((n - m)[:, None] + at - row)
            least[row > n[:, None]] = np.iinfo(np.int32).max
            least = at + np.minimum(least.min(axis=1), np.abs(n - m + at))
            for p in np.flatnonzero(stays & (least > np.array(most)[alive])).tolist():
                out[alive[p]], stays[p] = int(least[p]), False
        if not stays.all():
            plus, minus = (int.from_bytes(of(x)[stays].tobytes(), "little") for x in (plus, minus))
            alive = [k for k, s in zip(alive, stays.tolist()) if s]
    return out


def all_similar(pairs: list[tuple[str, str]], similarity: float) -> list[bool]:
    """edit_similar of each pair, by the distances alone; pairs of like lengths go together."""
    cut = [trimmed(a, b) for a, b in pairs]
    sizes = [max(map(len, c)) for c in cut]
    order = sorted(range(len(pairs)), key=sizes.__getitem__)
    out = [False] * len(pairs)
    at = 0
    while at < len(order):
        end = at + 1
        while end < min(len(order), at + SIDE) and sizes[order[end]] <= 1.15 * sizes[order[at]] + 16:
            end += 1
        some = order[at:end]
        got = edit_distances([cut[k] for k in some], [most_edits(*pairs[k], similarity) for k in some]) if len(some) > 3 else [edit_distance(*cut[k]) for k in some]
        for k, d in zip(some, got):
            out[k] = d <= most_edits(*pairs[k], similarity)
        at = end
    return out


def by_words(x: list[str], y: list[str], most: int) -> int:
    """The cost of one way to edit, so no less than the distance: words in step, and where they part, up to the next place where two words agree.

    Stops early with a cost above ``most``.
    """
    n, m = len(x), len(y)
    i = j = cost = 0
    while i < n and j < m and cost <= most:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        skips = ((d, s - d) for s in range(1, 9) for d in range(s + 1))
        di, dj = next((p for p in skips if i + p[0] < n and j + p[1] < m and x[i + p[0] : i + p[0] + 2] == y[j + p[1] : j + p[1] + 2]), (n - i, m - j))
        left, right = " ".join(x[i : i + di]), " ".join(y[j : j + dj])
        if not di or not dj:
            cost += max(len(left), len(right)) + 1
        else:
            cost += edit_distance(left, right) if max(len(left), len(right)) <= 64 else max(len(left), len(right))
        i, j = i + di, j + dj
    return cost + sum(map(len, x[i:])) + n - i + sum(map(len, y[j:])) + m - j


def normalise(lines: pa.Array) -> list[str]:
    return [b" ".join(x.encode().translate(TABLE).split()).decode() for x in pc.utf8_lower(lines).to_pylist()]


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """1, P, P^2 ... modulo 2^64."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, P, np.uint64))])
    return _powers[:n]


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """A bijection that spreads each bit over all (the finalizer of a public 64-bit hash)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(salt)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def rolled(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Polynomial hash of each run of values."""
    at = np.arange(len(values)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        return np.add.reduceat(values * powers(int(sizes.max()))[at], starts)


def simhash(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of each run of word hashes: a bit is set if it is set in over half of them.

    Bits are counted as bytes, eight to an integer, in runs of at most 255 words.
    """
    out = np.zeros(len(starts), np.uint64)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    stops = starts + sizes
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(stops, starts[at] + (1 << 18), "right")))
        base, part = starts[at:end], sizes[at:end]
        bits = np.unpackbits(words[base[0] : stops[end - 1]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        runs = -(-part // 255)
        first = np.cumsum(runs) - runs
        begin = np.repeat(base - base[0], runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
        counts = np.add.reduceat(np.add.reduceat(bits, begin, axis=0).view(np.uint8), first, axis=0, dtype=np.int64)
        out[at:end] = ((2 * counts > part[:, None]) * weight).sum(axis=1, dtype=np.uint64)
        at = end
    return out


def sketches(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """BLOCKS keys for each run of word hashes: MinHashes of its shingles of SHINGLE words (of all its words, if it has fewer)."""
    ends = np.repeat(starts + sizes, sizes)
    at = np.arange(len(words))
    with np.errstate(over="ignore"):
        shingles = words.copy()
        for k in range(1, SHINGLE):
            shingles = shingles * np.uint64(P) + np.where(at + k < ends, np.concatenate([words[k:], np.zeros(min(k, len(words)), np.uint64)]), np.uint64(0))
    cut = (at + SHINGLE > ends) & (at > np.repeat(starts, sizes))
    out = np.empty((len(starts), BLOCKS), np.int32)
    shingles = mix(shingles, 6)
    for k in range(BLOCKS):
        with np.errstate(over="ignore"):  # the high half of a product with an odd number
            h = ((shingles * np.uint64(P + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(32)).astype(np.uint32)
        h[cut] = 0xFFFFFFFF
        out[:, k] = np.minimum.reduceat(h, starts).view(np.int32)
    return out


LINES = "k1 long, k2 long, id long, line int, h1 long, h2 long, fp long, fp2 long, sig long, keys array<int>"


def line_table(docs: list[pa.Array], texts: pa.Array, min_words: int) -> pa.RecordBatch:
    """A row for each line of one word or more: columns of its document, number, 128-bit hash, and for lines of min_words words the SimHash and the block keys.

    ``sig`` packs what a comparison needs besides: a byte of each block key, and the length (16 bits, longer lines at the limit).
    """
    names = [f.split(" ")[0] for f in LINES.split(", ")]
    low = pc.utf8_lower(texts)
    offsets = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    data = (low.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if offsets[-1] > offsets[0] else b"").translate(TABLE)
    offsets = offsets - offsets[0]
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | (raw == 10)
    before = np.concatenate([[True], blank[:-1]]) if len(raw) else blank
    before[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(~blank & before)
    if not len(starts):
        none = pa.array([], pa.int64())
        return pa.RecordBatch.from_arrays([*(d.slice(0, 0) for d in docs), none.cast(pa.int32()), none, none, none, none, none, pa.array([], pa.list_(pa.int32()))], names=names)
    after = np.concatenate([blank[1:], [True]])
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    sizes = np.flatnonzero(~blank & after) + 1 - starts
    doc = np.searchsorted(offsets[:-1], starts, "right") - 1
    feeds = np.flatnonzero(raw == 10)
    line = np.searchsorted(feeds, starts)
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]))
    count = np.diff(np.append(begin, len(starts)))
    words = mix(rolled(raw[~blank].astype(np.uint64) + np.uint64(1), np.cumsum(sizes) - sizes, sizes), 1)
    h1 = mix(rolled(words, begin, count), 2).view(np.int64)
    h2 = mix(rolled(mix(words, 3), begin, count), 4).view(np.int64)
    fuzzy = count >= min_words
    fp, fp2, sig = (np.zeros(len(begin), np.int64) for _ in range(3))
    keys = np.zeros((0, BLOCKS), np.int32)
    if fuzzy.any():
        some = words[np.repeat(fuzzy, count)]
        kept = count[fuzzy]
        first = np.cumsum(kept) - kept
        fp[fuzzy] = simhash(some, first, kept).view(np.int64)
        fp2[fuzzy] = simhash(mix(some, 5), first, kept).view(np.int64)
        keys = sketches(some, first, kept)
        chars = np.concatenate([[0], np.cumsum(~blank & (raw & 0xC0 != 0x80))])
        last = begin[fuzzy] + kept - 1
        size = chars[starts[last] + sizes[last]] - chars[starts[begin[fuzzy]]] + kept - 1
        packed = np.minimum(size, 0xFFFF).astype(np.uint64) << np.uint64(48)
        for k in range(BLOCKS):
            packed |= (keys[:, k].view(np.uint32) & np.uint32(255)).astype(np.uint64) << np.uint64(8 * k)
        sig[fuzzy] = packed.view(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.where(fuzzy, BLOCKS, 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
    of = doc[begin]
    number = (line[begin] - np.searchsorted(feeds, offsets[:-1])[of]).astype(np.int32)
    return pa.RecordBatch.from_arrays([*(d.take(pa.array(of)) for d in docs), *(pa.array(x) for x in (number, h1, h2, fp, fp2, sig)), lists], names=names)


#: Rows of lines and of blocks as tasks hand them on: many in one value, as a row each costs the JVM more than the work on it.
LINE = np.dtype([(x, "<i8") for x in ("h1", "h2", "k1", "k2", "id", "fp", "fp2", "sig")] + [("line", "<i4"), ("last", "?"), ("fuzzy", "?"), ("keys", "<i4", (BLOCKS,))])
BLOCK = np.dtype([("k", "<i4"), *((x, "<i8") for x in ("fp", "fp2", "sig", "node"))])
NARROW = "k1 long, k2 long, line int, h1 long, h2 long, bucket int, packed binary"
PACKS = "bucket int, packed binary"


def packs(rows: np.ndarray, by: str, parts: int) -> tuple[pa.Array, pa.Array]:
    """(bucket, packed): the rows in one value for each of ``parts`` buckets that has any; equal values of the column ``by`` share a bucket."""
    bucket = (mix(rows[by].astype(np.int64).view(np.uint64), 7) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    data, bucket = rows[order].tobytes(), bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(starts[1:], len(rows)) * rows.itemsize
    return pa.array(bucket[starts]), pa.array([data[a:b] for a, b in zip((starts * rows.itemsize).tolist(), ends.tolist())], pa.binary())


def unpacked(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for b in batches for x in b.column(1))])


def _lines(min_words: int, parts: int):
    """NARROW: a row of line -1 for each document, rows of its lines, and the lines once more, packed by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in NARROW.split(", ")]
        held: list[np.ndarray] = []

        def narrow(k1: pa.Array, k2: pa.Array, line: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([k1, k2, line, h1, h2, pa.nulls(len(k1), pa.int32()), pa.nulls(len(k1), pa.binary())], names=names)

        def flushed() -> pa.RecordBatch:
            bucket, packed = packs(np.concatenate(held), "h1", parts)
            held.clear()
            none = pa.nulls(len(bucket), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(bucket), pa.int32()), none, none, bucket, packed], names=names)

        for batch in batches:
            text = batch.column(3)
            sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield narrow(*batch.columns[:2], pa.array(np.full(batch.num_rows, -1, np.int32)), none, none)
            for a, b in byte_batches([range(n) for n in sizes.tolist()], SLICE):
                table = line_table([batch.column(c).slice(a, b - a) for c in range(3)], text.slice(a, b - a), min_words)
                if not table.num_rows:
                    continue
                yield narrow(*(table.column(c) for c in ("k1", "k2", "line", "h1", "h2")))
                rows = np.zeros(table.num_rows, LINE)
                for c in ("h1", "h2", "k1", "k2", "fp", "fp2", "sig", "line"):
                    rows[c] = np.asarray(table.column(c))
                rows["id"] = np.asarray(table.column("id").fill_null(0))
                rows["last"] = np.asarray(table.column("id").is_null())
                rows["fuzzy"] = np.diff(np.asarray(table.column("keys").offsets)) > 0
                rows["keys"][rows["fuzzy"]] = np.asarray(table.column("keys").flatten()).reshape(-1, BLOCKS)
                held.append(rows)
                if sum(map(len, held)) >= PACKED:
                    yield flushed()
        if held:
            yield flushed()

    return run


DISTINCT = "h1 long, h2 long, lead boolean, n long, first struct<last: boolean, id: long, k1: long, k2: long, line: int>, fp long, fp2 long, sig long, keys array<int>"


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DISTINCT: each line once, with its first occurrence and how often it occurs; of lines that share h1, one has lead."""
    rows = unpacked(batches, LINE)
    if not len(rows):
        return
    rows = rows[np.lexsort([rows[c] for c in ("line", "k2", "k1", "id", "last", "h2", "h1")])]
    lead = np.concatenate([[True], rows["h1"][1:] != rows["h1"][:-1]])
    begin = np.flatnonzero(lead | np.concatenate([[True], rows["h2"][1:] != rows["h2"][:-1]]))
    n = np.diff(np.append(begin, len(rows)))
    rows, lead = rows[begin], lead[begin]
    for at in range(0, len(rows), 1 << 16):
        x = rows[at : at + (1 << 16)]
        column = {c: pa.array(np.ascontiguousarray(x[c])) for c in LINE.names if c != "keys"}
        ends = np.concatenate([[0], np.cumsum(np.where(x["fuzzy"], BLOCKS, 0))]).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(x["keys"][x["fuzzy"]].ravel()))
        first = ("last", "id", "k1", "k2", "line")
        first = pa.StructArray.from_arrays([column[c] for c in first], names=first)
        columns = [column["h1"], column["h2"], pa.array(lead[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)]), first, column["fp"], column["fp2"], column["sig"], keys]
        yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "lead", "n", "first", "fp", "fp2", "sig", "keys"])


def _blocks(parts: int):
    """PACKS: each line (h1, fp, fp2, sig, keys) at each of its keys, packed by the key."""

    def packed(got: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(got).combine_chunks()
        keys = np.sort(table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, BLOCKS), axis=1)
        line, place = np.nonzero(np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1))
        rows = np.zeros(len(line), BLOCK)
        rows["k"] = keys[line, place]
        for to, c in (("fp", "fp"), ("fp2", "fp2"), ("sig", "sig"), ("node", "h1")):
            rows[to] = table.column(c).to_numpy()[line]
        return pa.RecordBatch.from_arrays(list(packs(rows, "k", parts)), names=["bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[pa.RecordBatch] = []
        for batch in batches:
            got += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in got) >= PACKED:
                yield packed(got)
                got.clear()
        if got:
            yield packed(got)

    return run


class Marks:
    """SimHashes, block bytes and lengths of some lines."""

    def __init__(self, fp: np.ndarray, fp2: np.ndarray, sig: np.ndarray):
        self.fp, self.fp2, self.sig = (x.view(np.uint64) for x in (fp, fp2, sig))

    def take(self, at) -> Marks:
        return Marks(self.fp[at], self.fp2[at], self.sig[at])

    def apart(self, i, other: Marks, j, similarity: float) -> np.ndarray:
        """Differing bits of lines i and the other's lines j, 255 where they cannot be linked or share no block."""
        bits = np.bitwise_count(self.fp[i] ^ other.fp[j]) + np.bitwise_count(self.fp2[i] ^ other.fp2[j])
        hit = np.flatnonzero(bits <= NEAR + STEP * BLOCKS)
        out = np.full(bits.shape, 255, np.uint8)
        if not len(hit):
            return out
        x, y = self.sig[i][hit], other.sig[j][hit]
        bits, both = bits[hit], x ^ y
        shared = np.zeros(both.shape, np.uint8)
        for k in range(BLOCKS):
            shared += (both >> np.uint64(8 * k)) & np.uint64(255) == 0
        n, m = (x >> np.uint64(48)).astype(np.int64), (y >> np.uint64(48)).astype(np.int64)
        fits = np.abs(n - m) <= ((1.0 - similarity) * np.maximum(n, m) + 1e-9).astype(np.int64)
        out[hit] = np.where(fits & (shared > 0) & (bits <= NEAR + STEP * shared), bits, 255)
        return out

    def close(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in i and in j of the pairs whose bits alone do not rule them out."""
        bits = np.bitwise_count(self.fp[i][:, None] ^ self.fp[j]) + np.bitwise_count(self.fp2[i][:, None] ^ self.fp2[j])
        return np.nonzero(bits <= NEAR + STEP * BLOCKS)


def forest(marks: Marks, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the candidates among lines left (all of them if right is empty), or between left and right."""
    a, b = [], []
    among = not len(right)
    rows = left if among else np.concatenate([left, right])
    marks, first = marks.take(rows), 0 if among else len(left)
    parent = np.arange(len(rows))
    step = max(1, PIECE // max(1, len(left)))
    for x in range(first, len(rows), step):
        before = min(x + step, len(rows)) if among else first
        i, j = marks.close(slice(x, x + step), slice(0, before))
        i = i + x
        if among:
            i, j = i[j < i], j[j < i]
        for at in range(0, len(i), PIECE):
            p, q = i[at : at + PIECE], j[at : at + PIECE]
            some = roots_of(parent, p) != roots_of(parent, q)
            p, q = p[some], q[some]
            hit = marks.apart(p, marks, q, similarity) < 255
            p, q = p[hit], q[hit]
            while len(p):
                u, v = roots_of(parent, p), roots_of(parent, q)
                some = u != v
                p, q, u, v = p[some], q[some], u[some], v[some]
                # One link of each root to a smaller one: no circle can come of that.
                top, where = np.unique(np.maximum(u, v), return_index=True)
                parent[top] = np.minimum(u, v)[where]
                a += rows[p[where]].tolist()
                b += rows[q[where]].tolist()
    return a, b


def roots_of(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = parent[x]
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def near_links(keys: np.ndarray, marks: Marks, similarity: float, hot: int = HOT) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Candidates among the rows (sorted) of each key, as many as tie together what all of them tie; and the (start, size) of blocks of over ``hot`` rows, which are left out."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    large = sizes > SMALL
    at = np.flatnonzero(np.repeat((sizes > 1) & ~large, sizes))
    parent = np.arange(len(keys))
    for shift in range(1, SMALL):
        at = at[at + shift < len(keys)]
        at = at[keys[at] == keys[at + shift]]
        if not len(at):
            break
        hit = at[roots_of(parent, at) != roots_of(parent, at + shift)] if shift > 1 else at
        hit = hit[marks.apart(hit, marks, hit + shift, similarity) < 255]
        left.append(hit)
        right.append(hit + shift)
        while len(hit):
            a, b = roots_of(parent, hit), roots_of(parent, hit + shift)
            hit = hit[a != b]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    deferred = []
    for a, n in zip(starts[large].tolist(), sizes[large].tolist()):
        if n > hot:
            deferred.append((a, n))
            continue
        x, y = forest(marks, np.arange(a, a + n), np.zeros(0, np.int64), similarity)
        left.append(np.array(x, np.int64))
        right.append(np.array(y, np.int64))
    return np.concatenate(left), np.concatenate(right), deferred


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that links tie to a smaller one, and the smallest node that it hangs together with: the same parts, without chains."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = at.reshape(2, -1)
    parent = np.arange(len(nodes))
    while len(p):
        u, v = parent[p], parent[q]
        some = u != v
        p, q, u, v = p[some], q[some], u[some], v[some]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while (parent != (up := parent[parent])).any():
            parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


NEAR_ROWS = "a long, b long, tile string, side int, fp long, fp2 long, sig long"


#: Of a row of verified_links: its group is in one chunk; it is in its own chunk of a larger group; it is a leader in another one.
WHOLE, MEMBER, GUEST = 0, 1, 2


def _gathered(batches: Iterator[pa.RecordBatch], columns: int) -> list[np.ndarray] | None:
    got = [[np.asarray(b.column(c)) for c in range(columns)] for b in batches if b.num_rows]
    return [np.concatenate([g[c] for g in got]) for c in range(columns)] if got else None


def _near(similarity: float, hot: int, tile: int):
    """Links (a, b) of the lines that meet at a key; for hot keys instead each line in each of the tiles that hold its part of the block.  A task holds 36 bytes a row of its share, and as much for those of keys that several rows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = unpacked(batches, BLOCK)
        if not len(got):
            return
        order = np.argsort(got["k"], kind="stable")
        keys = got["k"][order]
        same = keys[1:] == keys[:-1]
        got = got[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        if not len(got):
            return
        keys, fp, fp2, sig, ids = (np.ascontiguousarray(got[c]) for c in ("k", "fp", "fp2", "sig", "node"))
        left, right, deferred = near_links(keys, Marks(fp, fp2, sig), similarity, hot)
        names = [f.split(" ")[0] for f in NEAR_ROWS.split(", ")]
        left, right = stars(ids[left], ids[right])
        for at in range(0, len(left), 1 << 16):
            a, b = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
            blank = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.string()), pa.nulls(len(a), pa.int32()), blank, blank, blank], names=names)
        for a, n in deferred:
            parts = [np.arange(x, min(a + n, x + tile)) for x in range(a, a + n, tile)]
            for i in range(len(parts)):
                for j in range(i, len(parts)):
                    for side, rows in ((0, parts[i]), (1, parts[j])) if i < j else ((0, parts[i]),):
                        name = pa.array([f"{keys[a]}:{i}:{j}"] * len(rows))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.nulls(len(rows), pa.int64()), name, pa.array(np.full(len(rows), side, np.int32)), *(pa.array(x[rows]) for x in (fp, fp2, sig))], names=names)

    return run


def _tiled(similarity: float):
    """Links of the lines of each tile (sorted by tile)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(0).to_pylist(), *(np.asarray(b.column(c)) for c in range(1, 6))] for b in batches if b.num_rows]
        if not got:
            return
        names = [x for g in got for x in g[0]]
        side, fp, fp2, sig, ids = (np.concatenate([g[c] for g in got]) for c in range(1, 6))
        code = np.unique(np.array(names, object).astype(str), return_inverse=True)[1]
        marks = Marks(fp, fp2, sig)
        left: list[int] = []
        right: list[int] = []
        for t in range(int(code.max()) + 1):
            mine = np.flatnonzero(code == t)
            a, b = forest(marks, mine[side[mine] == 0], mine[side[mine] == 1], similarity)
            left += a
            right += b
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(ids[left], ids[right])], names=["a", "b"])

    return run


class Groups:
    """Groups of lines whose links the texts are to confirm; all groups of a batch wait for one round of edit distances.

    A spanning forest of the links is wanted, so closest pairs come first and
    pairs that already hang together are skipped.
    """

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.parent: list[int] = []
        self.ids: list[int] = []
        self.texts: list[str] = []
        #: Pairs that no quick look settles: differing bits, and the two lines.
        self.open: list[tuple[int, int, int]] = []
        #: Group and kind of each line.
        self.of: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, p: int, q: int) -> None:
        self.parent[self.find(p)] = self.find(q)

    def add(self, group: int, kinds: list[int], ids: list[int], fp: list[int], fp2: list[int], sig: list[int], texts: list[str]) -> None:
        n, base = len(ids), len(self.ids)
        if n < 2:
            return
        self.of += [(group, k) for k in kinds]
        self.ids += ids
        self.texts += texts
        self.parent += range(base, base + n)
        marks = Marks(*(np.array(x, np.int64) for x in (fp, fp2, sig)))
        i, j = _pairs(n)
        bits = marks.apart(i, marks, j, self.similarity)
        some = np.flatnonzero(bits < 255)
        some = some[np.argsort(bits[some], kind="stable")]
        for d, p, q in zip(bits[some].tolist(), (base + i[some]).tolist(), (base + j[some]).tolist()):
            if self.find(p) != self.find(q):
                got = quickly_similar(self.texts[p], self.texts[q], self.similarity)
                if got:
                    self.link(p, q)
                elif got is None:
                    self.open.append((d, p, q))

    def settle(self) -> list[tuple[int, int, int, int]]:
        """(group, kind, line, smallest line that it hangs together with) of all groups so far, without lines that hang alone."""
        waiting = sorted(self.open)
        for at in range(0, len(waiting), 2048):
            some = [(p, q) for _, p, q in waiting[at : at + 2048] if self.find(p) != self.find(q)]
            for (p, q), ok in zip(some, all_similar([(self.texts[p], self.texts[q]) for p, q in some], self.similarity)):
                if ok and self.find(p) != self.find(q):
                    self.link(p, q)
        least: dict[int, int] = {}
        roots = [self.find(p) for p in range(len(self.ids))]
        size = Counter(roots)
        for r, x in zip(roots, self.ids):
            least[r] = min(least.get(r, x), x)
        out = [(*g, x, least[r]) for g, x, r in zip(self.of, self.ids, roots) if size[r] > 1]
        self.__init__(self.similarity)
        return out


@lru_cache(64)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _verified(similarity: float):
    """PARTS: what hangs together in each chunk of each group (rows sorted by group and chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in range(6)]
        groups, now, held = Groups(similarity), (0, 0), 0

        def settled() -> pa.RecordBatch:
            got = groups.settle()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in range(4)], names=["g", "kind", "node", "part"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(7)]
            for g, c, *row, text in zip(*columns, normalise(batch.column(7))):
                if (g, c) != now:
                    groups.add(now[0], *rows)
                    held += sum(map(len, rows[5]))
                    now, rows = (g, c), [[] for _ in range(6)]
                    if held > HELD:
                        yield settled()
                        held = 0
                for to, x in zip(rows, (*row, text)):
                    to.append(x)
        groups.add(now[0], *rows)
        yield settled()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, component): the parts of the chunks of each group that lines in several chunks tie together."""
    got = _gathered(batches, 2)
    if got is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*got)], names=["part", "component"])


def _tied(similarity: float):
    """(a, b): at each key the links among lines that do not hang together yet, as many as tie their parts together.

    What is not of the largest part of a key is held against all its lines, in
    pieces, closest pairs first; no pair leaves the task but as a link.  Of the
    keys that two lines share the first one looks at them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        keys, fp, fp2, sig, ids, part = (table.column(c).to_numpy() for c in range(6))
        own = table.column(6).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, BLOCKS)
        texts = table.column(7)
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        marks = Marks(fp, fp2, sig)
        parent: dict[int, int] = {}
        known: dict[int, str] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def settle(i: np.ndarray, j: np.ndarray, links: list[tuple[int, int]]) -> None:
            new = [x for x in np.unique(np.concatenate([i, j])).tolist() if x not in known]
            known.update(zip(new, normalise(texts.take(pa.array(new, pa.int64())).combine_chunks())))
            waiting = []
            for x, y in zip(i.tolist(), j.tolist()):
                p, q = find(int(part[x])), find(int(part[y]))
                if p != q:
                    ok = quickly_similar(known[x], known[y], similarity)
                    if ok:
                        parent[p] = q
                        links.append((x, y))
                    elif ok is None:
                        waiting.append((x, y))
            for at in range(0, len(waiting), 2048):
                some = [(x, y) for x, y in waiting[at : at + 2048] if find(int(part[x])) != find(int(part[y]))]
                for (x, y), ok in zip(some, all_similar([(known[x], known[y]) for x, y in some], similarity)):
                    p, q = find(int(part[x])), find(int(part[y]))
                    if ok and p != q:
                        parent[p] = q
                        links.append((x, y))

        for a, n in zip(starts.tolist(), np.diff(np.append(starts, len(keys))).tolist()):
            rows = order[a : a + n]
            where, count = np.unique(part[rows], return_inverse=True, return_counts=True)[1:]
            if len(count) < 2:
                continue
            outside = np.flatnonzero(where != np.argmax(count))
            step = max(1, PIECE // n)
            links: list[tuple[int, int]] = []
            for x in range(0, len(outside), step):
                i, j = marks.close(rows[outside[x : x + step]], rows)
                i = outside[x + i]
                some = (where[i] != where[j]) & ((where[j] == np.argmax(count)) | (i < j))
                i, j = rows[i[some]], rows[j[some]]
                bits = marks.apart(i, marks, j, similarity)
                hit = np.flatnonzero(bits < 255)
                i, j, bits = i[hit], j[hit], bits[hit]
                same = own[i] == own[j]
                mine = ~same.any(axis=1) | (own[i, same.argmax(axis=1)] == keys[rows[0]])
                i, j = i[mine], j[mine]
                closest = np.argsort(bits[mine], kind="stable")
                if len(closest):
                    settle(i[closest], j[closest], links)
            known.clear()
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(ids[[x for x, _ in links]]), pa.array(ids[[y for _, y in links]])], names=["a", "b"])

    return run


def verified_links(lined: DataFrame, keyed: DataFrame, similarity: float, work: Workspace, chunk: int = CHUNK) -> DataFrame:
    """(node, component) of the lines that the texts link.  lined: g (group of candidates), h1, fp, fp2, sig, text.  keyed: node, keys: the block keys of lines."""
    spark = lined.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["g", "c", "kind", "h1", "fp", "fp2", "sig", "text"]
    large = work.save(lined.groupBy("g").count().where(F.col("count") > chunk).select("g", F.ceil(F.col("count") / chunk).cast("int").alias("m")), "large")
    some = not is_empty(large)
    alone = lined.join(large, "g", "left_anti") if some else lined
    rows = alone.withColumns({"c": F.lit(0), "kind": F.lit(WHOLE)})
    if some:
        members = lined.join(large, "g").withColumns({"c": F.pmod("h1", "m").cast("int"), "kind": F.lit(MEMBER)})
        whole = F.struct("h1", "fp", "fp2", "sig", "text")
        leaders = members.groupBy("g", "m", F.pmod("h1", F.lit(LEADERS)).alias("l")).agg(F.min_by(whole, "h1").alias("w")).select("g", "m", "w.*")
        every = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
        led = leaders.select("g", every.alias("c"), F.lit(GUEST).alias("kind"), "m", "h1", "fp", "fp2", "sig", "text").where("c <> pmod(h1, m)")
        rows = rows.unionByName(members.drop("m")).unionByName(led.drop("m"))
    dealt = rows.select(*columns).repartition(parts, "g", "c").sortWithinPartitions("g", "c")
    found = work.save(dealt.mapInArrow(freed(_verified(similarity)), "g long, kind long, node long, part long"), "parts")
    # A group in one piece is settled by that; the chunks of a larger one meet at the lines that several of them hold.
    settled = found.where(F.col("kind") == WHOLE).select("node", F.col("part").alias("component"))
    if not some:
        return settled
    chunked = found.where(F.col("kind") != WHOLE)
    guests = chunked.where(F.col("kind") == GUEST)
    homes = chunked.where(F.col("kind") == MEMBER).join(guests.select("node").distinct(), "node", "left_semi")
    merged = guests.select("node", "part", "g").unionByName(homes.select("node", "part", "g")).repartition(parts, "g")
    merged = work.save(merged.mapInArrow(freed(_merged), "part long, component long"), "merged")
    same = chunked.join(merged, "part", "left").select("node", F.coalesce("component", "part").alias("component"))
    same = work.save(same.distinct(), "components")
    # What the chunks and leaders left apart meets again at the blocks.
    apart = members.select("g", "h1").join(same, members.h1 == same.node, "left").select("g", "h1", F.coalesce("component", "h1").alias("part"))
    split = apart.groupBy("g").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("g")
    apart = work.save(apart.join(split, "g", "left_semi").drop("g"), "apart", hashes=True)
    if is_empty(apart):
        return settled.unionByName(same)
    whole = apart.join(lined.select("h1", "fp", "fp2", "sig", "text"), "h1").join(keyed, F.col("h1") == F.col("node"))
    blocks = whole.select(F.explode(F.array_distinct("keys")).alias("k"), "fp", "fp2", "sig", "node", "part", "keys", "text")
    more = work.save(blocks.repartition(parts, "k").mapInArrow(freed(_tied(similarity)), "a long, b long"), "more")
    if is_empty(more):
        return settled.unionByName(same)
    # Only parts that are tied by that need a search; a line without a link so far is a part of its own.
    for end in "ab":
        more = more.join(apart.select(F.col("h1").alias(end), F.col("part").alias(f"part_{end}")), end)
    tied = work.save(connected_components(more, work, "part_a", "part_b").withColumnsRenamed({"node": "part", "component": "whole"}), "tied")
    moved = same.join(tied, same.component == tied.part, "left").select("node", F.coalesce("whole", "component").alias("component"))
    alone = tied.join(same, tied.part == same.node, "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("component"))
    return settled.unionByName(moved).unionByName(alone)


def doc_key(id_col: str, text_col: str) -> list[Column]:
    """What tells a document: a hash of its id and text, and its id (0 for none)."""
    return [F.xxhash64(id_col, text_col), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))]


def maybe(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """k1, k2, text of the texts that may be wanted (by k1), all wanted ones and few others: a filter of FILTER bits at most, 2 MB, tells."""
    place = F.pmod("k1", F.lit(FILTER))
    bits = wanted.groupBy(F.bitmap_bucket_number(place).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    at = F.bitmap_bit_position(place).cast("int")
    paged = texts.select("k1", "k2", "text", F.bitmap_bucket_number(place).alias("page"), at.alias("at"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return paged.join(F.broadcast(bits), "page").where(F.getbit(byte, F.pmod("at", F.lit(8))) == 1).select("k1", "k2", "text")


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int, similarity: float, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, gone): the numbers of the lines to drop, for each document that loses any; and (k1, k2) of documents that have several rows."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k1, k2 = doc_key(id_col, text_col)
    narrow = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    lines = work.save(narrow.mapInArrow(freed(_lines(min_words, parts)), NARROW), "lines", hashes=True)
    repeated = work.save(lines.where("line < 0").groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"), "repeated")
    # Copies meet as one row, so however often a line occurs, it is compared once.
    dealt = lines.where("bucket is not null").select("bucket", "packed").repartitionById(parts, "bucket")
    distinct = work.save(dealt.mapInArrow(freed(_distinct), DISTINCT), "distinct", hashes=True)
    lines = lines.where("line >= 0")
    keyed = distinct.where("size(keys) > 0").select("h1", "fp", "fp2", "sig", "keys")
    dealt = keyed.mapInArrow(freed(_blocks(parts)), PACKS).repartitionById(parts, "bucket")
    near = work.save(dealt.mapInArrow(freed(_near(similarity, HOT, TILE)), NEAR_ROWS), "near")
    links = near.where("tile is null").select("a", "b")
    if not is_empty(near.where("tile is not null")):
        tiles = near.where("tile is not null").select("tile", "side", "fp", "fp2", "sig", "a").repartition(parts, "tile")
        links = links.unionByName(work.save(tiles.mapInArrow(freed(_tiled(similarity)), "a long, b long"), "tiles"))
    copies = distinct.where("n > 1").select("h1", "h2", F.col("first").alias("keep"))
    if not is_empty(links):
        close = connected_components(links, work).withColumnRenamed("component", "g")
        members = work.save(distinct.join(close, distinct.h1 == close.node).select("g", *distinct.columns), "members", hashes=True)
        work.drop(near)
        # The text of each such line, from its first occurrence.
        wanted = F.collect_list(F.struct("g", "h1", "fp", "fp2", "sig", "first.line"))
        leads = members.where("lead")
        per_doc = work.save(leads.groupBy(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2")).agg(wanted.alias("wanted")), "wanted")
        text = maybe(narrow, per_doc).join(per_doc.hint("shuffle_hash"), ["k1", "k2"]).select(F.split("text", "\n").alias("parts"), "wanted")
        lined = text.select(F.explode("wanted").alias("w"), "parts").select("w.*", F.get("parts", F.col("w.line")).alias("text")).drop("line")
        # Only a document of several rows gives a line more than once.
        lined = work.save(lined if is_empty(repeated) else lined.dropDuplicates(["h1"]), "texts")
        same = verified_links(lined, leads.select(F.col("h1").alias("node"), "keys"), similarity, work)
        linked = members.join(same, members.h1 == same.node).select("h1", "h2", "component", "first")
        firsts = linked.groupBy("component").agg(F.min("first").alias("keep"))
        moved = work.save(linked.join(firsts, "component").select("h1", "h2", "keep"), "moved")
        copies = copies.join(moved, ["h1", "h2"], "left_anti").unionByName(moved)
    copies = copies.select("h1", "h2", *(F.col(f"keep.{c}").alias(f"keep_{c}") for c in ("k1", "k2", "line")))
    losing = lines.select("h1", "h2", "k1", "k2", "line").join(copies, ["h1", "h2"]).where("not (k1 = keep_k1 and k2 = keep_k2 and line = keep_line)")
    return work.save(losing.groupBy("k1", "k2").agg(F.collect_set("line").alias("gone")), "gone"), repeated


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the repeated lines cut from the text column, and n_lines, n_dropped (long; columns of these names are replaced).

    Null text stays null (no lines).  A document keeps its row even if no line
    is left.  Documents without an id come last in the order that chooses the
    occurrence to keep.  Of rows with equal id and text (rows without an id
    too) the first by a hash of all columns counts as the document; the others
    keep only lines without a letter or digit, as all else stands in it.
    Lines are told apart by 128-bit hashes, and links run between their first
    64 bits.
    """
    gone, repeated = dropped_lines(docs, id_col, text_col, min_words, similarity, Workspace(docs.sparkSession, "lines"))
    n1, n2, salt, first, copy, lost = (unused_name(docs, x) for x in ("line_k1", "line_k2", "line_salt", "line_first", "line_copy", "lines_gone"))
    k1, k2 = doc_key(id_col, text_col)
    gone = gone.select(F.col("k1").alias(n1), F.col("k2").alias(n2), F.col("gone").alias(lost))
    keyed = docs.withColumns({n1: k1, n2: k2})
    joined = keyed.join(gone.hint("shuffle_hash"), [n1, n2], "left").withColumn(copy, F.lit(False))
    if not is_empty(repeated):
        twice = repeated.select(F.col("k1").alias(n1), F.col("k2").alias(n2))
        again = keyed.join(twice, [n1, n2], "left_semi").withColumn(salt, F.pmod(F.xxhash64(*docs.columns), F.lit(64)))
        firsts = again.groupBy(n1, n2).agg(F.min(salt).alias(first))
        again = again.withColumn(copy, F.row_number().over(Window.partitionBy(n1, n2, salt).orderBy(n1))).join(firsts, [n1, n2])
        again = again.withColumn(copy, (F.col(salt) != F.col(first)) | (F.col(copy) > 1)).join(gone, [n1, n2], "left")
        joined = joined.join(twice, [n1, n2], "left_anti").unionByName(again.drop(salt, first))

    def left_of(parts: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost))
        return F.array_join(F.transform(numbers, lambda i: F.get(parts, i)), "\n")

    # The outer transform binds the lines once; inside a lambda they would be split again for each line.
    rest = F.get(F.transform(F.array(F.split(F.col(text_col), "\n")), left_of), 0)
    worded = F.filter(F.split(F.col(text_col), "\n"), lambda x: x.rlike(WORDED))
    bare = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x: ~x.rlike(WORDED)), "\n")
    text = F.when(F.col(copy), bare).when(F.col(lost).isNull(), F.col(text_col)).otherwise(rest)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_dropped = F.coalesce(F.when(F.col(copy), F.size(worded)).otherwise(F.size(F.col(lost))), F.lit(0)).cast("long")
    others = [F.col(c) if c != text_col else text.alias(text_col) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*others, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
