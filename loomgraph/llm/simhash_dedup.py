"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

near_duplicates links documents by their fingerprints alone.  similar_documents
links those with a Jaccard similarity of 0.8 of their sets of five-word
shingles.  Fingerprints of such pairs can lie many bits apart, so no radius
finds all of them: SimHash gives the first candidates, an exact prefix join the
rest, and each link is confirmed by the sets.

Method and deviation: the trees are per shard as asked, a shard being a
pigeonhole bucket; a tree over all documents would grow with the corpus, so
trees are not broadcast but meet their searchers by one shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, byte_batches, connected_components, freed, is_empty, unused_name
from .hamming import hamming_links
from .line_dedup import P, mix, rolled, simhash

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Of the confirmed form: words of a shingle and least Jaccard similarity.
WORDS, SIMILARITY = 5, 0.8
#: Sets at one token that are all paired, leaders of a larger number, and pairs that are looked at side by side.
MOST, LEADERS, PIECE = 16, 4, 1 << 20
#: Texts of the sample that tells common tokens, and how many of those are put last.
SAMPLE, COMMON = 20_000, 1 << 17
#: Bytes of text that a worker turns into sets at once.
SLICE = 1 << 20
#: Shingle hashes whose bits are counted at once.
STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text; bytes.lower() and bytes.split() touch ASCII letters and white space only, as wanted."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    stop = ends[shingle - 1 :].tolist()
    start = [0, *(ends[: n - shingle] + 1).tolist()]
    total = np.zeros(64, np.int64)
    for at in range(0, len(stop), STEP):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(start[at : at + STEP], stop[at : at + STEP])], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * total > len(stop)).tolist()
    return sum(1 << b for b in set_bits)


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        for batch in batches:
            text = batch.column(1)
            got = [0 if not x.is_valid else fingerprint(x.as_buffer().to_pybytes(), shingle, seed) for x in text]
            signed = np.array(got, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], names=["id", "fp"])

    return run


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long.

    Words are runs of anything but ASCII white space, lower-cased in A-Z; a
    text of fewer words than the shingle is one shingle, one of none has
    fingerprint 0.  Null text counts as empty.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(_fingerprints(shingle, seed), "id long, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp, component): one row a document; component is the smallest id reachable over links.

    Two fingerprints at ``radius`` differing bits or fewer are linked.  Equal
    fingerprints meet as one point, so copies are never paired.  A row without
    an id is kept and takes the component of an equal fingerprint that has an
    id, else null; it links nothing itself.  Repeated rows stay repeated.
    """
    work = Workspace(docs.sparkSession, "simhash")
    marked = work.save(simhash_fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    points = work.save(marked.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "points")
    links = work.save(hamming_links(points, "fp", "rep", radius, points.count()), "pairs")
    components = connected_components(links, work)
    classes = points.join(components, points.rep == components.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return marked.join(classes, "fp", "left").select("id", "fp", "component")


def shingle_sets(texts: pa.Array, common: np.ndarray, shingle: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, sizes, fingerprints): the hashes of the different shingles of each text, run after run, each run sorted, with the size and the SimHash of each.

    Words are in lower case, between ASCII white space; a text of fewer words
    than the shingle is one shingle, one of none has none.  A token is 63 bits
    of a hash, and the top bit for those that ``common`` (sorted) holds, which
    puts them last.
    """
    low = pc.utf8_lower(texts)
    offsets = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    raw = np.frombuffer(low.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    sizes, fps = np.zeros(len(low), np.int64), np.zeros(len(low), np.uint64)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    before, after = np.concatenate([[True], blank])[:-1], np.concatenate([blank, [True]])[1:]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~blank & before)
    if not len(starts):
        return np.zeros(0, np.uint64), sizes, fps
    lengths = np.flatnonzero(~blank & after) + 1 - starts
    doc = np.searchsorted(offsets[:-1], starts, "right") - 1
    words = mix(rolled(raw[~blank].astype(np.uint64) + np.uint64(1), np.cumsum(lengths) - lengths, lengths), 1)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(first, len(words)))
    at, ends = np.arange(len(words)), np.repeat(first + count, count)
    hashes = words.copy()
    with np.errstate(over="ignore"):
        for k in range(1, shingle):
            later = np.concatenate([words[k:], np.zeros(min(k, len(words)), np.uint64)])
            hashes = hashes * np.uint64(P) + np.where(at + k < ends, later, np.uint64(0))
    whole = (at + shingle <= ends) | (at == np.repeat(first, count))
    doc, tokens = doc[whole], mix(hashes[whole], 2) >> np.uint64(1)
    if len(common):
        tokens |= (common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens).astype(np.uint64) << np.uint64(63)
    order = np.lexsort((tokens, doc))
    doc, tokens = doc[order], tokens[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tokens[1:] != tokens[:-1])])
    doc, tokens = doc[new], tokens[new]
    sizes = np.bincount(doc, minlength=len(low))
    some = np.flatnonzero(sizes)
    fps[some] = simhash(mix(tokens << np.uint64(1), 3), np.cumsum(sizes[some]) - sizes[some], sizes[some])
    return tokens, sizes, fps


def keys_of(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell a set of shingles, whichever of them are common; 0 for none."""
    out = np.zeros((2, len(sizes)), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.cumsum(sizes[some]) - sizes[some]
        with np.errstate(over="ignore"):
            for k in range(2):
                out[k, some] = mix(np.add.reduceat(mix(tokens << np.uint64(1), 4 + k), starts), 6)
    return out[0].view(np.int64), out[1].view(np.int64)


def _slices(batches, text: int):
    for batch in batches:
        texts = batch.column(text).fill_null("")
        for a, b in byte_batches([range(n) for n in pc.binary_length(texts).to_numpy(zero_copy_only=False).tolist()], SLICE):
            yield batch.slice(a, b - a), texts.slice(a, b - a)


def _tokens(batches):
    """All tokens of texts."""
    for _, texts in _slices(batches, 0):
        yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(texts, np.zeros(0, np.uint64))[0].view(np.int64))], names=["token"])


def _prefixes(common: np.ndarray, similarity: float):
    """Size, keys and fingerprint of each text's set, and the prefix that a similar set must share a token of."""

    def run(batches):
        for batch, texts in _slices(batches, 1):
            tokens, n, fps = shingle_sets(texts, common)
            least = np.ceil(similarity * n - 1e-9).astype(np.int64)
            length = np.where(n > 0, n - least + 1, 0)
            at = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(tokens[at < np.repeat(length, n)].view(np.int64)))
            c, c2 = keys_of(tokens, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, c, c2, fps.view(np.int64))), lists], names=["id", "n", "c", "c2", "fp", "prefix"])

    return run


def _sets(batches):
    """The whole set of each text, by its key."""
    for _, texts in _slices(batches, 1):
        tokens, n, _ = shingle_sets(texts, np.zeros(0, np.uint64))
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys_of(tokens, n)[0]), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.view(np.int64)))], names=["c", "s"])


class Meeting:
    """Sets that share tokens: their keys, sizes, and places of the token, sorted by token and key."""

    def __init__(self, rows: list[np.ndarray], similarity: float):
        order = np.lexsort((rows[1], rows[0]))
        #: part: what a set hangs together with already.
        self.token, self.c, self.n, self.at, self.part = (x[order] for x in rows)
        self.share = similarity / (1 + similarity)
        self.starts = np.flatnonzero(np.concatenate([[True], self.token[1:] != self.token[:-1]]))
        self.sizes = np.diff(np.append(self.starts, len(self.token)))

    def fits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sizes and places leave room for so many tokens in common, if none before was."""
        least = np.ceil(self.share * (self.n[i] + self.n[j]) - 1e-6)
        return np.minimum(self.n[i] - self.at[i], self.n[j] - self.at[j]) >= least

    def open(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that do not hang together yet and may be similar."""
        some = self.part[i] != self.part[j]
        i, j = i[some], j[some]
        some = self.fits(i, j)
        return i[some], j[some]

    def few(self, most: int):
        """The pairs of runs of up to ``most`` rows, in pieces."""
        rows = np.flatnonzero(np.repeat((self.sizes > 1) & (self.sizes <= most), self.sizes))
        for a in range(0, len(rows), PIECE // most):
            at, left, right = rows[a : a + PIECE // most], [], []
            for shift in range(1, most):
                at = at[at + shift < len(self.token)]
                at = at[self.token[at] == self.token[at + shift]]
                if not len(at):
                    break
                i, j = self.open(at, at + shift)
                left.append(i)
                right.append(j)
            if left:
                yield np.concatenate(left), np.concatenate(right)

    def led(self, most: int):
        """Of each larger run the pairs of each row with a few leaders, the smallest keys."""
        large = self.sizes > most
        for a, n in zip(self.starts[large].tolist(), self.sizes[large].tolist()):
            for k in range(LEADERS):
                j = np.arange(a + k + 1, a + n)
                yield self.open(np.full(len(j), a + k), j)

    def apart(self):
        """The pairs of each run that do not hang together yet, in pieces: rows outside the largest part against all rows."""
        for a, n in zip(self.starts.tolist(), self.sizes.tolist()):
            parts, where, count = np.unique(self.part[a : a + n], return_inverse=True, return_counts=True)
            outside = np.flatnonzero(where != np.argmax(count))
            step = max(1, PIECE // n)
            for x in range(0, len(outside), step):
                some = outside[x : x + step]
                yield self.open(a + np.repeat(some, n), a + np.tile(np.arange(n), len(some)))


MET = "a long, b long, token long, n long, at int"


def _pairs(c: np.ndarray, pieces, rows: int = PIECE):
    """Batches of different pairs of keys, the smaller first; small pieces go together."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        i, j = (np.concatenate([h[k] for h in held]) for k in range(2))
        a, b = np.minimum(c[i], c[j]), np.maximum(c[i], c[j])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    for piece in pieces:
        if len(piece[0]):
            held.append(piece)
            size += len(piece[0])
            if size >= rows:
                yield batch()
                held, size = [], 0
    if held:
        yield batch()


def _gathered(batches) -> list[np.ndarray] | None:
    got = [[np.asarray(x) for x in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*got)] if got else None


def _met(similarity: float, most: int):
    """Candidate pairs (a, b) of the sets that share a token; and as (b null) the rows of tokens with over ``most``, of which only the leaders' pairs are among them.  A task holds 40 bytes a row of its share."""

    def run(batches):
        rows = _gathered(batches)
        if rows is None:
            return
        m = Meeting(rows, similarity)
        names = [f.split(" ")[0] for f in MET.split(", ")]
        for pieces in (m.few(most), m.led(most)):
            for got in _pairs(m.c, pieces):
                none = pa.nulls(got.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*got.columns, none, none, none.cast(pa.int32())], names=names)
        hot = np.repeat(m.sizes > most, m.sizes)
        yield pa.RecordBatch.from_arrays([pa.array(m.c[hot]), pa.nulls(int(hot.sum()), pa.int64()), *(pa.array(x[hot]) for x in (m.token, m.n, m.at))], names=names)

    return run


def _left(similarity: float):
    """Candidate pairs (a, b) of the sets at each token that do not hang together."""

    def run(batches):
        rows = _gathered(batches)
        if rows is not None:
            m = Meeting(rows, similarity)
            yield from _pairs(m.c, m.apart())

    return run


def common_tokens(texts: DataFrame, rows: int, work: Workspace, most: int = COMMON) -> np.ndarray:
    """The most frequent tokens of a sample, sorted (about ``most``).  Which they are changes cost and never the result.

    No more than those reach the driver, however many tokens the sample has and
    however many tasks hold them: a limit would take so many from each task.
    """
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // SAMPLE))) == 0).select("text")
    counted = some.mapInArrow(freed(_tokens), "token long").groupBy("token").count().where("count > 2")
    counted = work.save(counted, "tokens", hashes=True)
    room, wanted = most, F.lit(True)
    for r in counted.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).collect():
        if r.n > room:
            # Tokens are 63 bits of a hash, so a range of them is a share of this count.
            wanted = (F.col("count") > r["count"]) | ((F.col("count") == r["count"]) & (F.col("token") < (room << 63) // r.n))
            break
        room -= r.n
    got = counted.where(wanted).select("token").collect()
    work.drop(counted)
    return np.sort(np.array([r.token for r in got], np.int64).view(np.uint64))


def similar_documents(docs: DataFrame, id_col: str, text_col: str, work: Workspace, similarity: float = SIMILARITY, among: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """(a, b): links between ids whose components are those of all pairs with a Jaccard similarity of ``similarity`` of their shingle sets.

    Sets with equal keys meet as one.  Candidates are the links of the SimHashes,
    and the pairs that share a token of their prefixes: of two similar sets of n
    and m tokens in one order, the first n - ceil(similarity n) + 1 and
    m - ceil(similarity m) + 1 have one in common.  Sets confirm each candidate.
    Where over ``most`` sets share a token, each is held against a few leaders
    first, and then against all that it does not hang together with by then.
    Rows without an id link nothing.  Of rows that share an id each text counts.
    ``among``: ids (column id); other documents are left out.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    common = common_tokens(narrow, narrow.count(), work)
    marked = narrow.mapInArrow(freed(_prefixes(common, similarity)), "id long, n long, c long, c2 long, fp long, prefix array<long>")
    marked = work.save(marked if among is None else marked.join(among.select("id").hint("merge"), "id", "left_semi"), "marked", hashes=True)
    points = work.save(marked.groupBy("c", "c2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix")), "points", hashes=True)
    reps = work.save(points.select("c", "rep"), "reps")
    copies = marked.select("id", "c", "c2").join(points.select("c", "c2", "rep"), ["c", "c2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    copies = work.save(copies, "copies")
    work.drop(marked)
    filled = points.where("n > 0")
    near = work.save(filled.groupBy("fp").agg(F.min("c").alias("c")), "fingerprints")
    close = hamming_links(near, "fp", "c", RADIUS, near.count())
    equal = filled.select("fp", "c").join(near.select("fp", F.col("c").alias("b")), "fp").where("c <> b").select(F.col("c").alias("a"), "b")
    links = confirmed(close.unionByName(equal), narrow, reps, similarity, work)

    def tied(rows: DataFrame) -> DataFrame:
        of = connected_components(links, work)
        return rows.join(of, rows.c == of.node, "left").withColumn("part", F.coalesce("component", "c")).drop("node", "component")

    spread = tied(filled.select("c", "n", "prefix")).select(F.posexplode("prefix").alias("at", "token"), "c", "n", "part").select("token", "c", "n", "at", "part")
    met = work.save(spread.repartition(parts, "token").mapInArrow(freed(_met(similarity, most)), MET), "met", hashes=True)
    work.drop(points)
    links = links.unionByName(confirmed(met.where("b is not null").select("a", "b"), narrow, reps, similarity, work))
    hot = met.where("b is null").select("token", F.col("a").alias("c"), "n", "at")
    if not is_empty(hot):
        rest = work.save(tied(hot).repartition(parts, "token").mapInArrow(freed(_left(similarity)), "a long, b long"), "rest")
        links = links.unionByName(confirmed(rest, narrow, reps, similarity, work))
    work.drop(met)
    ends = links.join(reps.withColumnsRenamed({"c": "a", "rep": "x"}), "a").join(reps.withColumnsRenamed({"c": "b", "rep": "y"}), "b")
    return work.save(copies.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b")), "links")


def confirmed(found: DataFrame, texts: DataFrame, reps: DataFrame, similarity: float, work: Workspace) -> DataFrame:
    """Those of the pairs of keys whose sets are similar."""
    pairs = work.save(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates", hashes=True)
    if is_empty(pairs):
        return pairs
    ends = work.save(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "ends", hashes=True)
    some = texts.join(reps.join(ends, "c").select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi")
    sets = work.save(some.mapInArrow(freed(_sets), "c long, s array<long>").join(ends, "c", "left_semi").dropDuplicates(["c"]), "sets", hashes=True)
    left, right = (sets.withColumnsRenamed({"c": c, "s": f"s{c}"}) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    out = work.save(both.where(F.col("n") >= F.lit(similarity) * (F.size("sa") + F.size("sb") - F.col("n"))).select("a", "b"), "sure")
    work.drop(sets)
    work.drop(pairs)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", earlier: DataFrame | None = None) -> DataFrame:
    """The documents whose id is the smallest of their group of similar documents; columns unchanged.

    ``earlier``: texts that the same documents had before (same column names);
    documents that were similar then are one group too.  Where an id repeats,
    its smallest row (by all columns) stays.  Documents without an id are kept,
    since no id names them as a copy.  Texts without words are copies of each
    other.
    """
    work = Workspace(docs.sparkSession, "keep-one")
    links = similar_documents(docs, id_col, text_col, work)
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"))
    ids = work.save(ids, "ids")
    if earlier is not None:
        links = links.unionByName(similar_documents(earlier, id_col, text_col, work, among=ids))
    components = connected_components(links, work)
    key = unused_name(docs, "gone_id")
    gone = components.where("node <> component").select(F.col("node").alias(key))
    kept = docs.join(gone.hint("merge"), F.col(id_col).cast("long") == F.col(key), "left_anti")
    again = ids.where("n > 1").select(F.col("id").alias(key))
    if is_empty(again):
        return kept
    same = F.col(id_col).cast("long") == F.col(key)
    first = kept.join(again, same, "left_semi").withColumn(key, F.row_number().over(Window.partitionBy(id_col).orderBy(*docs.columns)))
    return kept.join(again, same, "left_anti").unionByName(first.where(F.col(key) == 1).drop(key))
