"""Links between 64-bit fingerprints within a Hamming radius, without all-pairs work.

Pigeonhole: cut the 64 bits into ``blocks`` pieces; two fingerprints at distance
``radius`` or less agree on at least ``blocks - radius`` whole pieces.  Every
choice of ``blocks - radius`` pieces is one table, keyed by the bits chosen, so
each wanted pair meets in at least one bucket.  More pieces make longer keys
and more tables: ``plan`` picks the cheapest by the number of fingerprints,
which changes cost and never the result.

Within a bucket the fingerprints form a BK-tree: the children of a node are
keyed by their integer Hamming distance to it, and a search with radius r at
distance d from a node follows only the edges d-r .. d+r.  A subtree that
already lies in the searcher's own component as a whole is skipped, so a dense
bucket costs about one step a member and yields a spanning forest instead of
all pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64


def plan(rows: int, radius: int, scale: float = 1.0) -> list[list[tuple[int, int]]]:
    """Tables of (shift, width) pieces.  Cost of a choice: a row a table, and the rows it meets."""
    best = None
    for chosen in range(1, 5):
        blocks = radius + chosen
        tables = comb(blocks, chosen)
        keys = 2.0 ** (BITS * chosen / blocks)
        cost = tables * rows * (1.0 + 0.02 * scale * rows / keys)
        if best is None or cost < best[0]:
            best = (cost, blocks, chosen)
    _, blocks, chosen = best
    cuts = [round(BITS * i / blocks) for i in range(blocks + 1)]
    pieces = [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]
    return [list(c) for c in combinations(pieces, chosen)]


def block_keys(fp: Column, tables: list[list[tuple[int, int]]]) -> Column:
    """Array of bucket keys: a hash of the table's number and its bits (a clash only adds a useless meeting)."""
    keys = []
    for t, pieces in enumerate(tables):
        parts = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else -1)) for lo, width in pieces]
        keys.append(F.xxhash64(F.lit(t), *parts))
    return F.array(*keys)


class BKTree:
    """A BK-tree over ints with a union-find over its members; ``linked`` gets a spanning forest of the links."""

    __slots__ = ("values", "children", "parent", "uniform", "radius")

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int] | None] = []
        self.parent: list[int] = []
        #: uniform[n]: the whole subtree under n lies in n's component.
        self.uniform: list[bool] = []

    def find(self, n: int) -> int:
        parent = self.parent
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    def add(self, value: int, check=None) -> list[tuple[int, int]]:
        """Insert a value; returns the links that joined two components, as positions.

        ``check(i, j)`` may veto a link after the distance test.
        """
        values, children, parent, uniform, radius = self.values, self.children, self.parent, self.uniform, self.radius
        new = len(values)
        values.append(value)
        children.append(None)
        parent.append(new)
        uniform.append(True)
        if new == 0:
            return []
        out: list[tuple[int, int]] = []
        mine = new
        stack = [0]
        while stack:
            n = stack.pop()
            root = self.find(n)
            if root == mine and uniform[n]:
                continue
            d = (values[n] ^ value).bit_count()
            if d <= radius and root != mine and (check is None or check(n, new)):
                low, high = (root, mine) if root < mine else (mine, root)
                parent[high] = low
                mine = low
                out.append((n, new))
            kids = children[n]
            if kids:
                if len(kids) <= 2 * radius + 1:
                    stack += [m for e, m in kids.items() if d - radius <= e <= d + radius]
                else:
                    stack += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        # Insert below the root along exact distances; refresh the flags on the path.
        n, path = 0, []
        while True:
            path.append(n)
            d = (values[n] ^ value).bit_count()
            kids = children[n]
            if kids is None:
                kids = children[n] = {}
            if d not in kids:
                kids[d] = new
                break
            n = kids[d]
        for n in reversed(path):
            root = self.find(n)
            uniform[n] = all(uniform[m] and self.find(m) == root for m in children[n].values())
        return out


def _bucket_links(radius: int):
    def run(batches):
        key = None
        ids: list[int] = []
        tree = BKTree(radius)
        left: list[int] = []
        right: list[int] = []
        for batch in batches:
            for k, fp, rep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    key, ids, tree = k, [], BKTree(radius)
                ids.append(rep)
                for i, j in tree.add(fp & 0xFFFFFFFFFFFFFFFF):
                    left.append(ids[i])
                    right.append(ids[j])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []

    return run


def hamming_links(points: DataFrame, fp: str, rep: str, radius: int, rows: int) -> DataFrame:
    """(a, b): a spanning forest, per bucket, of the links between distinct fingerprints.

    ``points`` holds each fingerprint once, with the id that stands for it.
    """
    tables = plan(rows, radius)
    keyed = points.select(F.explode(block_keys(F.col(fp), tables)).alias("k"), F.col(fp).alias("fp"), F.col(rep).alias("rep"))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(max(n, 1), "k").sortWithinPartitions("k", "fp")
    return dealt.mapInArrow(_bucket_links(radius), "a long, b long")
