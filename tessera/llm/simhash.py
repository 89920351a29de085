"""SimHash near-dedup with vantage-point trees.

Two 64-bit fingerprints within 3 bits differ by at most 1 bit in one of their 32-bit halves. So there are two forests,
one per half, each a vantage-point tree over Hamming distance with link radius 1: a node holds a vantage v and a radius
m, points with d(x, v) <= m go inside, points with d(x, v) > m outside, and by the triangle inequality only the outside
points with d(x, v) <= m + 1 can have a partner inside; these overlap the boundary and go to both sides. So each pair
meets in some leaf. Leaves are shards: Spark deals the distinct fingerprints to them, and a task searches its shard
with a local tree, verifies pairs on all 64 bits, and emits one edge per fingerprint to the least member of its local
component, not all pairs. Trees are fitted on a bounded sample, which moves the borders but never the result; leaves
found too full by an exact count are split further. Components then join the shards' stars.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, documents, texts

U64 = np.uint64
SEED = 42
LINK_BITS = 3
#: Fingerprints that a shard should hold, and that the driver fits a tree on (by a hash, at most about twice as many).
SHARD_ROWS = 512
SAMPLE_ROWS = 16_384
MAX_LEAVES = 65_536
SHINGLE = 3


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64-bit SimHash of the size-word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())])
    n, votes = len(starts), np.zeros(64, np.int64)
    cells = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for i in range(0, n, 65_536):
        votes += np.unpackbits(cells[i : i + 65_536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, key) of each row, fp and the columns of key as signed longs."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64), **{k: b[k] for k in key}})

    return texts(docs, key=key).mapInPandas(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *key)))


def bits(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a).astype(np.int16)


class Tree:
    """A vantage-point tree over 32-bit values: inner nodes (vantage, radius, inside, outside), or a leaf's number."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.leaves = 0
        self.root = self._grow(sample, depth)

    def _leaf(self):
        self.leaves += 1
        return self.leaves - 1

    def _grow(self, points: np.ndarray, depth: int):
        best = split(points) if depth > 0 else None
        if best is None:
            return self._leaf()
        v, m = best
        d = bits(points ^ v)
        return [v, m, self._grow(points[d <= m + 1], depth - 1), self._grow(points[d > m], depth - 1)]

    def deepen(self, node, samples: dict[int, np.ndarray], depth: int):
        """Split the leaves in samples further; the other leaves keep their numbers."""
        if isinstance(node, list):
            node[2], node[3] = self.deepen(node[2], samples, depth), self.deepen(node[3], samples, depth)
            return node
        return self._grow(samples[node], depth) if node in samples else node

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position, leaf); a point that overlaps a boundary has several leaves."""
        at, leaf, todo = [], [], [(self.root, np.arange(len(points)))]
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            if not isinstance(node, list):
                at.append(idx)
                leaf.append(np.full(len(idx), node))
                continue
            d = bits(points[idx] ^ node[0])
            todo += [(node[2], idx[d <= node[1] + 1]), (node[3], idx[d > node[1]])]
        return (np.concatenate(at), np.concatenate(leaf)) if at else (np.zeros(0, int), np.zeros(0, int))


def split(points: np.ndarray, tries: int = 8):
    """(vantage, radius) with the smallest larger side, or None where no split makes both sides smaller."""
    n, best = len(points), None
    if n < 8:
        return None
    for v in points[np.linspace(0, n - 1, tries).astype(int)]:
        c = np.cumsum(np.bincount(bits(points ^ v), minlength=34))
        larger = np.maximum(c[1:33], n - c[:32])  # inside with its overlap, and outside
        m = int(larger.argmin())
        if best is None or larger[m] < best[0]:
            best = (larger[m], v, m)
    return best[1:] if best[0] <= 0.9 * n else None


def _close(own: np.ndarray, low: bool):
    """Pairs of positions that may be within LINK_BITS, for fingerprints whose one half differs by 1 bit at most.

    Then the other half differs by 3 bits at most, so one of its 16-bit quarters by 1 at most: pairs meet at equal values
    or at one flipped bit. Fingerprints are distinct, so a half and a quarter that all share leave 65,536 at most.
    """
    other = own >> U64(32) if low else own
    for shift in (0, 16):
        q = ((other >> U64(shift)) & U64(0xFFFF)).astype(np.int64)
        order = np.argsort(q, kind="stable")
        ordered = q[order]
        for flip in [0, *(1 << k for k in range(16))]:
            first, last = np.searchsorted(ordered, q ^ flip), np.searchsorted(ordered, q ^ flip, "right")
            many = np.cumsum(last - first)
            at = 0
            while at < len(q):  # about 4,000,000 pairs at a time, all of one row at least
                end = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + 4_000_000)))
                n = last[at:end] - first[at:end]
                i = np.repeat(np.arange(at, end), n)
                j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:end], n)]
                ok = (i < j) & (np.bitwise_count(own[i] ^ own[j]) <= LINK_BITS)
                yield i[ok], j[ok]
                at = end


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position of each position's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for side in (i, j, label[i], label[j]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def local_components(fp: np.ndarray, low: bool, leaf_rows: int = 256, block_rows: int = 4_096) -> np.ndarray:
    """For each of the distinct fingerprints, the position of the least one in its component within the shard.

    A node that a tree over its half cannot split, as many fingerprints share that half, is searched by the other half.
    """
    half = (fp & U64(0xFFFFFFFF) if low else fp >> U64(32)).astype(np.uint32)
    todo, left, right = [np.arange(len(fp))], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while todo:
        idx = todo.pop()
        best = split(half[idx]) if len(idx) > leaf_rows else None
        if best is not None:
            d = bits(half[idx] ^ best[0])
            todo += [idx[d <= best[1] + 1], idx[d > best[1]]]
            continue
        own = fp[idx]
        if len(idx) > block_rows:
            pairs = _close(own, low)
        else:
            step = max(1, 4_000_000 // max(1, len(idx)))
            pairs = ((r + i, c) for i in range(0, len(idx), step) for r, c in [np.nonzero(np.bitwise_count(own[i : i + step, None] ^ own[None, :]) <= LINK_BITS)])
        for i, j in pairs:
            left.append(idx[i[i < j]])
            right.append(idx[j[i < j]])
    return _joined(len(fp), np.concatenate(left), np.concatenate(right))


def shards(batches, key: str):
    """Runs of equal key in batches that come sorted by it."""
    held: list[pd.DataFrame] = []
    for b in batches:
        k = b[key].to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        for part in np.split(np.arange(len(k)), cuts):
            if not len(part):
                continue
            if held and held[-1][key].iat[0] != k[part[0]]:
                yield pd.concat(held)
                held = []
            held.append(b.iloc[part])
    if held:
        yield pd.concat(held)


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = fp.view(np.uint64)
    return (u >> np.uint64(32)).astype(np.uint32), (u & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _routed(points: DataFrame, trees) -> DataFrame:
    held = points.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in batches:
            fp = b["fp"].to_numpy()
            for side, half in enumerate(_halves(fp)):
                at, leaf = held.value[side].route(half)
                yield pd.DataFrame({"shard": leaf * 2 + side, "fp": fp[at]})

    return points.mapInPandas(run, "shard long, fp long")


def links(points: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints within LINK_BITS of each other; points: distinct fp."""
    n = points.count()
    sample = np.array([r[0] for r in points.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // SAMPLE_ROWS))) == 0).collect()], np.int64)
    depth = max(0, min(int(math.log2(MAX_LEAVES)), math.ceil(math.log(max(1, n / shard_rows)) / 0.57)))
    trees = [Tree(half, depth) for half in _halves(sample)] if len(sample) else [Tree(np.zeros(0, np.uint32), 0)] * 2
    for _ in range(4):
        if depth == 0:
            break
        limit = 8 * shard_rows
        full = [r[0] for r in _routed(points, trees).groupBy("shard").count().where(F.col("count") > limit).orderBy(F.desc("count")).limit(512).collect()]
        if not full:
            break
        few = _routed(points, trees).where(F.col("shard").isin(full)).where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // SAMPLE_ROWS))) == 0)
        got = few.limit(4 * SAMPLE_ROWS).toPandas()
        before = [t.leaves for t in trees]
        for side, tree in enumerate(trees):
            own = {s // 2: _halves(g["fp"].to_numpy())[side] for s, g in got.groupby("shard") if s % 2 == side}
            tree.root = tree.deepen(tree.root, own, 3)
        if before == [t.leaves for t in trees] or max(t.leaves for t in trees) > MAX_LEAVES:
            break

    def search(batches):
        for part in shards(batches, "shard"):
            fp = np.unique(part["fp"].to_numpy().view(np.uint64))
            label = local_components(fp, bool(part["shard"].iat[0] % 2))
            at = np.flatnonzero(label != np.arange(len(fp)))
            if len(at):
                yield pd.DataFrame({"a": fp[at].view(np.int64), "b": fp[label[at]].view(np.int64)})

    return _routed(points, trees).repartition("shard").sortWithinPartitions("shard").mapInPandas(search, "a long, b long")


def simhash_components(docs: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other; repeated rows get equal fingerprints and one
    component; an empty table gives no rows. With a key (long columns of docs), rows also have it and kept, which holds
    for the smallest doc_id, then key, of each component, whatever other components have the same doc_id. Work is on distinct fingerprints, so copies cost one row each.
    """
    prints = cut(fingerprints(docs, key))
    order = F.struct("doc_id", *key) if key else F.col("doc_id")
    groups = cut(prints.groupBy("fp").agg(F.min(order).alias("first")))
    linked = components(links(groups.select("fp")))
    rooted = groups.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut(rooted.join(least, "root").select("fp", "component_id"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    if not key:
        return prints.join(named, "fp").select("doc_id", shown, "component_id")
    return prints.join(named, "fp").select("doc_id", *key, shown, F.col("component_id.doc_id").alias("component_id"), (order == F.col("component_id")).alias("kept"))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
