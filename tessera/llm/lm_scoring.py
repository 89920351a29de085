"""LM scoring by masked pseudo-likelihood.

A bidirectional window network, written and trained in numpy, predicts every word from the two words on each side, on
two levels. The most frequent words are classes of their own, all others are hashed into HASHED more classes; the first
softmax gives the class. Inside a hashed class, a second softmax over its MEMBERS most frequent words and one entry for
its other words gives the word; the other words share that entry by their corpus counts. A document's score is the sum
of log P(class | both sides) + log P(member | class, both sides) + log P(word | class, other).

Every word has its own corpus count, however rare. Words are 64-bit hashes; the counts of all documents stay a
distributed table. The VOCABULARY most frequent words, a bounded table, go to the tasks; of all others, each document
gives its words to a join with the counts, and words that occur once need no partner there.

Training covers every document once: in round r, each task takes the documents of its partition with hash r, runs
minibatch Adam from the shared weights, and returns its weights; their mean, weighted by words, starts the next round.
Weights are added up by a fixed number of tasks before the driver sees them, so what is collected is bounded, while
what is counted and trained on grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, texts
from .words import U, Words, chunks, hash_of

OWN, HASHED = 32, 32
CLASSES = OWN + HASHED
PAD = CLASSES
#: Words of a hashed class that the network tells apart; one more entry stands for its other words.
MEMBERS = 95
REST = MEMBERS
WIDTH = 24
SIDES = (-2, -1, 1, 2)
#: Words whose counts go to the tasks, 16 bytes each and a table of 4 bytes by 4.
VOCABULARY = 1 << 17
NEVER = -30.0
ROUNDS = 3
BATCH = 2_048
#: Words that are scored at a time, so that their logits stay in the processor's cache.
BLOCK = 2_048
RATE = 0.01
CHUNK_CHARS = 1_000_000
#: Tasks that add up the weights; the driver gets a row of about 0.7 MB from each.
SLOTS = 16
SHAPES = [(len(SIDES), CLASSES + 1, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,), (HASHED, MEMBERS + 1, WIDTH), (HASHED, MEMBERS + 1)]


def slots(hashes: np.ndarray) -> np.ndarray:
    """The hash class of each word."""
    return ((hashes >> U(32)) % U(HASHED)).astype(np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """word (its hash as a long), slot and n over the whole corpus."""

    def run(batches):
        words = Words()
        for b in batches:
            some = b["text"].tolist()
            for i, j in chunks(some, CHUNK_CHARS):
                words.read(some[i:j])
                word, n = np.unique(words.hashes(), return_counts=True)
                yield pd.DataFrame({"word": word.view(np.int64), "slot": slots(word), "n": n})

    return rows.mapInPandas(run, "word long, slot long, n long").groupBy("word", "slot").agg(F.sum("n").alias("n"))


def relative(counts: np.ndarray) -> np.ndarray:
    """Log counts less the greatest of their row; entries that no word has get NEVER, so that they take no probability."""
    most = counts.max(1, keepdims=True)
    return np.where(counts > 0, np.log(np.maximum(counts, 1e-9) / np.maximum(most, 1e-9)), np.where(most > 0, NEVER, 0.0))


class Vocabulary:
    """Class, member and log P(word | class, other) of any words, and the counts of the known ones."""

    def __init__(self, top, by_slot: dict[int, tuple[int, int]]):
        """top: words (or their hashes) and counts by falling count; by_slot: count and number of all words of each hash class."""
        self.hashes = np.array([hash_of([w])[0] if isinstance(w, str) else w for w, _ in top], U)
        self.n = np.array([n for _, n in top], np.int64)
        v, slot = len(self.hashes), slots(self.hashes)
        total = np.zeros(HASHED)
        for s, (n, _) in by_slot.items():
            total[s] = n
        own = np.arange(v) < OWN
        np.subtract.at(total, slot[own], self.n[own])
        order = np.argsort(np.where(own, -1, slot), kind="stable")
        s = np.where(own, -1, slot)[order]
        rank = np.empty(v, np.int64)  # of a word among the hashed words of its class
        rank[order] = np.arange(v) - np.searchsorted(s, s)
        self.member = np.where(own, REST, np.minimum(rank, REST))
        self.classes = np.where(own, np.arange(v), OWN + slot)
        inside = ~own & (self.member < REST)
        shared = total.copy()
        np.subtract.at(shared, slot[inside], self.n[inside])
        self.shared = np.log(np.maximum(shared, 1.0))  # log count of the other words of each class
        self.inner = np.where(own | inside, 0.0, np.log(np.maximum(self.n, 1)) - self.shared[slot])
        # where the network starts: the counts
        self.base = relative(np.concatenate((np.pad(self.n[:OWN], (0, max(0, OWN - v))), total))[None])[0]
        held = np.zeros((HASHED, MEMBERS + 1))
        held[slot[inside], self.member[inside]] = self.n[inside]
        held[:, REST] = shared
        self.members = relative(held)
        self._fill()

    def _fill(self):
        """An open-addressed table from hashes to rows, -1 where empty."""
        size = 1 << max(4, (4 * len(self.hashes)).bit_length())
        self.mask, self.table = U(size - 1), np.full(size, -1, np.int32)
        left, at = np.arange(len(self.hashes), dtype=np.int32), (self.hashes & self.mask).astype(np.int64)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]  # of rows that meet here, one stays
            placed = self.table[at] == left
            left, at = left[~placed], (at[~placed] + 1) & int(self.mask)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The row of each word, or -1."""
        out = np.full(len(h), -1, np.int64)
        at, open_ = (h & self.mask).astype(np.int64), np.arange(len(h))
        while len(open_):
            row = self.table[at]
            hit = (row >= 0) & (self.hashes[row] == h[open_] if len(self.hashes) else False)
            out[open_[hit]] = row[hit]
            go = (row >= 0) & ~hit
            open_, at = open_[go], (at[go] + 1) & int(self.mask)
        return out

    def start(self, seed: int = 11) -> np.ndarray:
        """Weights of a network that knows the counts only."""
        net = Network(seed=seed)
        net.base[:] = self.base
        net.inner[:] = 0
        net.shift[:] = self.members
        return net.flat


def fit_vocabulary(counts: DataFrame) -> Vocabulary:
    size = F.floor(F.log2("n") * 8)  # only words of the sizes that can be among the most frequent go to the driver
    least, found = 0, 0
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect(), reverse=True):
        least, found = r["size"], found + r["words"]
        if found >= VOCABULARY:
            break
    top = counts.where(size >= least).orderBy(F.desc("n"), "word").limit(VOCABULARY).select("word", "n").toPandas()
    by_slot = {r[0]: (r[1], r[2]) for r in counts.groupBy("slot").agg(F.sum("n"), F.count("*")).collect()}
    return Vocabulary(list(zip(top["word"].to_numpy(np.int64).view(U), top["n"])), by_slot)


class Network:
    """tanh of summed position-wise class embeddings, then a softmax over classes, and one over the members of a hashed class."""

    def __init__(self, weights: np.ndarray | None = None, seed: int = 11):
        if weights is None:
            rng = np.random.default_rng(seed)
            weights = np.concatenate([rng.normal(0, 0.1, np.prod(s)) if len(s) > 1 else np.zeros(s) for s in SHAPES])
        self._lay(weights.astype(np.float32))

    def _lay(self, flat: np.ndarray):
        self.flat = flat
        parts = np.split(self.flat, np.cumsum([int(np.prod(s)) for s in SHAPES])[:-1])
        self.near, self.bias, self.out, self.base, self.inner, self.shift = (p.reshape(s) for p, s in zip(parts, SHAPES))

    def hidden(self, sides: np.ndarray) -> np.ndarray:
        h = self.near[0].take(sides[0], 0)
        for k in range(1, len(SIDES)):
            h += self.near[k].take(sides[k], 0)
        h += self.bias
        return np.tanh(h, out=h)

    @staticmethod
    def _tame(z: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """z as it is where its bound lets exp stay finite (hidden states lie within 1), else less its row's maximum."""
        if len(z) and np.abs(weights).sum(0).max() + np.abs(offsets).max() > 60:
            z -= z.max(1, keepdims=True)
        return z

    def logits(self, h: np.ndarray) -> np.ndarray:
        """Logits that exp takes."""
        z = h @ self.out
        z += self.base
        return self._tame(z, self.out, self.base)

    def _inside(self, h: np.ndarray, y: np.ndarray):
        """The words of hashed classes, for y in order: the first one, bounds of each class from there, hidden states, logits of members."""
        bounds = np.searchsorted(y, np.arange(OWN, CLASSES + 1))
        first, bounds = int(bounds[0]), (bounds - bounds[0]).tolist()
        own = h[first:]
        z = np.empty((len(own), MEMBERS + 1), np.float32)
        for c, (i, j) in enumerate(zip(bounds, bounds[1:])):
            np.dot(own[i:j], self.inner[c].T, out=z[i:j])
            z[i:j] += self.shift[c]
        return first, bounds, own, self._tame(z, self.inner.reshape(-1, WIDTH).T, self.shift)

    def score(self, sides: np.ndarray, y: np.ndarray, member: np.ndarray | None = None) -> np.ndarray:
        """log P of each class given its sides, and with member that of the member of a hashed class as well."""
        out = np.empty(len(y))
        for i in range(0, len(y), BLOCK):
            at = i + by_class(y[i : i + BLOCK])
            h, own = self.hidden(sides[:, at]), y[at]
            z = self.logits(h)
            p = z[np.arange(len(z)), own]
            p -= np.log(np.exp(z, out=z).sum(1))
            if member is not None:
                first, _, _, z = self._inside(h, own)
                p[first:] += z[np.arange(len(z)), member[at[first:]]]
                p[first:] -= np.log(np.exp(z, out=z).sum(1))
            out[at] = p
        return out

    def gradient(self, sides: np.ndarray, y: np.ndarray, member: np.ndarray | None = None) -> np.ndarray:
        """The gradient of the mean of -score, in the order of flat."""
        n = len(y)
        if (y[1:] < y[:-1]).any():
            at = by_class(y)
            sides, y, member = sides[:, at], y[at], None if member is None else member[at]
        got = Network.__new__(Network)
        got._lay(np.zeros_like(self.flat))
        h = self.hidden(sides)
        g = self.logits(h)
        np.exp(g, out=g)
        g *= (1 / n) / g.sum(1, keepdims=True)
        g[np.arange(n), y] -= np.float32(1 / n)
        back = g @ self.out.T
        np.dot(h.T, g, out=got.out)
        g.sum(0, out=got.base)
        if member is not None:
            first, bounds, own, z = self._inside(h, y)
            np.exp(z, out=z)
            z *= (1 / n) / z.sum(1, keepdims=True)
            z[np.arange(len(z)), member[first:]] -= np.float32(1 / n)
            down = np.empty_like(own)
            for c, (i, j) in enumerate(zip(bounds, bounds[1:])):
                np.dot(z[i:j].T, own[i:j], out=got.inner[c])
                z[i:j].sum(0, out=got.shift[c])
                np.dot(z[i:j], self.inner[c], out=down[i:j])
            back[first:] += down
        h *= h
        back *= 1 - h
        for k, side in enumerate(sides):
            order = by_class(side)
            side = side[order]
            first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
            got.near[k, side[first]] = np.add.reduceat(back.take(order, 0), first)
        back.sum(0, out=got.bias)
        return got.flat


def by_class(y: np.ndarray) -> np.ndarray:
    """A stable order of small numbers."""
    return np.argsort(y.astype(np.int16), kind="stable")


class Adam:
    def __init__(self, size: int):
        self.m, self.v, self.t = np.zeros(size, np.float32), np.zeros(size, np.float32), 0

    def step(self, net: Network, g: np.ndarray):
        self.t += 1
        self.m += np.float32(0.1) * (g - self.m)
        g *= g
        g -= self.v
        self.v += np.float32(0.01) * g
        rate = RATE * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        np.sqrt(self.v, out=g)
        g += np.float32(1e-8)
        np.divide(self.m, g, out=g)
        net.flat -= np.float32(rate) * g


def examples(some: list, vocabulary: Vocabulary, words: Words | None = None):
    """Neighbours' classes (sides x words), classes and vocabulary rows (or -1) of all words of some texts (or lists of words)."""
    words = words or Words()
    words.read([t if isinstance(t, str) else " ".join(t) for t in some])
    h = words.hashes()
    row = vocabulary.lookup(h)
    y = OWN + slots(h)
    y[row >= 0] = vocabulary.classes[row[row >= 0]]
    gap = max(abs(k) for k in SIDES)
    at = np.arange(len(h)) + gap * (1 + np.repeat(np.arange(len(some)), words.sizes))
    padded = np.full(len(h) + gap * (len(some) + 1), PAD)
    padded[at] = y
    return np.stack([padded[at + k] for k in SIDES]) if len(h) else np.zeros((len(SIDES), 0), int), y, row


def members(row: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The member that each vocabulary row (or -1) stands for in its class."""
    out = np.full(len(row), REST)
    known = row >= 0
    out[known] = vocabulary.member[row[known]]
    return out


def train(rows: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    spark, net = rows.sparkSession, Network(vocabulary.start())
    held = spark.sparkContext.broadcast(vocabulary)
    for r in range(rounds):
        start = net.flat.copy()

        def run(batches):
            own, adam, n = Network(start), Adam(len(start)), 0  # noqa: B023
            rng, words = np.random.default_rng(5), Words()
            for b in batches:
                some = b["text"].tolist()
                for i, j in chunks(some, CHUNK_CHARS):
                    sides, y, row = examples(some[i:j], held.value, words)
                    member = members(row, held.value)
                    order = rng.permutation(len(y))
                    for k in range(0, len(y), BATCH):
                        k = order[k : k + BATCH]
                        k = k[by_class(y[k])]
                        adam.step(own, own.gradient(sides[:, k], y[k], member[k]))
                    n += len(y)
            if n:
                yield pd.DataFrame({"n": [n], "w": [(own.flat.astype(np.float64) * n).tobytes()]})

        def add(batches):
            n, total = 0, 0.0
            for b in batches:  # one sum is held, however many tasks there were
                for m, w in zip(b["n"], b["w"]):
                    n, total = n + int(m), total + np.frombuffer(w)
            if n:
                yield pd.DataFrame({"n": [n], "w": [total.tobytes()]})

        part = rows.where(F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(rounds)) == r)
        got = part.mapInPandas(run, "n long, w binary").repartition(SLOTS).mapInPandas(add, "n long, w binary").collect()
        if got:
            net = Network(sum(np.frombuffer(g["w"]) for g in got) / sum(g["n"] for g in got))
    return net


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, pll (sum of conditional log-probabilities), mean_pll, least_count.

    least_count is the corpus count of the document's rarest word (0 without words). Null and empty texts have no tokens
    and scores of 0. An empty table gives no rows. Repeated rows count as often as they occur, in counts and in training,
    and get equal scores; so do rows of equal text. Very long texts are read whole, one in a chunk. Words of equal count
    are ranked by their hash.
    """
    rows = texts(docs)
    counts = cut(word_counts(rows))
    vocabulary = fit_vocabulary(counts)
    held = rows.sparkSession.sparkContext.broadcast((vocabulary, train(rows, vocabulary, rounds).flat))

    def run(batches):
        known, flat = held.value
        net, words = Network(flat), Words()
        for b in batches:
            some = b["text"].tolist()
            for i, j in chunks(some, CHUNK_CHARS):
                sides, y, row = examples(some[i:j], known, words)
                is_known = row >= 0
                inner = np.where(is_known, 0.0, -known.shared[np.maximum(y - OWN, 0)])
                inner[is_known] = known.inner[row[is_known]]
                n = np.full(len(y) + 1, np.iinfo(np.int64).max)
                n[:-1][is_known] = known.n[row[is_known]]
                ends = np.cumsum(words.sizes)
                starts = ends - words.sizes
                sums = np.concatenate(([0.0], np.cumsum(net.score(sides, y, members(row, known)) + inner)))
                least = np.where(words.sizes > 0, np.minimum.reduceat(n, starts), 0)
                rare = words.hashes()[~is_known].view(np.int64)
                at = np.concatenate(([0], np.cumsum(~is_known)))
                yield pd.DataFrame({"row": b["row"].to_numpy()[i:j], "doc_id": b["doc_id"].to_numpy()[i:j], "n_tokens": words.sizes, "known": sums[ends] - sums[starts], "least": least, "rare": [rare[x:z] for x, z in zip(at[starts], at[ends])]})

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    scored = cut(numbered.mapInPandas(run, "row long, doc_id long, n_tokens long, known double, least long, rare array<long>"))
    often = counts.where("n > 1").select("word", F.col("n"))
    rare = scored.select("row", F.explode("rare").alias("word")).join(often, "word", "left")
    more = rare.groupBy("row").agg(F.sum(F.log(F.coalesce("n", F.lit(1)))).alias("more"), F.min(F.coalesce("n", F.lit(1))).alias("rarest"))
    pll = F.round(F.col("known") + F.coalesce("more", F.lit(0.0)), 4)
    joined = scored.drop("rare").join(more, "row", "left").select("doc_id", "n_tokens", pll.alias("pll"), F.least("least", F.coalesce("rarest", "least")).alias("least_count"))
    return joined.select("doc_id", "n_tokens", "pll", F.round(F.col("pll") / F.greatest("n_tokens", F.lit(1)), 6).alias("mean_pll"), "least_count")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(documents(spark, sf_dir))
