"""Substring dedup by recompression.

A text is a row of word symbols. First, runs of one word become one symbol; then, in rounds, a symbol of class 0
followed by one of class 1 becomes one symbol, where the classes are hash bits of the names, drawn anew each round. The
name of a run or pair is a 64-bit hash of what it is made of, so all tasks agree on the names of the whole corpus
without a dictionary, and equal substrings get equal symbols in their interior. Each symbol carries the span of words
that its existence depends on (an unmerged symbol depends on the neighbour it failed to merge with). A symbol that first
reaches `ANCHOR_WORDS` is an anchor, and every window of `window` words that holds the dependency span of an anchor
holds it in all its copies. So a repeated window has only repeated anchors:

1. Round one gives the names of all anchors, and for windows without an anchor the windows' own hashes. The names that
   occur twice or more set bits of a bitmap of bounded size (`MAX_BITS`); names are verified no further here, as a
   collision only leaves a candidate more.
2. Round two reads the texts again. Windows whose anchors are all in the bitmap are candidates; a 128-bit hash of their
   words finds the first start of each, by partial aggregation (one row a document and window at most). Candidates that
   are not first starts are repeats, and cover the words to remove.
3. Documents with repeats, again told by a bounded bitmap, are joined with their word ranges; all others are finished
   where they are read, and their text is not shuffled.

More repeats than the bitmap has room for make more candidates, never other results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, texts
from .words import MIX_1, MIX_2, U, Words, chunks, mix

WINDOW = 20
ANCHOR_WORDS = 4
ROUNDS = 6
MAX_BITS = 1 << 30
CHUNK_CHARS = 1_000_000
BASE_1, BASE_2 = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)


def pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * MIX_1 + mix(b + MIX_1))


class Chunk:
    """Words of some texts (strings, or lists of words) in one row of positions, with a separator after each text."""

    def __init__(self, some: list, words: Words, second: bool = True):
        words.read([t if isinstance(t, str) else b" ".join(t).decode("utf-8", "surrogatepass") for t in some])
        self.sizes = words.sizes
        self.ends = np.cumsum(self.sizes + 1) - 1
        self.begins = self.ends - self.sizes
        n = int(self.ends[-1]) + 1
        self.real = np.ones(n, bool)
        self.real[self.ends] = False
        self.one, self.two = np.zeros(n, U), np.zeros(n if second else 0, U)
        self.one[self.real] = words.hashes()
        if second:
            self.two[self.real] = words.hashes(True)

    def starts(self, window: int) -> np.ndarray:
        """Whether a window starts at each position."""
        return cover(len(self.real), self.begins, np.maximum(self.begins, self.ends - window + 1))

    def window_hash(self, at: np.ndarray, window: int, second: bool = False) -> np.ndarray:
        h, base, out = (self.two, BASE_2, np.zeros(len(at), U)) if second else (self.one, BASE_1, np.zeros(len(at), U))
        for k in range(window):
            out = out * base + h[at + k]
        return mix(out)


def anchors(chunk: Chunk, window: int, least: int = ANCHOR_WORDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, and dependency spans [from, to), of the symbols that first reach `least` words within `window` words."""
    n = len(chunk.real)
    name, solid = chunk.one, chunk.real
    same = np.zeros(n, bool)
    same[1:] = (name[1:] == name[:-1]) & solid[1:] & solid[:-1]
    first = np.flatnonzero(~same)
    size = np.diff(np.append(first, n))
    name, solid, lo = name[first], solid[first], first
    hi = lo + size
    name = np.where(size > 1, pair_name(name, size.astype(U)), name)
    # maximal runs depend on their neighbours; what depends on the place before the first word lies in no window
    dep_lo, dep_hi = lo - 1, np.minimum(hi + 1, n)
    got = [(name[k], dep_lo[k], dep_hi[k]) for k in [solid & (size >= least)]]
    for r in range(rounds):
        live = len(name)
        if live < 2:
            break
        salt = U((r + 1) * int(MIX_1) % (1 << 64))
        one = (mix(name + salt) & U(1)).astype(bool)
        lead = np.zeros(live, bool)
        lead[:-1] = ~one[:-1] & one[1:] & solid[:-1] & solid[1:]
        # an anchor is finished: it merges no more
        done = hi - lo >= least
        lead[:-1] &= ~done[:-1] & ~done[1:]
        tail = np.zeros(live, bool)
        tail[1:] = lead[:-1]
        at = np.flatnonzero(lead)
        new_lo, new_hi = dep_lo.copy(), dep_hi.copy()
        free = ~lead & ~tail
        left, right = free & one, free & ~one
        left[0] = right[-1] = False
        k = np.flatnonzero(left)
        new_lo[k] = np.minimum(dep_lo[k], dep_lo[k - 1])
        k = np.flatnonzero(right)
        new_hi[k] = np.maximum(dep_hi[k], dep_hi[k + 1])
        new_lo[at] = np.minimum(dep_lo[at], dep_lo[at + 1])
        new_hi[at] = np.maximum(dep_hi[at], dep_hi[at + 1])
        name, hi = name.copy(), hi.copy()
        name[at], hi[at] = pair_name(name[at], name[at + 1]), hi[at + 1]
        big = at[(hi[at] - lo[at] >= least)]
        got.append((name[big], new_lo[big], new_hi[big]))
        keep = ~tail
        name, solid, lo, hi, dep_lo, dep_hi = name[keep], solid[keep], lo[keep], hi[keep], new_lo[keep], new_hi[keep]
    name, dep_lo, dep_hi = (np.concatenate(x) for x in zip(*got))
    fits = dep_hi - dep_lo <= window
    return name[fits], dep_lo[fits], dep_hi[fits]


def cover(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n positions lie in a range [lo, hi)."""
    d = np.bincount(lo, minlength=n + 1)[: n + 1] - np.bincount(hi, minlength=n + 1)[: n + 1]
    return np.cumsum(d[:-1]) > 0


def named_windows(chunk: Chunk, window: int):
    """Anchors (name, first and past-last window start), and the starts of windows without an anchor."""
    name, lo, hi = anchors(chunk, window)
    valid, n = chunk.starts(window), len(chunk.real)
    a, b = np.maximum(hi - window, 0), lo + 1
    bare = np.flatnonzero(valid & ~cover(n, a, b))
    return name, a, b, valid, bare


def _chunks(batch: pd.DataFrame):
    """(rows of the batch, their texts) of bounded size."""
    some = batch["text"].tolist()
    for a, b in chunks(some, CHUNK_CHARS):
        yield slice(a, b), some[a:b]


def bitmap(keys: DataFrame, bits_each: int, most: int = MAX_BITS) -> np.ndarray:
    """A bitmap with the bit of each key (hashed longs); a power of two bits, bits_each for a key, `most` at most."""
    bits = min(most, max(1 << 22, 1 << (keys.count() * bits_each).bit_length()))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << 16, bool)
        flags[pdf["bit"].to_numpy() & 0xFFFF] = True
        return pd.DataFrame({"part": [int(pdf["bit"].iat[0]) >> 16], "flags": [np.packbits(flags, bitorder="little").tobytes()]})

    bit = keys.select((F.col(keys.columns[0]).bitwiseAND(F.lit(bits - 1))).alias("bit"))
    parts = bit.groupBy(F.shiftright("bit", 16)).applyInPandas(build, "part long, flags binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        out[r["part"] * 8192 : (r["part"] + 1) * 8192] = np.frombuffer(r["flags"], np.uint8)
    return out


def has(held: np.ndarray, name: np.ndarray) -> np.ndarray:
    bit = name & U(len(held) * 8 - 1)
    return (held[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8)) & 1 == 1


def repeated_names(rows: DataFrame, window: int) -> DataFrame:
    """The names that occur twice or more in the corpus, a written table."""

    def run(batches):
        words = Words()
        for batch in batches:
            for _, some in _chunks(batch):
                chunk = Chunk(some, words, False)
                name, _, _, _, bare = named_windows(chunk, window)
                name, n = np.unique(np.concatenate((name, chunk.window_hash(bare, window))), return_counts=True)
                yield pd.DataFrame({"name": name.view(np.int64), "n": n})

    return cut(rows.mapInPandas(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name"))


def repeats(rows: DataFrame, window: int, most: int = MAX_BITS) -> DataFrame:
    """doc_id, sub and ranges of words (a flat array of from, to) to remove, of documents that have any.

    Documents are ordered by doc_id, and by sub, a hash of the text, where texts share an id.
    """
    spark = rows.sparkSession
    order = F.col("doc_id")
    if not rows.select("doc_id", "sub").groupBy("doc_id").agg(F.min("sub").alias("a"), F.max("sub").alias("b")).where("a <> b").isEmpty():
        wide = lambda c: c.cast("decimal(19,0)")
        order = wide(order) * wide(F.lit(1 << 62)) + wide(F.shiftrightunsigned("sub", 2))
    held = spark.sparkContext.broadcast(bitmap(repeated_names(rows, window), 32, most))

    def run(batches):
        words = Words()
        for batch in batches:
            for part, some in _chunks(batch):
                ids, subs = batch["doc_id"].to_numpy()[part], batch["sub"].to_numpy()[part]
                chunk = Chunk(some, words)
                name, a, b, valid, bare = named_windows(chunk, window)
                out = ~has(held.value, name)
                valid &= ~cover(len(valid), a[out], b[out])
                valid[bare] = has(held.value, chunk.window_hash(bare, window))
                at = np.flatnonzero(valid)
                if not len(at):
                    continue
                doc = np.searchsorted(chunk.ends, at)
                h = chunk.window_hash(at, window)
                order = np.argsort(h, kind="stable")
                again = np.zeros(len(at), bool)
                again[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
                k = np.sort(order[~again])  # the first start of each window in its document
                edge = np.flatnonzero(np.append(True, np.diff(at) > 1))
                stop = np.append(at[edge[1:] - 1], at[-1])
                d, s = doc[edge], at[edge]
                own = np.full(len(k), -1)
                yield pd.DataFrame({"h1": h[k].view(np.int64), "h2": chunk.window_hash(at[k], window, True).view(np.int64), "run": own, "doc_id": ids[doc[k]], "sub": subs[doc[k]], "start": at[k] - chunk.begins[doc[k]]})
                begin, last = s - chunk.begins[d], stop - chunk.begins[d]
                yield pd.DataFrame({"h1": ids[d], "h2": subs[d], "run": (begin << 32) + last, "doc_id": ids[d], "sub": subs[d], "start": begin})

    # a window (run: -1) with its first start, or a document's run of candidates, whose bounds are in run
    found = rows.mapInPandas(run, "h1 long, h2 long, run long, doc_id long, sub long, start long")
    firsts = found.groupBy("h1", "h2", "run").agg(F.min("doc_id").alias("doc_id"), F.min_by("sub", order).alias("sub"), F.min_by("start", order).alias("start"))
    of_doc = firsts.groupBy("doc_id", "sub").agg(F.collect_list(F.when(F.col("run") < 0, F.col("start"))).alias("firsts"), F.collect_list(F.when(F.col("run") >= 0, F.col("run"))).alias("runs"))

    def ranges(batches):
        for batch in batches:
            ids, subs, out = [], [], []
            for doc_id, sub, firsts, runs in zip(batch["doc_id"], batch["sub"], batch["firsts"], batch["runs"]):
                runs = np.asarray(runs, np.int64)
                a, b = runs >> 32, (runs & 0xFFFFFFFF) + 1
                n = int(b.max())
                again = cover(n, a, b)
                again[np.asarray(firsts, np.int64)] = False
                at = np.flatnonzero(again)
                if len(at):
                    gone = cover(n + window, at, at + window).astype(np.int8)
                    step = np.diff(np.concatenate(([0], gone, [0])))
                    ids.append(doc_id)
                    subs.append(sub)
                    out.append(np.stack((np.flatnonzero(step == 1), np.flatnonzero(step == -1)), 1).reshape(-1))
            yield pd.DataFrame({"doc_id": ids, "sub": subs, "ranges": out})

    return cut(of_doc.mapInPandas(ranges, "doc_id long, sub long, ranges array<long>"))


def _kept(words: list[bytes], ranges) -> list[bytes]:
    out, at = [], 0
    for a, b in zip(ranges[::2], ranges[1::2]):
        out += words[at:a]
        at = b
    return out + words[at:]


def _finished(doc_id, words: list[bytes], kept: list[bytes]):
    return doc_id, len(words), len(words) - len(kept), b" ".join(kept)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = False, most: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, and with with_text the kept text.

    A word goes if a window of `window` words covers it whose sequence starts earlier too, in a smaller doc_id or in the
    same text. Null text has no words; texts shorter than a window lose nothing; an empty table gives no rows. Different
    texts that share a doc_id (null ids among them) are documents of their own, in the order of a hash of the text; rows
    of equal id and text are one document, and get the same result.
    """
    rows = texts(docs).withColumn("sub", F.xxhash64("text"))
    gone = repeats(rows, window, most)
    touched = rows.sparkSession.sparkContext.broadcast(bitmap(gone.select(F.xxhash64("doc_id", "sub")), 16, 1 << 26))
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    columns = [x.split()[0] for x in result.split(", ")]

    def row(doc_id, words, kept):
        *head, text = _finished(doc_id, words, kept)
        return [*head, hashlib.sha256(text).hexdigest(), *[text.decode("utf-8", "replace")] * with_text]

    def first(batches):
        for b in batches:
            open_ = has(touched.value, b["key"].to_numpy().view(np.uint64))
            out = []
            for doc_id, text, o in zip(b["doc_id"].tolist(), b["text"].tolist(), open_):
                words = None if o else text.encode("utf-8", "surrogatepass").split()
                out.append([doc_id, *[None] * (len(columns) - 1), text] if o else [*row(doc_id, words, words), None])
            got = pd.DataFrame(out, columns=[*columns, "text"])
            got.insert(1, "sub", b["sub"].to_numpy())
            yield got

    def second(batches):
        for b in batches:
            out = b[columns].astype(object)
            for i in np.flatnonzero(b["text"].notna()):
                words = b["text"].iat[i].encode("utf-8", "surrogatepass").split()
                ranges = b["ranges"].iat[i]
                out.iloc[i] = row(b["doc_id"].iat[i], words, _kept(words, [] if ranges is None else ranges))
            yield out

    begun = rows.withColumn("key", F.xxhash64("doc_id", "sub")).mapInPandas(first, result.replace("doc_id long", "doc_id long, sub long") + ", text string")
    return begun.join(gone, ["doc_id", "sub"], "left").mapInPandas(second, result)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS n FROM (SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d))),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT x.doc_id, x.i, x.word, coalesce(max(r.k) OVER (PARTITION BY x.doc_id ORDER BY x.i), -99) < x.i - 19 AS kept FROM x LEFT JOIN (SELECT doc_id, k FROM g WHERE n > 1) r ON r.doc_id = x.doc_id AND r.k = x.i),
t AS (SELECT doc_id, count(*) FILTER (NOT kept) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (kept) AS txt FROM y GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
