"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are laid out as one codepoint array; a table gives each codepoint's class, refined by one or two characters of
lookahead. The pre-tokeniser is a small automaton over these classes. Its transition functions compose associatively,
so states come from a blocked scan: compose the functions inside every block side by side, scan the block functions the
same way, then replay all blocks side by side from their known entry states. No regular expression runs. Boundaries cut
the text into slices; a slice's token ids come from a bounded cache in front of pair merging by rank. Start offsets of
the slices are kept with the ids, so any slice can be decoded alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import documents, texts

# Fixed values of the pre-tokenisation pattern: white space, and contractions by the letters after an apostrophe.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_CONTRACTIONS = "s t m d"
LONG_CONTRACTIONS = "re ve ll"

# Classes of a character in its place.
BLANK_LAST, BLANK, SPACE_LAST, SPACE, LETTER, NUMBER, OTHER, APOS_1, APOS_2, END = range(10)
# States after a character.
START, IN_SPACE, PENDING, CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, NEED_2, NEED_1, DONE = range(10)
N_STATES = 10
BLOCK = 64
CHUNK_CHARS = 1_000_000
CACHE_SLICES = 250_000


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next state and "a token starts here", by class and state."""
    step, opens = np.zeros((10, N_STATES), np.uint8), np.ones((10, N_STATES), bool)
    for cls, to in ((BLANK_LAST, PENDING), (SPACE_LAST, CLOSED), (BLANK, IN_SPACE), (SPACE, IN_SPACE), (LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (APOS_1, NEED_1), (APOS_2, NEED_2), (END, START)):
        step[cls] = to
    opens[[BLANK, SPACE], IN_SPACE] = False
    for cls, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        opens[cls, [run, PENDING]] = False
    for cls in (APOS_1, APOS_2):  # an apostrophe inside a run of other characters, or after a blank, opens nothing
        opens[cls, [IN_OTHER, PENDING]] = False
        step[cls, [IN_OTHER, PENDING]] = IN_OTHER
    step[LETTER, [NEED_2, NEED_1]] = [NEED_1, DONE]
    opens[LETTER, [NEED_2, NEED_1]] = False
    return step, opens


STEP, OPENS = _automaton()
_table: np.ndarray | None = None


def codepoint_classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER of each codepoint."""
    global _table
    if _table is None:
        kind = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        t[WHITE_SPACE] = SPACE
        _table = t
    return _table


def place_classes(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each character in its place; ends: positions of the separators between texts."""
    cls = codepoint_classes()[cp]
    cls[ends] = END
    space = cls == SPACE
    last = space.copy()
    last[:-1] &= ~space[1:] & (cls[1:] != END)
    last[-1:] = False
    blank = space & (cp == 32)
    cls[blank] = BLANK
    cls[last] = SPACE_LAST
    cls[blank & last] = BLANK_LAST
    at = np.flatnonzero(cp == 39)
    if len(at):
        pad = np.concatenate((cp, np.zeros(2, cp.dtype)))
        one, two = pad[at + 1], pad[at + 2]
        short = np.isin(one, [ord(c) for c in SHORT_CONTRACTIONS.split()])
        long = np.any([(one == ord(c[0])) & (two == ord(c[1])) for c in LONG_CONTRACTIONS.split()], axis=0)
        at, short, long = at[cls[at] == OTHER], short[cls[at] == OTHER], long[cls[at] == OTHER]
        cls[at[long]] = APOS_2
        cls[at[short]] = APOS_1
    return cls


def entry_states(functions: np.ndarray) -> np.ndarray:
    """The state before each of the transition functions (n, states), from START, by a blocked associative scan."""
    n = len(functions)
    if n <= BLOCK:
        out, s = np.zeros(n, np.uint8), START
        for i in range(n):
            out[i], s = s, functions[i, s]
        return out
    rows = -(-n // BLOCK)
    f = np.concatenate((functions, np.tile(np.arange(N_STATES, dtype=np.uint8), (rows * BLOCK - n, 1)))).reshape(rows, BLOCK, N_STATES)
    total = f[:, 0]
    for j in range(1, BLOCK):
        total = np.take_along_axis(f[:, j], total, 1)
    s, out = entry_states(total), np.zeros((rows, BLOCK), np.uint8)
    at = np.arange(rows)
    for j in range(BLOCK):
        out[:, j] = s
        s = f[at, j, s]
    return out.reshape(-1)[:n]


def token_starts(cls: np.ndarray) -> np.ndarray:
    """Positions where a slice starts; separators count as slices of their own."""
    n = len(cls)
    rows = -(-n // BLOCK)
    c = np.concatenate((cls, np.full(rows * BLOCK - n, END, np.uint8))).reshape(rows, BLOCK).T.copy()
    flat, opens = STEP.reshape(-1), OPENS.reshape(-1)
    total = STEP[c[0]]
    for j in range(1, BLOCK):
        total = flat[c[j][:, None] * np.uint8(N_STATES) + total]
    s, out = entry_states(total), np.zeros((BLOCK, rows), bool)
    for j in range(BLOCK):
        key = c[j] * np.uint8(N_STATES) + s
        out[j], s = opens[key], flat[key]
    return np.flatnonzero(out.T.reshape(-1)[:n])


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one slice: merge the neighbours of lowest rank, leftmost first, while any can merge."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    pair = [ranks.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
    while pair:
        low = min(pair)
        if low == 1 << 30:
            break
        i = pair.index(low)
        parts[i] += parts.pop(i + 1)
        pair.pop(i)
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return tuple([ranks[p] for p in parts])


def _merge_long(parts: list, ranks: dict[bytes, int]) -> tuple[int, ...]:
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if parts[i] is None or after[i] != j or j >= n or parts[j] is None or len(parts[i]) + len(parts[j]) != len(both):
            continue
        parts[i], parts[j] = both, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(both + parts[k])) is not None:
                heapq.heappush(heap, (r, i, k, both + parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + both)) is not None:
            heapq.heappush(heap, (r, h, i, parts[h] + both))
    return tuple([ranks[p] for p in parts if p is not None])


def slices(some: list[str]):
    """Yield (cut slices, their start offsets in characters) of each text, over chunks of bounded size."""
    at = 0
    while at < len(some):
        n, end = 0, at
        while end < len(some) and (end == at or n + len(some[end]) < CHUNK_CHARS):
            n += len(some[end]) + 1
            end += 1
        chunk = some[at:end]
        big = "\0".join(chunk) + "\0"
        ends = np.cumsum([len(t) + 1 for t in chunk]) - 1
        begin = np.concatenate(([0], ends[:-1] + 1))
        starts = token_starts(place_classes(np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32), ends))
        firsts, lasts, cuts = np.searchsorted(starts, begin).tolist(), np.searchsorted(starts, ends).tolist(), starts.tolist()
        for text_at, a, b in zip(begin.tolist(), firsts, lasts):
            own = cuts[a : b + 1]  # the separator's own slice closes the last one
            yield [big[x:y] for x, y in zip(own, own[1:])], starts[a:b] - text_at
        at = end


class _Cache(dict):
    """Slice -> ids. When full, it becomes the older generation, from which used slices come back."""

    def __init__(self, ranks):
        super().__init__()
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str):
        ids = self.old.get(piece)
        if ids is None:
            ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def turn(self):
        if len(self) > CACHE_SLICES:
            self.old = dict(self)
            self.clear()


class Codec:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.cache = _Cache(self.ranks)

    def encode(self, some: list[str]):
        """Yield (ids, slice starts in characters, ids of each slice) for each text, empty texts included."""
        get = self.cache.__getitem__
        for pieces, starts in slices(some):
            self.cache.turn()
            parts = list(map(get, pieces))
            yield list(chain.from_iterable(parts)), starts, parts

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _rank_file(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, starts (character offset of each slice), counts (ids of each slice); null text as empty, which has no ids."""
    held = _rank_file(docs, path)

    def run(batches):
        codec = Codec(held.value)
        for b in batches:
            got = list(codec.encode(b["text"].tolist()))
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [x for x, _, _ in got], "starts": [s for _, s, _ in got], "counts": [[len(p) for p in parts] for _, _, parts in got]})

    return texts(docs).mapInPandas(run, "doc_id long, ids array<int>, starts array<int>, counts array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id and ids; bytes that are not UTF-8 become replacement characters."""
    held = _rank_file(encoded, path)

    def run(batches):
        codec = Codec(held.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [codec.decode([] if x is None else x).decode("utf-8", "replace") for x in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_slices, ids_sha256, decoded_sha256: each text encoded and its ids decoded again, in one pass.

    Repeated rows repeat their row; an empty table gives no rows.
    """
    held = _rank_file(docs, path)

    def run(batches):
        codec = Codec(held.value)
        names = [str(i) for i in range(len(codec.tokens))]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            rows = []
            for ids, starts, _ in codec.encode(b["text"].tolist()):
                rows.append((len(ids), len(starts), sha(" ".join(map(names.__getitem__, ids)).encode()), sha(codec.decode(ids))))
            out = pd.DataFrame(rows, columns=["n_tokens", "n_slices", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return texts(docs).mapInPandas(run, "doc_id long, n_tokens long, n_slices long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
