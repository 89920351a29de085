"""Token-id output: every document's ids as one zstandard frame under a shared dictionary.

A write makes a folder of shard files and one dictionary file. The dictionary is trained on the serialised id arrays of
a bounded sample (about `SAMPLE_DOCS` documents by a hash of the id, `SAMPLE_CHARS` of each; it only affects the size of the files).
Documents go to shards by ranges of doc_id; each task encodes its range and writes one file of its own attempt, so lost
or repeated tasks leave no half-written shard in the manifest. A shard is

    magic | length and JSON of {dictionary, dtype, documents} | frames | index | offset of the index | magic

with one index row (doc_id, offset of its frame, length of its frame, ids) a document, so a short document is read with
two small reads. Files are reached by pyarrow.fs, under the shared folder of the session.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import sys
import uuid
import zlib
from array import array
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import CACHE_SLICES
from .common import documents, shared_dir, texts

MAGIC = b"TESSIDS1"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("ids", "<u8")])
SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 4_000
DICTIONARY_BYTES = 64 * 1024
LEVEL = 6
CHUNK_CHARS = 1_000_000
#: A distinct unit of a chunk is looked up once, so larger chunks take less time and more memory.
UNIT_CHARS = 8_000_000


def _open(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else os.path.abspath(uri))


def _tokenizer(model: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(model)
    t.encode_special_tokens = True
    return t


_SPACES = [c for c in map(chr, range(0x3100)) if c.isspace() and c != " "]


def _uneven(text: str) -> bool:
    """Whether a blank stands beside other white space or at an edge; if not, every blank opens a slice with what follows."""
    return not text or text[0] == " " or text[-1] == " " or "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in _SPACES)


def _byte_chars() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: printable Latin-1 ones for themselves, then from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()
BLANK = BYTE_CHARS[0x20]
# A fixed value: the byte-level pre-tokeniser's pattern.
SLICES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
MARKS = (".", ",", ";", ":", "!", "?")
CACHE_UNITS = 500_000
_encoders: dict = {}


def encoder_of(model: str):
    """One encoder a worker, so that its caches outlive a task."""
    name = hashlib.sha256(model.encode()).hexdigest()
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = _Encoder(model)
    return _encoders[name]


class _Encoder:
    """Serialised ids of whole texts by the tokenizers library.

    Where the model is BPE behind the byte-level pattern alone, blank-separated units are looked up first, the slices of
    unseen units next, and the library's model gets each unseen slice; all caches are bounded. As most unseen slices
    never come again, the model is built without a cache of its own. Any other model gets the texts themselves.
    """

    def __init__(self, model: str):
        self.tokenizer = _tokenizer(model)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() < 65_536 else "<u4"
        spec = json.loads(model)
        split = spec.get("pre_tokenizer") or {}
        bpe = spec["model"]
        plain = bpe.get("type") == "BPE" and not any(bpe.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "unk_token", "byte_fallback", "ignore_merges"))
        self.by_slices = plain and spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and all(t["special"] for t in spec.get("added_tokens", []))
        if self.by_slices:
            from tokenizers.models import BPE

            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
            self.tokenize = BPE(vocab=bpe["vocab"], merges=pairs, cache_capacity=0).tokenize
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, some: list[str]):
        for chunk in _chunks(some, UNIT_CHARS if self.by_slices else CHUNK_CHARS):
            yield from self._by_units(chunk) if self.by_slices else map(self._bytes, self.tokenizer.encode_batch_fast(chunk, add_special_tokens=False))

    def _serialised(self, ids: list[int]) -> bytes:
        out = array("H" if self.dtype == "<u2" else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _bytes(self, encoding) -> bytes:
        return self._serialised(encoding.ids)

    def _tokenized(self, some: list[str]) -> list[bytes]:
        """The ids of slices, by the library's model."""
        tokenize, ids, ends = self.tokenize, [], [0]
        for piece in some:
            shown = piece.replace(" ", BLANK) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(BYTE_CHARS)
            ids += [t.id for t in tokenize(shown)]
            ends.append(len(ids))
        blob, width = self._serialised(ids), np.dtype(self.dtype).itemsize
        return [blob[x * width : y * width] for x, y in zip(ends, ends[1:])]

    def _pieces(self, cut: list[list[str]]) -> dict[str, bytes]:
        """The ids of slices, with all of cut among them; the library gets those that no cache has."""
        if len(self.known) > CACHE_SLICES:
            self.known, self.old = {}, self.known
        known, missing = self.known, []
        for piece in set(filterfalse(known.__contains__, chain.from_iterable(cut))):
            if (ids := self.old.get(piece)) is None:
                missing.append(piece)
            else:
                known[piece] = ids
        if missing:
            known.update(zip(missing, self._tokenized(missing)))
        return known

    def _units(self, units: list[str], out: dict[str, bytes]):
        """Put ids of units, each behind a blank, into out. Letters alone, or with one common mark behind them, need no pattern."""
        letters, marked, other = [], [], []
        for u in units:
            (letters if u.isalpha() else marked if u[-1:] in MARKS and u[:-1].isalpha() else other).append(u)
        plain, bare = [" " + u for u in letters], [" " + u[:-1] for u in marked]
        known = self._pieces([plain, bare, list(MARKS)])
        out.update(zip(letters, map(known.__getitem__, plain)))
        out.update((u, known[x] + known[u[-1]]) for u, x in zip(marked, bare))
        if other:
            out.update(zip(other, self._sliced(other)))

    def _sliced(self, units: list[str]) -> list[bytes]:
        """The same from the slices of one text: a slice with a blank starts a unit."""
        pieces = SLICES.findall(" " + " ".join(units))
        known = self._pieces([pieces])
        ids = list(map(known.__getitem__, pieces))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        heads = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
        cuts, blob = [*(ends[heads] - [len(ids[h]) for h in heads]).tolist(), int(ends[-1])], b"".join(ids)
        return [blob[x:y] for x, y in zip(cuts, cuts[1:])]

    def _by_slices(self, some: list[str]):
        for chunk in _chunks(some, CHUNK_CHARS):
            cut = [SLICES.findall(t) for t in chunk]
            known = self._pieces(cut)
            yield from [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def _by_units(self, chunk: list[str]):
        """Texts are cut and units told apart as Arrow arrays: only distinct units become objects, and all ids are taken at once."""
        if len(self.first) > CACHE_UNITS:
            self.first = {}
        if len(self.later) > CACHE_UNITS:
            self.later, self.before = {}, self.later if len(self.later) <= 2 * CACHE_UNITS else {}
        first, later = self.first, self.later
        cut = [None if _uneven(t) else t.partition(" ") for t in chunk]
        units = pc.split_pattern(pa.array([c[2] for c in cut if c and c[1]], pa.large_string()), " ")
        coded = units.flatten().dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        tails = []
        for u in filterfalse(later.__contains__, own):
            if (x := self.before.get(u)) is None:
                tails.append(u)
            else:
                later[u] = x
        for part in _chunks(tails, CHUNK_CHARS):
            self._units(part, later)
        ids = pa.array(map(later.__getitem__, own), pa.large_binary(), size=len(own)).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[units.offsets.to_numpy()].tolist()
        blob = memoryview(ids.buffers()[2] or b"")
        heads = list({c[0] for c in cut if c}.difference(first))
        first.update(zip(heads, self._by_slices(heads)))
        whole = self._by_slices([t for t, c in zip(chunk, cut) if c is None])
        at = 0
        for c in cut:
            if c is None:
                yield next(whole)
            elif c[1]:
                yield first[c[0]] + blob[ends[at] : ends[at + 1]]
                at += 1
            else:
                yield first[c[0]]


def _chunks(some: list[str], chars: int):
    """some in runs of about so many characters."""
    at = 0
    while at < len(some):
        n, end = 0, at
        while end < len(some) and (end == at or n + len(some[end]) < chars):
            n += len(some[end])
            end += 1
        yield some[at:end]
        at = end


def train_dictionary(arrays: list[bytes]) -> bytes:
    """A zstandard dictionary of the arrays; where there are too few to train on, their raw content; empty if none."""
    raw = b"".join(arrays)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, len(raw) // 8)), arrays).as_bytes()
    except zstandard.ZstdError:
        return raw[-DICTIONARY_BYTES:]


class ShardWriter:
    def __init__(self, stream, dictionary: bytes, dtype: str):
        self.stream, self.dtype, self.index, self.at, self.ids = stream, dtype, [], 0, 0
        kind = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=kind).compress
        head = json.dumps({"dictionary": hashlib.sha256(dictionary).hexdigest(), "dtype": dtype}).encode()
        self._put(MAGIC + struct.pack("<I", len(head)) + head)

    def _put(self, b: bytes):
        self.stream.write(b)
        self.at += len(b)

    def add(self, doc_id: int, ids: bytes):
        """ids: serialised in the shard's dtype."""
        frame, n = self.compress(ids), len(ids) // np.dtype(self.dtype).itemsize
        self.index.append((doc_id, self.at, len(frame), n))
        self.ids += n
        self._put(frame)

    def close(self):
        at = self.at
        self._put(np.array(self.index, INDEX).tobytes() + struct.pack("<Q", at) + MAGIC)
        self.stream.close()


class ShardReader:
    """Random access to a shard; dictionary: the bytes whose hash the shard names."""

    def __init__(self, uri: str, dictionary: bytes):
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a complete shard")
        (n,) = struct.unpack("<I", self.file.read_at(4, 8))
        head = json.loads(self.file.read_at(n, 12))
        if head["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.dtype = head["dtype"]
        self.index = np.frombuffer(self.file.read_at(size - 16 - at, at), INDEX)
        kind = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._decompress = zstandard.ZstdDecompressor(dict_data=kind).decompress

    def ids(self, row: int) -> np.ndarray:
        x = self.index[row]
        return np.frombuffer(self._decompress(self.file.read_at(int(x["length"]), int(x["offset"]))), self.dtype)

    def find(self, doc_id: int) -> np.ndarray:
        """The ids of one document, by binary search in the index."""
        at = int(np.searchsorted(self.index["doc_id"], doc_id))
        if at == len(self.index) or self.index["doc_id"][at] != doc_id:
            raise KeyError(doc_id)
        return self.ids(at)


def write_ids(docs: DataFrame, folder: str, tokenizer_json: str, end_id: int | None = 0) -> dict:
    """Encode each text (null: empty), append end_id if given, and write the shards of folder in ascending doc_id order.

    Returns the manifest, which is also in folder/manifest.json: dictionary (its hash), and for each shard in order its
    file, documents, ids and first id. Repeated rows are written as often as they
    occur; an empty table gives no shards.
    """
    spark = docs.sparkSession
    with open(tokenizer_json, encoding="utf-8") as f:
        model = f.read()
    rows = texts(docs)
    encoder = _Encoder(model)
    dtype = encoder.dtype
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    some = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows.count() // SAMPLE_DOCS))) == 0
    sample = rows.where(some).select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(2 * SAMPLE_DOCS).collect()
    dictionary = train_dictionary([x for x in encoder([r[0] for r in sample]) if len(x) > 7])
    name = hashlib.sha256(dictionary).hexdigest()
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/dictionary-{name}") as out:
        out.write(dictionary)
    held = spark.sparkContext.broadcast((model, dictionary))

    def write(batches):
        from pyspark import TaskContext

        own, encoder, writer = TaskContext.get(), None, None
        file = f"shard-{own.partitionId():08d}-{own.taskAttemptId()}"
        for b in batches:
            if not len(b):
                continue
            if writer is None:
                encoder = encoder_of(held.value[0])
                system, path = _open(folder)
                writer = ShardWriter(system.open_output_stream(f"{path}/{file}"), held.value[1], dtype)
            for doc_id, ids in zip(b["doc_id"].tolist(), encoder(b["text"].tolist())):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            yield pd.DataFrame({"part": [own.partitionId()], "file": [file], "documents": [len(writer.index)], "ids": [writer.ids]})

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards, first = [], 0
    for r in sorted(ordered.mapInPandas(write, "part int, file string, documents long, ids long").collect(), key=lambda r: r["part"]):
        shards.append({"file": r["file"], "documents": r["documents"], "ids": r["ids"], "first": first})
        first += r["ids"]
    manifest = {"dictionary": name, "shards": shards}
    with system.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, bytes (of its frame), from the shards of folder."""
    system, path = _open(folder)
    with system.open_input_stream(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    with system.open_input_stream(f"{path}/dictionary-{manifest['dictionary']}") as f:
        held = spark.sparkContext.broadcast((f.read(), manifest["shards"]))

    def read(batches):
        dictionary, shards = held.value
        for b in batches:
            for i in b["id"]:
                shard = ShardReader(f"{folder}/{shards[i]['file']}", dictionary)
                n = shard.index["ids"].astype(np.int64)
                crc = [zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in range(len(n))]
                yield pd.DataFrame({"doc_id": shard.index["doc_id"], "start": shards[i]["first"] + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": np.array(crc, np.int64), "bytes": shard.index["length"].astype(np.int64)})

    n = len(manifest["shards"])
    return spark.range(0, n, 1, max(1, n)).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, bytes long")


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, folder)
