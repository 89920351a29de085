"""Exact, SimHash and substring dedup, tokenising and token output against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tessera.llm import byte_bpe, exact_dedup, simhash, substring_dedup, token_output

from .conftest import prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("byte_bpe_50k.json")


def exact_reference(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", "", t or "") for i, t in rows}
    best, size = {}, {}
    for i, t in rows:
        k = norm[i]
        size[k] = size.get(k, 0) + 1
        best[k] = max(best.get(k, (-1, 0)), (len(t or ""), -i))
    return {(i, -best[norm[i]][1], size[norm[i]], -best[norm[i]][1] == i) for i, _ in rows}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_exact_dedup(spark, corpus, limit):
    got = exact_dedup.exact_dedup(table(spark, corpus), digest_all=True, broadcast_groups=limit).collect()
    assert {tuple(r)[:4] for r in got} == exact_reference(corpus)
    sha = {i: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", "", t or "").encode()).hexdigest() for i, t in corpus}
    assert all(r.text_sha256 == sha[r.doc_id] for r in got)


def test_exact_dedup_without_digests_hashes_survivors_only(spark, corpus):
    got = exact_dedup.exact_dedup(table(spark, corpus)).collect()
    assert {tuple(r)[:4] for r in got} == exact_reference(corpus)
    assert any(r.text_sha256 is None for r in got) and all(r.text_sha256 for r in got if r.group_size > 1)


def simhash_reference(rows):
    prints = {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, f"{prints[i]:016x}", find(i)) for i in ids}


def test_simhash(spark, corpus):
    short = [(i, t) for i, t in corpus if len(t or "") < 50_000]
    got = simhash.simhash_components(table(spark, short)).collect()
    assert {tuple(r) for r in got} == simhash_reference(short)


def test_links_equal_brute_force_in_many_shards(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 1500, dtype=np.uint64)
    near = base[:300].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    chain = base[0] ^ ((np.uint64(1) << np.arange(60, dtype=np.uint64)) - np.uint64(1))
    ball = base[1] ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    fp = np.unique(np.concatenate((base, near, chain, ball)))
    points = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(points, shard_rows=16).collect()]
    u = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    assert all((int(np.int64(a).view(np.uint64)) ^ int(np.int64(b).view(np.uint64))) >= 0 for a, b in edges)
    want, got = np.arange(len(fp)), np.arange(len(fp))
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 3):
            want[want == max(want[i], want[j])] = min(want[i], want[j])
    for a, b in edges:
        x, y = got[u[a]], got[u[b]]
        got[got == max(x, y)] = min(x, y)
    assert (want == got).all()


@pytest.mark.parametrize("low", [True, False])
def test_many_fingerprints_that_share_a_half(low):
    """A tree cannot split them; the other half finds the same components as brute force."""
    rng = np.random.default_rng(4)
    other = rng.integers(0, 2**32, 12_000, dtype=np.uint64)
    for _ in range(3):
        other[:2_000] = np.where(rng.random(2_000) < 0.5, other[2_000:4_000] ^ (np.uint64(1) << rng.integers(0, 32, 2_000, dtype=np.uint64)), other[:2_000])
    other[4_000:6_000] = (other[4_000:6_000] & np.uint64(0xFFFF)) | np.uint64(7 << 16)  # a quarter is shared, too
    shared = np.uint64(0xDEADBEEF)
    fp = np.unique((other << np.uint64(32)) | shared if low else (shared << np.uint64(32)) | other)
    want = np.arange(len(fp))
    for i in range(len(fp)):
        near = np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 3)
        if len(near) > 1:
            roots = np.unique(want[near])
            if len(roots) > 1:
                want[np.isin(want, roots)] = roots[0]
    assert (simhash.local_components(fp, low) == want).all() and (want != np.arange(len(fp))).sum() > 500


def substring_reference(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = True
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return {(i, *v) for i, v in out.items()}


@pytest.mark.parametrize("most", [1 << 30, 1 << 16])
def test_substring_dedup(spark, corpus, most):
    rows = corpus + [(9_001 + k, " ".join(["run"] * k + corpus[0][1].split())) for k in range(0, 40, 3)]
    got = substring_dedup.dedup_substrings(table(spark, rows).repartition(5), most=most).collect()
    assert {tuple(r) for r in got} == substring_reference(rows)
    assert sum(r.n_removed for r in got) > 500


def test_equal_windows_have_equal_anchors():
    import random

    rng = random.Random(5)
    shared = prose(rng, 60).encode().split()
    a, b = prose(rng, 100).encode().split() + shared + prose(rng, 50).encode().split(), prose(rng, 33).encode().split() + shared
    chunk = substring_dedup.Chunk([a, b], substring_dedup.Words())
    name, lo, hi = substring_dedup.anchors(chunk, 20)

    def inside(at):
        return sorted((int(n), int(x) - at) for n, x, y in zip(name, lo, hi) if x >= at and y <= at + 20)

    for k in range(len(shared) - 19):
        assert inside(100 + k) == inside(len(a) + 1 + 33 + k)


EDGES = ["", "'", "''s", "don't 'll 've 'sing 's's 'S x'll'd", "a  b", "a \n b\n\n", "  \n", "x　y \t", "12a3 4", "!!'s", " 's", "'s!", "'re's 'r 'l l", "\x00a\x00", "\x1c\x1d a", "\n's", "x" * 500, "ab" * 400, "٣٤ ½ Ⅷ", "\U0001f44d\U0001f3fd ok", "'ſ"]


def test_bpe_equals_the_library(spark, corpus):
    rows = [(-k, t) for k, t in enumerate(EDGES, 1)] + corpus
    with open(RANKS, "rb") as f:
        codec = byte_bpe.Codec(f.read())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    want = {i: enc.encode_ordinary(t or "") for i, t in rows}
    docs = table(spark, rows)
    encoded = byte_bpe.encode(docs, RANKS)
    got = {r.doc_id: r for r in encoded.collect()}
    assert {i: r.ids for i, r in got.items()} == want
    assert {r.doc_id: r.text for r in byte_bpe.decode(encoded, RANKS).collect()} == {i: t or "" for i, t in rows}
    for i, t in rows[:60]:  # a slice decodes alone
        r = got[i]
        if r.counts:
            k = len(r.counts) // 2
            a = sum(r.counts[:k])
            stop = r.starts[k + 1] if k + 1 < len(r.starts) else len(t)
            assert codec.decode(r.ids[a : a + r.counts[k]]).decode() == t[r.starts[k] : stop]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in byte_bpe.digests(docs, RANKS).collect():
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha((dict(rows)[r.doc_id] or "").encode())


def test_random_texts_cut_as_the_pattern_does():
    import random

    import regex

    rng = random.Random(1)
    some = ["".join(rng.choices("'' sltrevmdxé12!?\n\t   　", k=rng.randint(0, 200))) for _ in range(400)]
    for text, (pieces, starts) in zip(some, byte_bpe.slices(some)):
        assert pieces == regex.findall(public_tokenizers.PATTERN, text)
        assert [text[a : a + len(p)] for a, p in zip(starts, pieces)] == pieces


def token_reference(rows):
    tokenizer = token_output._tokenizer(open(MODEL, encoding="utf-8").read())
    start, out = 0, set()
    for i, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_output(spark, corpus, tmp_path):
    rows = corpus + [(10_000 + k, t) for k, t in enumerate([*EDGES, "<|endoftext|> x"])]
    manifest = token_output.write_ids(table(spark, rows).repartition(3), f"file://{tmp_path}/ids", MODEL)
    assert {tuple(r)[:4] for r in token_output.read_ids(spark, f"file://{tmp_path}/ids").collect()} == token_reference(rows)
    shard = manifest["shards"][0]
    dictionary = (tmp_path / "ids" / f"dictionary-{manifest['dictionary']}").read_bytes()
    reader = token_output.ShardReader(f"file://{tmp_path}/ids/{shard['file']}", dictionary)
    first = sorted(rows)[0]
    tokenizer = token_output._tokenizer(open(MODEL, encoding="utf-8").read())
    assert reader.find(first[0]).tolist() == [*tokenizer.encode(first[1] or "", add_special_tokens=False).ids, 0]
    with pytest.raises(KeyError):
        reader.find(-5)
    with pytest.raises(ValueError, match="another dictionary"):
        token_output.ShardReader(f"file://{tmp_path}/ids/{shard['file']}", b"other")


def test_encoder_is_the_library_at_any_chunk_size(monkeypatch):
    model = open(MODEL, encoding="utf-8").read()
    rng = random.Random(4)
    parts = ["a", "the", "don't", "1", "23", "é", "日本", "\n", "\t", " ", " ", " ", "  ", "\u3000", ".", ",", "$$", "\x00", "😀", " x", " of"]
    some = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1_500)] + ["one", "a b"]
    encoder = token_output._Encoder(model)
    want = [encoder._serialised(x.ids) for x in encoder.tokenizer.encode_batch(some, add_special_tokens=False)]
    for units, chars in ((1, 1), (300, 100), (token_output.UNIT_CHARS, token_output.CHUNK_CHARS)):
        monkeypatch.setattr(token_output, "UNIT_CHARS", units)
        monkeypatch.setattr(token_output, "CHUNK_CHARS", chars)
        assert list(token_output._Encoder(model)(some)) == want
        assert [list(token_output._Encoder(model)(x)) for x in ([], [" "], ["a b"])] == [[], *[[encoder._serialised(encoder.tokenizer.encode(t).ids)] for t in (" ", "a b")]]


def test_encoder_makes_no_object_for_a_repeated_unit():
    encoder = token_output._Encoder(open(MODEL, encoding="utf-8").read())
    text = " ".join(random.Random(5).choices([f"word{i}" for i in range(100)], k=400_000))
    tracemalloc.start()
    (ids,) = encoder([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * (len(text) + len(ids))


def test_other_tokenizers_encode_whole_texts(spark, corpus, tmp_path):
    model = public_tokenizers.path("word_bpe_49k.json")
    token_output.write_ids(table(spark, corpus[:20]), f"file://{tmp_path}/w", model, end_id=None)
    tokenizer = token_output._tokenizer(open(model, encoding="utf-8").read())
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in corpus[:20]}
    assert {r.doc_id: r.n_tokens for r in token_output.read_ids(spark, f"file://{tmp_path}/w").collect()} == want


def test_empty_tables(spark, tmp_path):
    empty = table(spark, [])
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert simhash.simhash_components(empty).count() == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert byte_bpe.digests(empty, RANKS).count() == 0
    token_output.write_ids(empty, f"file://{tmp_path}/e", MODEL)
    assert token_output.read_ids(spark, f"file://{tmp_path}/e").count() == 0


def test_repeated_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b  c d")]
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True)]
    assert {r.component_id for r in simhash.simhash_components(table(spark, rows)).collect()} == {1}
    assert byte_bpe.digests(table(spark, rows), RANKS).count() == 3
