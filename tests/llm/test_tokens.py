"""Tokenisation, packing, chunk reuse and token files against the tokenizers library."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SMALL
from tests.llm.brute import awkward_rows, documents
from tickframe.llm import bpe, bpe_chunks, packing, token_files

ODD = ["", "a", "a  b", "a \n b", "\na", "a\n", "a \n \n b", "a\n \nb", "x<|endoftext|>y <|endoftext|> z", "It's we'll DON'T'S", " x y", "   ",
       "\n\n\n", "\0abc \0 d", "don’t!!! ***x*** ###", "ÀÉ,. Öß; ÿ×÷", "Ⅷ ½ ²", "a\tb\r\nc", "é ñ", "ab" * 3000, None]


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()] + ODD


def library(name, text):
    return bpe.load(bpe.tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [bpe.WORD, bpe.BYTE])
def test_encoder_agrees_with_the_library(texts, name):
    plain = bpe.load(bpe.tokenizer_path(name))
    for _ in range(2):  # the second time from the cache
        ids, sizes = bpe.encoder(name).encode(texts)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for i, text in enumerate(texts):
            assert plain.encode(text or "", add_special_tokens=False).ids == ids[ends[i]:ends[i + 1]].tolist()


@pytest.mark.parametrize("mask", [1, 31, 255])
def test_chunks_agree_with_the_library(texts, mask):
    plain = bpe.load(bpe.tokenizer_path(bpe.WORD))
    encoder = bpe_chunks.ChunkEncoder(bpe.WORD, mask)
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for i, text in enumerate(texts):
        assert plain.encode(text or "", add_special_tokens=False).ids == ids[ends[i]:ends[i + 1]].tolist()


def test_equal_passages_share_chunks():
    passage = " ".join(f"word{i}" for i in range(400))
    column = pa.array([passage, "something before " + passage])
    data, bounds = bpe_chunks.text_bytes(column)
    edges = np.append(bpe_chunks.cuts(data, bounds), len(data))
    chunks = [data[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
    assert len(set(chunks)) <= len(chunks) // 2 + 2


def test_round_trip(spark):
    plain = bpe.load(bpe.tokenizer_path(bpe.WORD))
    got = Counter(map(tuple, bpe_chunks.round_trip(documents(spark)).collect()))
    want = Counter()
    for doc_id, text in awkward_rows():
        ids = plain.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want


@pytest.mark.parametrize("size,windows,cut", [(2048, 64, 32), (64, 2, 8), (16, 1, 1)])
def test_pack(spark, size, windows, cut):
    pieces = packing.pack(documents(spark), size=size, open_windows=windows, least_cut=cut, merged=2).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append(p)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    want = defaultdict(list)
    for doc_id, text in awkward_rows():
        want[doc_id].append(library(bpe.WORD, text) + [packing.END_ID])
    assert set(by_doc) == set(want)
    for doc_id, texts_ in want.items():
        assert sum(p["length"] for p in by_doc[doc_id]) == sum(map(len, texts_))
        crcs = {(a, n): zlib.crc32(np.array(ids[a:a + n], "<u4").tobytes()) for ids in texts_ for p in by_doc[doc_id]
                for a, n in [(p["start"], p["length"])] if len(ids) == p["doc_tokens"]}
        if len(texts_) == 1:
            assert all(crcs[p["start"], p["length"]] == p["ids_crc32"] for p in by_doc[doc_id])
            assert sorted((p["start"], p["length"]) for p in by_doc[doc_id])[0][0] == 0


def test_pack_pads_little(spark):
    pieces = packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet")).groupBy("sequence_id").sum("length").collect()
    used = [r[1] for r in pieces]
    assert sum(used) / (2048 * len(used)) > 0.95


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.Generator(np.random.PCG64(3))
    import heapq
    for n in (1, 2, 3, 50, 700):
        counts = np.floor(rng.pareto(0.7, n) * 5).astype(np.int64) + 1
        lengths = token_files.code_lengths(counts, 40)
        heap = [(int(c), k, 0) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        total, k = 0, n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            total += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], k, 0))
            k += 1
        if n > 1:
            assert int((counts * lengths).sum()) == total
            assert abs(sum(2.0 ** -lengths) - 1) < 1e-12
        short = token_files.code_lengths(counts, 11)
        assert short.max() <= 11 and sum(2.0 ** -short[short > 0]) <= 1 + 1e-12


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_bits_come_back(n):
    rng = np.random.Generator(np.random.PCG64(n))
    ids = (rng.pareto(0.5, n) % 900).astype(np.int64)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=900), 12)
    packed = token_files.pack_bits(ids, token_files.canonical_codes(lengths), lengths, 128)
    assert token_files.unpack_bits(*packed, n, 128, token_files.decoding_table(lengths)).tolist() == ids.tolist()


def test_token_files(spark):
    got = token_files.round_trip(documents(spark), block_ids=50, step=7, file_ids=400).collect()
    rows = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
    assert keys == sorted(keys)
    want = Counter((d, zlib.crc32(np.array(library(bpe.BYTE, t) + [0], "<u4").tobytes())) for d, t in awkward_rows())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == want


@pytest.mark.parametrize("operator", [packing.pack, bpe_chunks.round_trip, token_files.round_trip])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).count() == 0


def test_caches_of_encoders_are_given_back():
    """Tasks after the encoding hold no pieces; what is encoded later is the same."""
    own = bpe.encoder(bpe.BYTE)
    before = own.encode(["some words of a text, and more words"])[0].tolist()
    assert len(own.hashes) > 0
    bpe.release_all()
    assert not len(own.hashes) and own.cached_bytes() < 1000
    assert own.encode(["some words of a text, and more words"])[0].tolist() == before
