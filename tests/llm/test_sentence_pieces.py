"""The prefix table against the sentencepiece library, and its pair test against plain merging."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tests.conftest import SMALL
from tests.llm.brute import awkward_rows, documents
from tickframe.llm import sentence_pieces as pieces
from tickframe.llm.bpe import tokenizer_path
from tickframe.llm.queries import QUERIES

ODD = [None, "", " ", "  a", "a  b", "a b ", "▁x", "a▁ b", "tab\tnew\nline", "ﬁ Å é é", "\u3000x", "x<s></s><unk><0x41>", "\0a", "👍🏽 日本語 한국어",
       " " * 5000, "a" * 3000, "ab" * 2000, "-" * 1000 + "x", "....,,,,;;;;!!!!"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.MODEL))


@pytest.fixture(scope="module")
def coder():
    return pieces.Pieces(pieces.build(tokenizer_path(pieces.MODEL)))


def runs(ids, sizes):
    ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def made_up(library, number):
    rng = random.Random(11)
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    marks = [" ", "  ", "a", "e", "▁", "\n", "日", "本", "é", "👍", ".", ",", "=", "0", "    ", "ti", "on", "в", "한", "\t"]
    for k in range(number):
        yield "".join(rng.choice(names if k % 2 else marks) for _ in range(rng.randint(1, 14)))


def test_ids_and_texts_are_those_of_the_library(spark, library, coder):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()] + ODD + list(made_up(library, 4000))
    ids, sizes = coder.encode(pa.array(texts, pa.string()))
    decoded, bounds = coder.decode(*pieces.with_end(ids, sizes, 2))
    for text, own, a, b in zip(texts, runs(ids, sizes), bounds[:-1], bounds[1:]):
        want = library.encode(text or "")
        assert own == want
        assert decoded[a:b].tobytes().decode() == library.decode(want + [2])


def test_long_words_are_walked_alike(library, coder, monkeypatch):
    monkeypatch.setattr(pieces, "_LONG", 3)
    for text in ["".join(random.Random(k).choice("abcdefghij") for _ in range(300)) for k in range(5)] + ["aaa bbb " + "n" * 50]:
        assert coder.encode(pa.array([text]))[0].tolist() == library.encode(text)


def test_any_ids_decode_as_in_the_library(library, coder):
    rng = random.Random(3)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), rng.randrange(3)]) for _ in range(rng.randint(0, 8))]
        assert coder.decode(np.array(ids, np.int64), np.array([len(ids)]))[0].tobytes().decode() == library.decode(ids)


def test_pairs_are_stable_exactly_when_merging_gives_them_back(coder):
    rng = np.random.default_rng(5)
    a, b = rng.integers(259, 3000, 3000), rng.integers(259, 3000, 3000)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.MODEL))
    names = [library.id_to_piece(i) for i in range(32000)]
    known = {n: i for i, n in enumerate(names) if i > 258}
    usable = coder.t.longest[coder.t.longest >= 0]
    for x, y, stable in zip(a, b, coder._stable(a, b)):
        if x not in usable or y not in usable:
            continue
        parts = list(names[x] + names[y])
        while True:
            found = [(coder.t.order[known[p + q]], k) for k, (p, q) in enumerate(zip(parts, parts[1:])) if p + q in known]
            if not found:
                break
            k = min(found)[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        assert stable == (parts == [names[x], names[y]]), (names[x], names[y])


def test_round_trip_of_awkward_rows(spark, library):
    got = {}
    for r in pieces.round_trip(documents(spark)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]))
    want = {}
    for doc, text in awkward_rows():
        ids = library.encode(text or "", add_eos=True)
        want.setdefault(doc, []).append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                         hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    assert pieces.round_trip(documents(spark, []).where("false")).count() == 0


def test_ids_and_texts_as_tables(spark, library):
    docs = documents(spark, [(1, "A small  test"), (2, None), (None, "é 👍")])
    encoded = pieces.encode(docs)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {
        1: library.encode("A small  test", add_eos=True), 2: [2], None: library.encode("é 👍", add_eos=True)}
    assert {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()} == {1: "A small  test", 2: "", None: "é 👍"}


def test_query_over_the_small_table(spark, library):
    rows = {r["doc_id"]: r for r in QUERIES["op13_sentencepiece"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_eos=True)
        assert rows[d["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
