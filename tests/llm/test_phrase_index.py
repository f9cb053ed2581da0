"""FM-index phrases and collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SMALL
from tests.llm.brute import awkward_rows, documents
from tests.oracle import connect, difference
from tickframe.llm import phrase_index
from tickframe.llm.queries import ORACLES, QUERIES
from tickframe.llm.words import lower, text_bytes

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_FOLD))]


def plain(rows, min_count, top, percent=80):
    """The result for rows of (text, lang)."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            counts[lang].update(tuple(words[i:i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    out = set()
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= min_count and len(p) > 1}
        found = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return out


def result(frame):
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up(number, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "old", "harbour", "é", "日本", "a\x0bb", "x", "don't", "\x00"]
    ends = [" ", " ", "  ", "\t", " ", ". ", ",", "\n", "? "]
    for _ in range(number):
        text = "".join(rng.choice(words[:rng.randint(2, 10)]) + rng.choice(ends) for _ in range(rng.randint(0, 25)))
        yield text, rng.choice(["en", "en", "en", "de", "", None, "und"])


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, n long, code long, w1 long, word string, score int"
    return spark.createDataFrame([(k % 5, t, l, 1, 2, 3, "w", 4) for k, (t, l) in enumerate(rows)], schema).repartition(4)


@pytest.mark.parametrize("min_count, top, percent", [(1, 50, 80), (3, 2000, 80), (2, 7, 100), (10**6, 5, 80)])
def test_collocations_are_those_of_plain_counting(spark, min_count, top, percent):
    rows = list(made_up(120)) + [(None, "en"), ("", "it"), (" . , ", "it"), ("Gone gone gone gone gone", "fr")]
    assert result(phrase_index.collocations(frame(spark, rows), min_count, top, percent)) == plain(rows, min_count, top, percent)


def test_small_slices_give_the_same(spark, monkeypatch):
    # Slices are cut in the workers: a local session forks them before, so the generator is tested here.
    monkeypatch.setattr(phrase_index, "_SLICE", 40)
    rows = list(made_up(60, 3)) + [("one two three. " * 50 + "four " * 100, "en")]
    batch = pa.RecordBatch.from_arrays([pa.array([l or "und" for _, l in rows]), pa.array([t for t, _ in rows])], ["lang", "text"])
    got, want = defaultdict(Counter), defaultdict(Counter)
    everything = np.full(1, ~np.uint64(0))
    parts = 0
    for data, bounds, langs in phrase_index.slices(iter([batch])):
        parts += 1
        words = phrase_index.Words(data, bounds, langs)
        text = {c: (words.names[g], words.data[a:b].tobytes().decode()) for c, a, b, g in zip(words.codes.tolist(), words.starts, words.stops, words.lang)}
        codes, sequence = words.sequence(everything)
        for found in phrase_index.enumerate_phrases(codes, sequence, {2, 3, 4}):
            for *ids, n in zip(*found.words, found.n.tolist()):
                named = [text[int(codes[i])] for i in ids]
                assert len({g for g, _ in named}) == 1
                got[named[0][0]][tuple(w for _, w in named)] += n
    for text, lang in rows:
        for words in pieces(text):
            want[lang or "und"].update(tuple(words[i:i + n]) for n in (2, 3, 4) for i in range(len(words) - n + 1))
    assert parts > 20 and got == want


def test_intervals_of_both_directions_hold_the_phrase():
    rng = np.random.default_rng(4)
    sequence = np.concatenate([[0], rng.integers(0, 5, 400), [0]])
    symbols = 5
    codes = np.arange(symbols, dtype=np.uint64)
    order = sorted(range(len(sequence)), key=lambda i: (sequence[i:i + 4].tolist(), i))
    flipped = sequence[::-1]
    back_order = sorted(range(len(sequence)), key=lambda i: (flipped[i:i + 4].tolist(), i))
    for found in phrase_index.enumerate_phrases(codes, sequence, {2, 3, 4}):
        for *ids, at, back, n in zip(*found.words, found.at, found.back, found.n):
            m = len(ids)
            assert sum(sequence[i:i + m].tolist() == ids for i in range(len(sequence))) == n
            assert all(sequence[order[k]:order[k] + m].tolist() == ids for k in range(at, at + n))
            assert all(flipped[back_order[k]:back_order[k] + m].tolist() == ids[::-1] for k in range(back, back + n))


def test_awkward_rows_and_an_empty_table(spark):
    docs = documents(spark)
    rows = [(t, "en") for _, t in awkward_rows()]
    short = [r for r in rows if len(r[0] or "") < 5000]
    assert result(phrase_index.collocations(documents(spark, [(1, t) for t, _ in short]), 2, 100)) == plain(short, 2, 100)
    assert result(phrase_index.collocations(docs, 30, 2000)) == plain(rows, 30, 2000)
    assert result(phrase_index.collocations(docs.where("false"))) == set()


def test_words_of_a_slice_are_counted():
    data, bounds = text_bytes(pa.array(["A a.b", "", "b\tC"], pa.string()))
    got = phrase_index.Words(lower(data), bounds, ["en", "en", "de"]).counts().to_pylist()
    assert {(r["lang"], r["word"]): r["n"] for r in got} == {
        ("en", "a"): 2, ("en", "b"): 1, ("en", ""): 3, ("de", "b"): 1, ("de", "c"): 1, ("de", ""): 2}


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query_matches_sql(spark, folder):
    assert difference(QUERIES["op12_collocations"](spark, folder), connect(folder), ORACLES["op12_collocations"]) is None
