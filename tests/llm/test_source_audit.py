"""Sorted term pointers and source distances against plain counting."""

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
from tickframe.llm import source_audit
from tickframe.llm.queries import ORACLES, QUERIES
from tickframe.llm.words import lower, text_bytes

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return _TERM.findall((text or "").translate(_FOLD))


def plain(rows, min_docs, top):
    """The result for rows of (text, lang, source)."""
    docs, counts, groups = defaultdict(int), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in set(terms_of(text)):
            docs[lang, t] += 1
        counts[lang, source].update(terms_of(text))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for (l, t), n in docs.items() if l == lang and n >= min_docs)

        def shares(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            more = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", more, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])}
    return out


def result(frame):
    rows = [tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up(number, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "straße", "日本語", "eightlet", "eightlett", "eightletters", "eightlettersandmore", "eightlettersandmuchmore", "x", "Ω"]
    for _ in range(number):
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), ("en", "c"), ("de", "a"), ("de", None), (None, "b"), (None, None)])
        yield rng.choice([" ", "-", "1"]).join(rng.choice(words) for _ in range(rng.randint(0, 12))), lang, source


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string, term string, n long, place int, p string, bucket string"
    return spark.createDataFrame([(k % 7, t, l, s, "t", 1, 1, "p", "b") for k, (t, l, s) in enumerate(rows)], schema).repartition(3)


@pytest.mark.parametrize("min_docs", [1, 6, 1000])
def test_audit_is_that_of_plain_counting(spark, min_docs):
    rows = list(made_up(150)) + [(None, "en", "d"), ("", "it", "only"), ("1 2 3 --", "fr", "x"), ("...", "fr", "y")]
    assert result(source_audit.audit(frame(spark, rows), min_docs, 4)) == plain(rows, min_docs, 4)


@pytest.mark.parametrize("tile", [1, 2, 3])
def test_tiles_and_blocks_do_not_change_distances(spark, monkeypatch, tile):
    monkeypatch.setattr(source_audit, "_TILE", tile)
    monkeypatch.setattr(source_audit, "_ROWS", 3)
    monkeypatch.setattr(source_audit, "_CELLS", 6)
    rows = [(t, "en", f"s{k % 7}") for k, (t, _, _) in enumerate(made_up(120, 4))]
    counts = source_audit.audit(frame(spark, rows), 3, 2)
    assert result(counts) == plain(rows, 3, 2)


def test_sorted_pointers():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab", "abcdefgh", "é", " ", "z", "\0"]) for _ in range(rng.randint(0, 9))) for _ in range(500)] + ["", "Word"]
    data, bounds = text_bytes(pa.array(texts, pa.string()))
    data = lower(data)
    starts, sizes, doc = source_audit.term_pointers(data, bounds)
    found = [(d, data[a:a + n].tobytes().decode()) for a, n, d in zip(starts, sizes, doc)]
    assert found == [(d, t) for d, text in enumerate(texts) for t in terms_of(text)]
    order, heads = source_audit.multikey_sort(data, starts, sizes)
    sorted_terms = [found[i][1].encode() for i in order]
    assert sorted_terms == sorted(sorted_terms)
    assert heads.tolist() == [k == 0 or a != sorted_terms[k - 1] for k, a in enumerate(sorted_terms)]
    assert source_audit.multikey_sort(data[:0], starts[:0], sizes[:0])[0].size == 0


def test_awkward_rows_and_an_empty_table(spark):
    docs = documents(spark)
    assert result(source_audit.audit(docs, 2, 50)) == plain([(t, "en", "s") for _, t in awkward_rows()], 2, 50)
    empty = source_audit.audit(docs.where("false"))
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"] and empty.count() == 0
    texts = [("word " * 200_000 + "x" * 100_000, "en", "a"), ("word", "en", "b")]
    assert result(source_audit.audit(frame(spark, texts), 1, 3)) == plain(texts, 1, 3)


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.range(1).select(source_audit._share("9000000000000000", "9100000000000007L").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (9000000000000000 + 5) // 9100000000000007


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query_matches_sql(spark, folder):
    assert difference(QUERIES["op11_source_audit"](spark, folder), connect(folder), ORACLES["op11_source_audit"]) is None
