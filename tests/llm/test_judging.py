"""Quality rules, url filter, classifier and language model."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm.brute import awkward_rows, documents, words
from tests.oracle import connect, difference
from tickframe.llm import classifier, katz, quality_rules, url_filter
from tickframe.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SMALL), duck, ORACLES[name]) is None


def measured(text):
    text = text or ""
    w = words(text, lower=False)
    wins = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    n = Counter(wins)
    repeat = {k + j for k, win in enumerate(wins) if n[win] > 1 for j in range(5)}
    lines = [s for s in text.split("\n") if words(s)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat))


def test_ledger_of_awkward_rows(spark):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter(map(tuple, quality_rules.ledger(documents(spark)).select(*columns).collect()))
    assert got == Counter((d, *measured(t)) for d, t in awkward_rows())


def test_policies_and_ablation(spark):
    rows = quality_rules.ledger(documents(spark))
    judged = quality_rules.apply_policy(rows).collect()
    for r in judged:
        base = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == base and (not r["kept"] or not base)
    bits = Counter(r["failed_rules"] for r in judged)
    for r in quality_rules.ablation(rows).collect():
        bit = 1 << [n for n, _ in quality_rules.RULES].index(r["rule"])
        assert r["rejected"] == sum(c for b, c in bits.items() if b & bit)
        assert r["alone"] == sum(c for b, c in bits.items() if b & quality_rules.mask(r["policy"]) == bit)


def test_accepted_keeps_columns(spark):
    docs = documents(spark)
    out = quality_rules.accepted(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} >= {1, 2, 4}
    assert quality_rules.accepted(documents(spark, [])).count() == 0


def plain_match(rules, url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), verdict == "block", rule, verdict))
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_filter(spark):
    rules = url_filter.RULES + [("block", "net"), ("allow", "a.net/x/y"), ("block", "a.net/x/"), ("allow", "b.net/q"), ("block", "b.net/q"),
                                ("allow", "b.net/q/"), ("block", "c.com/a//b")]
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/en/12", "https://m.example.org/es/", "http://example.org/es", "http://xexample.org/es/1",
            "http://a.net", "http://a.net/x/yz", "http://a.net/x/", "http://a.net/x?y=/z", "ftp://s.b.net/q", "http://b.net/q/r", "http://b.net/qq#f",
            "http://com/fr/", "http://z.com/de/a", "a://b://c.com/de/", "http://c.com/a//bb", "http://É.org/", "http://org", "http://b.net//q"] * 2
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: plain_match(rules, u) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_filter_refuses_large_lists(monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_RULE_BYTES", 10)
    with pytest.raises(ValueError):
        url_filter.build([("allow", "a" * 20)])


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    network = classifier.fit(docs, labels)
    rows = classifier.score(docs, network).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9


def test_classifier_takes_awkward_rows(spark):
    network = classifier.train([("good words here and there " * 9, 1), ("### $$$ *** " * 20, 0)] * 20, epochs=2)
    rows = classifier.score(documents(spark), network).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in awkward_rows())
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert classifier.score(documents(spark, []), network).count() == 0
    out = classifier.accepted(documents(spark), network)
    assert out.columns == documents(spark).columns
    only = classifier.train([("x", 1)])
    assert all(r["predicted"] == 1 for r in classifier.score(documents(spark), only).collect())


def test_chunks_cover_every_byte():
    for size in (0, 1, 511, 512, 513, 960, 961, 5000):
        starts = classifier.chunk_starts(size)
        covered = np.zeros(max(size, 1), bool)
        for s in starts:
            covered[s:s + classifier.CHUNK] = True
        assert covered[:size].all() and (starts >= 0).all()
        assert len(starts) == (1 if size <= 512 else -(-(size - 512) // 448) + 1)


def plain_katz(rows, share, modulus=5, held=1):
    """The model by dictionaries: a function (history, word) -> probability, and its symbols."""
    train = [(d is None or zlib.crc32(str(d).encode()) % modulus != held) for d, _ in rows]
    count = Counter(w for (_, t), use in zip(rows, train) if use for w in words(t))
    texts, tokens = sum(train), sum(count.values())
    total = tokens + texts
    frequent = {w for w, c in count.items() if c >= max(1.0, share * total)}
    symbol = lambda w: w if w in frequent else "RARE"
    uni = Counter({w: count[w] for w in frequent})
    rare = tokens - sum(uni.values())
    uni["RARE"], uni["END"], uni["NEVER"] = rare, texts, 0
    lower = {s: (c + 0.5) / (total + 0.5 * len(uni)) for s, c in uni.items()}
    pairs, history = defaultdict(Counter), Counter()
    for (_, t), use in zip(rows, train):
        if use:
            row = ["START", *map(symbol, words(t)), "END"]
            for a, b in zip(row[:-1], row[1:]):
                pairs[a][b] += 1
                history[a] += 1
    low = np.bincount([c for p in pairs.values() for c in p.values() if c <= 6], minlength=7)
    d = katz.discounts(low)
    rare_low = np.bincount([c for w, c in count.items() if w not in frequent and c <= 6], minlength=7)
    r = katz.discounts(rare_low)
    factor = lambda f, c: f[c] if c <= 5 else 1.0

    def pair(h, w):
        if h not in pairs:
            return lower[w]
        c = pairs[h]
        if c[w]:
            return factor(d, c[w]) * c[w] / (history[h] + 1)
        left = 1 - sum(factor(d, n) * n for n in c.values()) / (history[h] + 1)
        return left / (1 - sum(lower[x] for x in c if c[x])) * lower[w]

    def inside(w):
        if count[w]:
            return factor(r, count[w]) * count[w] / (rare + 1)
        return 1 - sum(factor(r, c) * c for x, c in count.items() if x not in frequent) / (rare + 1)

    return count, texts, total, frequent, symbol, pair, inside, list(uni), list(pairs)


@pytest.mark.parametrize("share", [1e-5, 0.004, 0.2])
def test_katz(spark, share):
    small = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()
    rows = awkward_rows() + [(r["doc_id"] + 100, r["text"]) for r in small]
    count, texts, total, frequent, symbol, pair, inside, symbols, histories = plain_katz(rows, share)
    for h in histories[:40] + ["RARE"]:
        assert abs(sum(pair(h, s) for s in symbols) - 1) < 1e-9
    if frequent != set(count):
        assert abs(sum(inside(w) for w in count if w not in frequent) + inside("\0none") - 1) < 1e-9
    got = defaultdict(list)
    for r in katz.score(documents(spark, rows), share=share).collect():
        got[r["doc_id"]].append(r)
    for d, t in rows:
        w = words(t)
        row = ["START", *map(symbol, w), "END"]
        score = sum(math.log10(pair(a, b)) for a, b in zip(row[:-1], row[1:])) + sum(math.log10(inside(x)) for x in w if x not in frequent)
        known = sum(count[x] > 0 for x in w) + (texts > 0)
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (len(count) + 1 + 1))) for c in [*(count[x] for x in w), texts])
        assert any(math.isclose(r["score"], score, rel_tol=1e-9) and math.isclose(r["base_score"], base, rel_tol=1e-9)
                   and r["n_tokens"] == len(w) + 1 and r["n_known"] == known and r["train_tokens"] == total for r in got[d])
    assert sum(map(len, got.values())) == len(rows)


@pytest.mark.parametrize("symbol_share", [1e-5, 0.004, 0.2])
def test_katz_counts_the_pairs_of_all_words(spark, symbol_share):
    """Whatever the share from which on words are broadcast, the model is that without a shared symbol."""
    small = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()
    rows = awkward_rows() + [(r["doc_id"] + 100, r["text"]) for r in small]
    count, texts, total, _, _, pair, _, symbols, histories = plain_katz(rows, 0)
    for h in histories[:40]:
        assert abs(sum(pair(h, s) for s in symbols) - 1) < 1e-9
    got = defaultdict(list)
    for r in katz.score(documents(spark, rows), symbol_share=symbol_share).collect():
        got[r["doc_id"]].append(r)
    for d, t in rows:
        row = ["START", *[w if count[w] else "RARE" for w in words(t)], "END"]
        score = sum(math.log10(pair(a, b)) for a, b in zip(row[:-1], row[1:]))
        known = sum(count[x] > 0 for x in words(t)) + (texts > 0)
        assert any(math.isclose(r["score"], score, rel_tol=1e-9) and r["n_known"] == known and r["train_tokens"] == total for r in got[d])
    assert sum(map(len, got.values())) == len(rows)


def test_katz_of_nothing(spark):
    assert katz.score(documents(spark, [])).count() == 0
    only = katz.score(documents(spark, [(1, None)])).collect()
    assert len(only) == 1 and only[0]["n_tokens"] == 1 and only[0]["score"] <= 0


def test_answers_of_a_bucket_go_in_small_batches():
    """All rows arrive in their order, and no batch holds much more than the bytes asked for."""
    rows = [katz._row(katz._PAIR, k, b"d" * 100, b"s" * 200) for k in range(50)]
    out = list(katz._packed(iter(rows), 1000))
    assert [r for b in out for r in b.to_pylist()] == rows
    assert len(out) > 10 and all(b.num_rows <= 4 for b in out)
    assert not list(katz._packed(iter([])))


def test_number_of_buckets_changes_no_score(spark, monkeypatch):
    docs = documents(spark, awkward_rows() + [(2000 + k, f"a b c{k % 7} d{k} a b") for k in range(60)])
    few = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.score(docs).collect())
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 20)
    many = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.score(docs).collect())
    assert few == many
