"""Near-duplicates, passages, top-k search, and the pipeline."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.brute import BASE, OTHER, awkward_rows, components, documents, grams, shingle_set, words
from tickframe.llm import components as graph
from tickframe.llm import near_dups, passages, top_k
from tickframe.llm.components import connected_components


def test_components_of_random_edges(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 240)] + [(500, 500)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if x != 500 and any(x in e and e[0] != e[1] for e in edges)}


def near_copies(n, seed=1):
    """A group of near copies whose similarities lie around 0.8, and texts that share a passage with it."""
    rng = np.random.Generator(np.random.PCG64(seed))
    base = [f"w{k}" for k in range(160)]
    out = []
    for i in range(n):
        own = list(base)
        for k in rng.integers(0, 160, rng.integers(0, 6)):
            own[k] = f"c{i}_{k}"
        out.append(" ".join(own))
    return out + [" ".join(base[:60] + [f"z{i}_{k}" for k in range(100)]) for i in range(10)]


@pytest.mark.parametrize("size", [4, 5])
@pytest.mark.parametrize("limits", [{}, {"node": 12}])
def test_near_duplicates(spark, monkeypatch, size, limits):
    if limits:
        monkeypatch.setattr(near_dups, "CLUSTER", 8)
        monkeypatch.setattr(near_dups.confirm, "__defaults__", (80, 8))
    rows = awkward_rows() + [(1000 + k, t) for k, t in enumerate(near_copies(70))]
    got = near_dups.near_duplicates(documents(spark, rows), shingle=size, **limits).collect()
    sets = {}
    for k, (d, t) in enumerate(rows):
        if d is not None:
            sets[d, k] = shingle_set(t, size)
    want = components(sets, 80)
    expected = Counter((d, len(shingle_set(t, size)), None if d is None else want[d, k][0] if sets[d, k] else d) for k, (d, t) in enumerate(rows))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_deduplicated_keeps_one_of_each(spark):
    docs = documents(spark)
    out = near_dups.deduplicated(docs)
    assert out.columns == docs.columns
    got = Counter(r["doc_id"] for r in out.collect())
    sets = {(d, k): shingle_set(t, 5) for k, (d, t) in enumerate(awkward_rows()) if d is not None}
    want = components(sets, 80)
    first = {d for (d, k), s in sets.items() if not s or want[d, k][0] == d}
    assert set(got) - {None} == first and got[None] == 2 and got[1] == 1
    assert near_dups.deduplicated(documents(spark, [])).count() == 0


def test_recall_of_exact_search_on_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(documents(spark, rows), shingle=4).collect()}
    assert got == components({d: shingle_set(t, 4) for d, t in rows}, 80)


def test_repeated_passages_are_found_and_cut(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    docs = documents(spark, rows)
    found = passages.repeats(docs).collect()
    long, short = Counter(), Counter()
    for _, t in rows:
        long.update(set(grams(t, 51)))
        short.update(set(grams(t, passages.SENTENCE_WORDS)))
    with_passage = {d for d, t in rows if any(long[g] > 1 for g in grams(t, 51))}
    clean = {d for d, t in rows if not any(short[g] > 1 for g in grams(t, passages.SENTENCE_WORDS))}
    assert with_passage and with_passage <= {r["doc_id"] for r in found}
    assert not clean & {r["doc_id"] for r in found}
    firsts = Counter((r["class_doc_id"], r["class_start"]) for r in found if not r["removed"])
    assert all(r["removed"] == ((r["doc_id"], r["start_byte"]) != (r["class_doc_id"], r["class_start"])) for r in found) and firsts
    after = Counter()
    for r in passages.removed(docs).collect():
        after.update(set(grams(r["text"], 51)))
    assert sum(v > 1 for v in after.values()) < 0.02 * sum(v > 1 for v in long.values())


def test_near_equal_paragraphs(spark):
    line = " ".join(f"w{k}" for k in range(80))
    rows = [(1, "head\n" + line), (2, line.replace("w40", "other") + "\ntail of it"), (3, line.replace("w5 ", "p q ")),
            (4, " ".join(f"w{k}" if k < 40 else f"u{k}" for k in range(80))), (None, line), (5, None), (6, ""), (7, line)]
    # Two changes leave 66 of 86 shingles in common with the line, below 0.8, and fewer with the others.
    rows.append((8, line.replace("w20", "q").replace("w70", "r")))
    found = {(r["doc_id"], r["removed"]) for r in passages.repeats(documents(spark, rows)).collect()}
    assert found == {(1, False), (2, True), (3, True), (7, True)}
    left = {(r["doc_id"], r["text"]) for r in passages.removed(documents(spark, rows)).collect()}
    assert left == {(1, "head\n" + line), (2, "tail of it"), (4, rows[3][1]), (None, line), (5, None), (6, ""), (8, rows[-1][1])}


def test_passages_of_awkward_rows(spark):
    docs = documents(spark)
    out = passages.removed(docs)
    assert out.columns == docs.columns
    texts = {}
    for r in out.collect():
        texts.setdefault(r["doc_id"], r["text"])
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    # One word makes document 3's line differ in 10 of 42 shingles, too many for a link; its two equal sentences go.
    assert texts[3] == "Boats rocked slowly against the worn stone pier while gulls cried."
    assert texts[1] == BASE and texts[5] is None and texts[6] == ""
    assert passages.repeats(documents(spark, [])).count() == 0 and passages.removed(documents(spark, [])).count() == 0


def test_a_row_loses_only_its_own_passages(spark):
    extra = OTHER + " And this text repeats nothing that any other document has in it at all."
    rows = [(1, BASE), (2, BASE), (2, BASE), (2, extra), (3, "x y z\n" + BASE + "\nlast line"), (4, None)]
    left = Counter((r["doc_id"], r["text"]) for r in passages.removed(documents(spark, rows)).collect())
    assert left == Counter([(1, BASE), (2, extra), (3, "x y z\nlast line"), (4, None)])


def test_what_is_cut_leaves_no_blanks_at_line_ends():
    assert passages.without("one two. three. four", [(9, 16)]) == "one two. four"
    assert passages.without("one. two\nthree", [(5, 8)]) == "one.\nthree"
    assert passages.without("one. two", [(0, 5)]) == "two" and passages.without("a b", [(0, 3)]) == ""
    assert passages.without("keep  this \n gone", [(13, 17)]) == "keep  this "


def test_columns_of_any_name_are_carried_along(spark):
    names = ["_id", "_spans", "_vertex", "_gone", "_its", "doc", "own", "spans", "vertex", "lost", "its", "Text_Hash", "component", "key"]
    docs = documents(spark, [(1, BASE), (2, BASE), (3, OTHER), (None, BASE)])
    docs = docs.select("doc_id", "text", *[F.lit(f"v{k}").alias(n) for k, n in enumerate(names)])
    for out in (near_dups.deduplicated(docs), passages.removed(docs)):
        got = out.collect()
        assert out.columns == docs.columns and sorted(r["doc_id"] or 0 for r in got) == [0, 1, 3]
        assert all(r[n] == f"v{k}" for r in got for k, n in enumerate(names))


@pytest.mark.parametrize("copies, node", [(300, 12), (1600, 64)])
def test_dense_groups_lose_no_link(spark, copies, node):
    """Far more near copies than a node holds: the same components as without any node limit."""
    rows = [(k, t) for k, t in enumerate(near_copies(copies, 3))]
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(documents(spark, rows), shingle=4, node=node).collect()}
    items = {}
    sets = [np.array(sorted(items.setdefault(s, len(items)) for s in shingle_set(t, 4)), np.uint64) for _, t in rows]
    labels = near_dups.confirmed_labels(sets, 80)
    first = {}
    for k, label in enumerate(labels.tolist()):
        first.setdefault(label, k)
    assert got == {k: first[label] for k, label in enumerate(labels.tolist())}


def plain_bm25(rows, query, k):
    docs = [(d, Counter(words(t))) for d, t in rows]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    q, own = query
    out = []
    for d, c in docs:
        if d is None or d == q:
            continue
        norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in set(words(own)) if w in c)
        if s > 0:
            out.append((s, d))
    return sorted(out, key=lambda x: (-x[0], x[1]))[:k]


@pytest.mark.parametrize("block", [64, 4])
def test_top_k(spark, monkeypatch, block):
    small = [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(150).collect()]
    rows = awkward_rows() + small
    asked = [r for r in rows if r[0] is not None and r[0] % 5 == 0] + [(None, BASE)]
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "QUERIES", 9)
    got = {}
    for r in top_k.search(documents(spark, rows), documents(spark, asked), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["doc_id"]))
    for q, t in asked:
        if q is None:
            continue
        want, own = plain_bm25(rows, (q, t), 5), sorted(got.get(q, []))
        assert [round(s, 6) for _, s, _ in own] == [round(s, 6) for s, _ in want]
        assert [r for r, _, _ in own] == list(range(1, len(want) + 1))
    assert None not in got and top_k.search(documents(spark, []), documents(spark, [])).count() == 0


@pytest.mark.parametrize("common, posting, long", [(0.0, 1 << 40, 1), (0.08, 90, 24), (0.3, 0, 3), (2.0, 90, 1 << 40)])
def test_products_and_postings_score_alike(monkeypatch, common, posting, long):
    """Whether a term is a row of the matrix or a run of postings, and in whatever shard, the exact scores agree."""
    monkeypatch.setattr(top_k, "COMMON", common)
    monkeypatch.setattr(top_k, "POSTING", posting)
    monkeypatch.setattr(top_k, "LONG", long)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(w)}" for w in rng.zipf(1.3, rng.integers(0, 60)) if w < 400)) for i in range(900)]
    rows += [(i + 900, t) for i, t in rows[:40]]  # equal texts in the second shard
    mean, n = sum(len(t.split()) for _, t in rows) / len(rows), len(rows)

    def cut(part):
        terms, tf, number, length = top_k._terms(pa.array([t for _, t in part]))
        return np.array([i for i, _ in part]), terms, tf, number, length

    found, at = np.unique(cut(rows)[1], return_counts=True)
    asked = []
    for i, t in rows[::5]:
        terms = top_k._terms(pa.array([t]))[0]
        counts = at[np.searchsorted(found, terms)]
        asked.append({"query_id": i, "terms": terms.tobytes(), "weights": np.log(1 + (n - counts + 0.5) / (counts + 0.5)).tobytes()})
    asked = top_k.Asked(asked)
    best = [[] for _ in asked.ids]
    for part in (rows[:120], rows[120:]):
        shard = top_k.Shard([top_k._row(*cut(some)).to_pylist()[0] for some in (part[:50], part[50:70], part[70:]) if some], mean, asked)
        for a in range(0, len(best), 7):
            shard.search(asked, range(a, min(a + 7, len(best))), 10, best)
    text = dict(rows)
    for q, held in zip(asked.ids.tolist(), best):
        want = plain_bm25(rows, (q, text[q]), 10)
        assert [round(-s, 6) for s, _ in held] == [round(s, 6) for s, _ in want]
        assert held == sorted(held)
        same = {}
        for s, i in held:
            same.setdefault(text[i], set()).add(s)
        assert all(len(scores) == 1 for scores in same.values())


def test_frequencies_come_from_the_index(spark, monkeypatch):
    """The texts are cut into words once; what counts documents reads the written index."""
    plans = {}

    def keep(df, name, real=top_k.written):
        plans[name] = df._jdf.queryExecution().toString()
        return real(df, name)

    monkeypatch.setattr(top_k, "written", keep)
    rows = [(i, f"a b{i % 3} c{i}") for i in range(40)]
    assert top_k.search(documents(spark, rows), documents(spark, rows[:4])).count() == 40
    assert "llm-index" in plans["queries"]


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
            kept = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in docs.collect()} == kept
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    bad = [d for d in kept if d in labels and labels[d]["quality"] == 0]
    assert len(bad) <= 0.1 * sum(r["quality"] == 0 for r in labels.values())


def test_sizes_of_clusters_are_counted_without_their_sets(spark, monkeypatch, tmp_path):
    """Large clusters: a written table needs no shuffle of the sets to know the size of their cluster, and no text is shuffled."""
    plans = {}

    def keep(df, name, real=near_dups.written):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(near_dups, "written", keep)
    monkeypatch.setattr(near_dups.confirm, "__defaults__", (80, 8))
    copies = [(k, t) for k, t in enumerate(near_copies(30))]
    docs = documents(spark, copies)
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs, shingle=4).collect()}
    assert got == components({d: shingle_set(t, 4) for d, t in copies}, 80)
    assert "Aggregate" not in plans["links"] and "Join" not in plans["links"]
    assert plans["star"].count("Join") == 1
    joined = plans["sets"][:plans["sets"].index("MapInArrow")]
    assert "text" not in joined


@pytest.mark.parametrize("share", [1 << 20, 40, 3])
def test_components_of_shares_of_edges(spark, monkeypatch, share):
    """Long paths and a hub: one share settles in one task without rounds, several go on with stars; the components are the same."""
    written = []
    monkeypatch.setattr(graph, "written", lambda df, name, real=graph.written: written.append(name) or real(df, name))
    edges = [(k, k + 1) for k in range(0, 60)] + [(k, 900 - k) for k in range(300, 340)] + [(777, k) for k in range(1000, 1050)] + [(5, 5)]
    want = {}
    for part in (range(0, 61), [777, *range(1000, 1050)]):
        want |= {x: min(part) for x in part}
    for k in range(300, 340):
        want |= {k: k, 900 - k: k}
    table = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["vertex"]: r["component"] for r in graph.connected_components(table, share=share).collect()}
    assert got == want
    assert (len(written) == 2) == (share == 1 << 20)
    assert graph.connected_components(table.where("a = b"), share=share).count() == 0


def test_small_tables_are_written_in_few_files(spark, monkeypatch):
    """With many shuffle partitions and no merging of small ones, a hundred documents do not make a file for each."""
    files = {}

    def keep(df, name, real=near_dups.written):
        out = real(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    for module in (near_dups, graph):
        monkeypatch.setattr(module, "written", keep)
    docs = [(k, t) for k, t in enumerate(near_copies(60))]
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(documents(spark, docs).repartition(2), shingle=4).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == components({d: shingle_set(t, 4) for d, t in docs}, 80)
    assert max(files.values()) <= 2, files
