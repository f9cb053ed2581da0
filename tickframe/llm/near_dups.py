"""Near-duplicate documents by a chosen-path set similarity join.

1. Every document becomes the set of its word shingles; documents with equal sets are one vertex.
2. Every tree sends each vertex down a path of minwise tokens, selected per tree. A node holds the
   vertices with one path. Small nodes are compared exhaustively by signatures; large ones branch
   once more, by several further tokens, and what stays large is compared exhaustively in blocks, after
   one anchor has settled those like it. A node yields a spanning forest of the similar pairs, not the pairs.
3. The union of all trees splits the vertices into clusters that hold every link the trees
   recalled, and more. Inside a cluster, links are confirmed on full sets.

The ``TREES`` trees choose ``DEPTH`` tokens each among the same ``FUNCTIONS`` functions. Over the binomial number
of functions on which a pair of similarity 0.8 agrees, it shares no node of any tree with a probability
of 1e-5, and 2e-4 if all its nodes are large and branch. A group of copies is held together by many pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tickframe.llm import words
from tickframe.llm.components import connected_components
from tickframe.llm.key_filter import key_bitmap, may_match
from tickframe.llm.tables import batches_of, binary, dealt, lists, map_arrow, tasks_for, texts, unused_names, written

SHINGLE = 5
PERCENT = 80
FUNCTIONS = 64
TREES = 24
DEPTH = 3
BRANCHES = 3  # children that a large node's vertices go to
NODE = 512  # vertices compared exhaustively
LEVELS = 4
CLUSTER = 256  # vertices whose sets are compared in one task
# Signatures that agree on less than this share are not similar: eight standard deviations below 0.8 of
# 64 functions would be 0.4; a pair is met in many trees but always with the same signatures.
LEAST_AGREEING = 0.5
_BATCH = 1 << 20
_COLUMNS = 4096

_RANDOM = np.random.Generator(np.random.PCG64(987654321))
_FACTORS = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def distinct_sets(hashes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values of each run of ``hashes``, in a row, and their number per run."""
    owner = np.repeat(np.arange(len(number)), number)
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order].astype(np.uint16) if len(number) < 1 << 16 else owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
        hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.bincount(owner, minlength=len(number)).astype(np.int64)


def shingle_sets(texts_column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each text, in a row, and their number per text."""
    data, bounds = words.text_bytes(texts_column)
    data = words.lower(data)
    starts, ends = words.spans(data, bounds)
    return distinct_sets(*words.shingles(words.hash_spans(data, starts, ends), words.counts_per_text(starts, bounds), size))


def vertex_of(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, equal for equal sets."""
    out = np.zeros(len(sizes), np.uint64)
    filled = sizes > 0
    if filled.any():
        first = (np.cumsum(sizes) - sizes)[filled]
        with np.errstate(over="ignore"):
            out[filled] = words.mix(np.add.reduceat(words.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), first))
    return out.view(np.int64)


def signatures(sets: np.ndarray, sizes: np.ndarray, functions: int) -> np.ndarray:
    """Minwise hashes in 16 bits, one row per set; empty sets have zeros.

    Equal minima stay equal; different ones agree with a chance of 2**-16, which only adds candidates.
    """
    out = np.zeros((len(sizes), functions), np.uint16)
    filled = sizes > 0
    if filled.any():
        first = (np.cumsum(sizes) - sizes)[filled]
        with np.errstate(over="ignore"):
            for j in range(functions):
                least = np.minimum.reduceat(((sets * _FACTORS[j]) >> np.uint64(32)).astype(np.uint32), first)
                out[filled, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def signed(docs: DataFrame, shingle: int, functions: int = FUNCTIONS) -> DataFrame:
    """``doc_id, n_shingles, vertex, signature``; ``vertex`` is null for texts without words and null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, _BATCH):
            sets, sizes = shingle_sets(batch.column("text"), shingle)
            none = (sizes == 0) | batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            marks = signatures(sets, sizes, functions)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(vertex_of(sets, sizes), mask=none),
                 lists(marks.ravel(), np.full(len(sizes), functions))], ["doc_id", "n_shingles", "vertex", "signature"])

    return map_arrow(texts(docs), run, "doc_id long, n_shingles long, vertex long, signature binary")


def _paths(marks: np.ndarray, node: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """Child nodes: the node's name extended by ``depth`` tokens that ``tree`` selects."""
    chosen = np.random.Generator(np.random.PCG64(tree)).permutation(marks.shape[1])[:depth]
    with np.errstate(over="ignore"):
        for c in chosen:
            node = words.mix(node * np.uint64(0x9E3779B97F4A7C15) + (marks[:, c].astype(np.uint64) | np.uint64(int(c) + 1) << np.uint64(32)))
    return node


def _nodes(vertices: DataFrame, functions: int, trees: int, depth: int) -> DataFrame:
    """``node, vertex``: ``trees`` rows per vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = binary(batch.column("signature"), np.uint16)[0].reshape(-1, functions)
            ids = batch.column("vertex").to_numpy()
            keys = np.stack([_paths(marks, np.full(len(ids), t + 1, np.uint64), t + 1, depth) for t in range(trees)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(ids, trees))], ["node", "vertex"])

    return map_arrow(vertices.select("vertex", "signature"), run, "node long, vertex long")


def _branched(large: DataFrame, functions: int, branches: int, depth: int = DEPTH) -> DataFrame:
    """Members of large nodes (``node, vertex, signature``) in their child nodes.

    Every node selects functions of its own: were they the same in all trees, a vertex whose tokens there
    are its own would be alone in every one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = binary(batch.column("signature"), np.uint16)[0].reshape(-1, functions)
            ids, parent = batch.column("vertex").to_numpy(), batch.column("node").to_numpy().view(np.uint64)
            row, keys = np.arange(len(ids)), []
            for branch in range(branches):
                node = words.mix(parent ^ np.uint64(branch + 1))
                for level in range(depth):
                    chosen = words.mix(parent ^ np.uint64(branch << 8 | level + 1 << 16)) % np.uint64(functions)
                    token = marks[row, chosen.astype(np.int64)].astype(np.uint64) | chosen + np.uint64(1) << np.uint64(32)
                    with np.errstate(over="ignore"):
                        node = words.mix(node * np.uint64(0x9E3779B97F4A7C15) + token)
                keys.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, branches))], ["node", "vertex"])

    return map_arrow(large.select("node", "vertex", "signature"), run, "node long, vertex long")


def _nibbles(marks: np.ndarray) -> np.ndarray:
    """The low four bits of every mark, two to a byte: enough to tell that two signatures differ widely."""
    low = (marks & np.uint16(15)).astype(np.uint8)
    return low[:, 0::2] | low[:, 1::2] << 4


def _unpacked(packed: np.ndarray) -> np.ndarray:
    return np.concatenate([packed & 15, packed >> 4], axis=1)


def _short(vertices: DataFrame, functions: int) -> DataFrame:
    """``vertex, marks``: signatures cut to four bits a function, which the members of nodes carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = binary(batch.column("signature"), np.uint16)[0].reshape(-1, functions)
            packed = _nibbles(marks)
            yield pa.RecordBatch.from_arrays([batch.column("vertex"), lists(packed.ravel(), np.full(len(packed), packed.shape[1]))],
                                             ["vertex", "marks"])

    return map_arrow(vertices.select("vertex", "signature"), run, "vertex long, marks binary")


def similar_forest(marks: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose signatures agree on ``least`` of the functions.

    All pairs are considered; those that earlier ones have joined are not compared.
    """
    labels, out = np.arange(len(marks)), []
    for a in range(len(marks) - 1):
        rest = np.flatnonzero(labels[a + 1:] != labels[a]) + a + 1
        if not len(rest):
            continue
        for b in rest[(marks[rest] == marks[a]).mean(axis=1) >= least].tolist():
            if labels[b] != labels[a]:
                out.append((a, b))
                labels[labels == labels[b]] = labels[a]
    return out


def _forests(members: DataFrame, functions: int, least: float, tasks: int | None = None) -> DataFrame:
    """Edges ``a, b`` of similar vertices within each node; rows hold ``node, vertex, marks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_ids = kept_nodes = np.zeros(0, np.int64)
        kept_marks = np.zeros((0, functions), np.uint8)

        def edges(nodes, ids, marks) -> pa.RecordBatch:
            left, right = [], []
            begins = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(nodes)]):
                if b - a > 1:
                    for x, y in similar_forest(marks[a:b], least):
                        left.append(ids[a + x])
                        right.append(ids[a + y])
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

        for batch in batches:
            nodes = np.concatenate([kept_nodes, batch.column("node").to_numpy()])
            ids = np.concatenate([kept_ids, batch.column("vertex").to_numpy()])
            marks = np.concatenate([kept_marks, _unpacked(binary(batch.column("marks"), np.uint8)[0].reshape(-1, functions // 2))])
            if not len(nodes):
                continue
            last = int(np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))[-1])
            yield edges(nodes[:last], ids[:last], marks[:last]) if last else pa.RecordBatch.from_arrays(
                [pa.array([], pa.int64()), pa.array([], pa.int64())], ["a", "b"])
            kept_nodes, kept_ids, kept_marks = nodes[last:], ids[last:], marks[last:]
        if len(kept_nodes):
            yield edges(kept_nodes, kept_ids, kept_marks)

    ordered = members.select("node", "vertex", "marks").repartition("node").sortWithinPartitions("node", "vertex")
    return map_arrow(dealt(ordered, tasks), run, "a long, b long")


def _settled(members: DataFrame, functions: int, least: float, tasks: int | None = None) -> DataFrame:
    """Members of large nodes with their node's ``anchor`` and whether they are ``like`` it."""
    anchors = members.groupBy("node").agg(F.min_by(F.struct("vertex", "marks"), F.xxhash64("vertex")).alias("a"))
    near = members.join(anchors.select("node", F.col("a.vertex").alias("anchor"), F.col("a.marks").alias("anchor_marks")), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (_unpacked(binary(batch.column(c), np.uint8)[0].reshape(-1, functions // 2)) for c in ("marks", "anchor_marks"))
            like = (own == other).mean(axis=1) >= least
            yield batch.drop_columns(["anchor_marks"]).append_column("like", pa.array(like))

    return written(map_arrow(dealt(near.select("node", "n", "vertex", "marks", "anchor", "anchor_marks"), tasks), run,
                             "node long, n long, vertex long, marks binary, anchor long, like boolean"), "settled")


def _rest(judged: DataFrame, functions: int, node: int, least: float, tasks: int | None = None) -> DataFrame:
    """Edges between the members that are not like their anchor and all members of their node, block against block."""
    half = max(1, node // 2)
    blocks = F.ceil(F.col("n") / half).cast("long")
    rows = judged.withColumn("block", F.pmod(F.xxhash64("vertex"), blocks))
    loose = judged.where("NOT like")
    ways = loose.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / half).cast("long").alias("ways"))
    asking = loose.join(ways, "node").select(
        "node", F.pmod(F.xxhash64("vertex", F.lit(5)), F.col("ways")).alias("way"), _numbers(blocks).alias("block"), "vertex", "marks")
    asked = rows.join(ways, "node").select("node", _numbers(F.col("ways")).alias("way"), "block", "vertex", "marks")
    pairs = asking.unionByName(asked).dropDuplicates(["node", "way", "block", "vertex"])
    return _forests(pairs.withColumn("node", F.xxhash64("node", "way", "block")), functions, least, tasks)


def _counted(members: DataFrame) -> DataFrame:
    """Members of nodes with company, and the node's size ``n``."""
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.select("node", "vertex").join(sizes, "node")


def candidate_edges(vertices: DataFrame, functions: int = FUNCTIONS, trees: int = TREES, depth: int = DEPTH,
                    branches: int = BRANCHES, node: int = NODE, least: float = LEAST_AGREEING, tasks: int | None = None) -> DataFrame:
    """Edges whose components hold every pair of ``vertices`` (``vertex, signature``) that the trees recall.

    Large nodes branch, and branch again. What a branch leaves large is of two kinds. Where nearly all members are
    like one anchor, further tokens would not part them; the few others are compared with all. Where many are not,
    they do part, so the node branches on, ``LEVELS`` times at most; then all that is left is compared. ``tasks`` bounds those
    that a small table is dealt to.
    """
    short = written(_short(vertices, functions), "marks")
    members = written(dealt(_counted(_nodes(vertices, functions, trees, depth)).join(short, "vertex"), tasks), "nodes")
    found = [_forests(members.where(F.col("n") <= node), functions, least, tasks)]
    large = members.where(F.col("n") > node).select("node", "vertex")
    for level in range(LEVELS):
        if large.isEmpty():
            break
        deeper = _counted(_branched(large.join(vertices.select("vertex", "signature"), "vertex"), functions, branches))
        deeper = written(dealt(deeper.join(short, "vertex"), tasks), "nodes")
        found.append(_forests(deeper.where(F.col("n") <= node), functions, least, tasks))
        judged = _settled(deeper.where(F.col("n") > node), functions, least, tasks)
        found.append(judged.where("like AND vertex <> anchor").select(F.col("anchor").alias("a"), F.col("vertex").alias("b")))
        others = judged.where("NOT like").groupBy("node").agg(F.count(F.lit(1)).alias("others"))
        others = others.join(judged.select("node", "n").distinct(), "node")
        parts = F.lit(level + 1 < LEVELS) & (F.col("others") > F.greatest(F.lit(node), F.col("n") / 8))
        found.append(_rest(judged.join(others.where(~parts).select("node"), "node", "left_semi"), functions, node, least, tasks))
        large = judged.join(others.where(parts).select("node"), "node", "left_semi").select("node", "vertex")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection of two ascending sets reaches ``percent`` times their union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    slot = np.searchsorted(large, small)
    slot[slot == len(large)] = 0
    common = int((large[slot] == small).sum()) if len(large) else 0
    return 100 * common >= percent * (len(a) + len(b) - common)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every two sets, by products of their incidence matrices."""
    sizes = [len(s) for s in sets]
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1  # an item of one set only is in no intersection
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.diag(np.array(sizes, np.float32))
    np.fill_diagonal(out, 0)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out


def confirmed_labels(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first one of its component of links."""
    n = len(sets)
    labels = np.arange(n)
    if n < 3:
        if n == 2 and linked(sets[0], sets[1], percent):
            labels[1] = 0
        return labels
    common, sizes = intersections(sets), np.array([len(s) for s in sets], np.float64)
    links = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    for a in range(n):
        for label in np.unique(labels[links[a]]).tolist():
            if label != labels[a]:
                low, high = min(label, labels[a]), max(label, labels[a])
                labels[labels == high] = low
    return labels


def _confirm_groups(members: DataFrame, keys: list[str], percent: int, tasks: int | None = None) -> DataFrame:
    """Per group of ``keys``, ``a, b``: each vertex but the first of its component, with that first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []

        def links() -> pa.RecordBatch:
            labels = confirmed_labels(sets, percent) if ids else np.zeros(0, np.int64)
            pairs = [(ids[label], ids[i]) for i, label in enumerate(labels.tolist()) if i != label and ids[i] != ids[label]]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            for g, v, s in zip(names, batch.column("vertex").to_pylist(), batch.column("items").to_pylist()):
                if g != group:
                    yield links()
                    group, ids, sets = g, [], []
                ids.append(v)
                sets.append(np.frombuffer(s, np.uint64))
        yield links()

    ordered = members.select(*keys, "vertex", "items").repartition(*keys).sortWithinPartitions(*keys, "vertex")
    return map_arrow(dealt(ordered, tasks), run, "a long, b long")


def _confirm_pairs(pairs: DataFrame, percent: int, tasks: int | None = None) -> DataFrame:
    """Those of the rows ``a, b, items_a, items_b`` that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                  for x, y in zip(batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(dealt(pairs, tasks), run, "a long, b long")


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _confirm_large(large: DataFrame, percent: int, cluster: int, tasks: int | None = None) -> DataFrame:
    """Links of clusters of more than one task's size: first with one anchor, copied to every block of the
    cluster, then of what the anchor does not link with all, block against block."""
    blocks = F.ceil(F.col("n") / cluster).cast("long")
    rows = large.where(F.col("vertex") != F.col("anchor")).withColumn("block", F.pmod(F.xxhash64("vertex"), blocks).cast("long"))
    anchors = (large.where(F.col("vertex") == F.col("anchor"))
               .select("cluster", _numbers(blocks).alias("block"), F.col("items").alias("items_a")))
    star = written(_confirm_pairs(rows.join(anchors, ["cluster", "block"]).select(
        F.col("anchor").alias("a"), F.col("vertex").alias("b"), "items_a", F.col("items").alias("items_b")), percent, tasks), "star")
    loose = rows.join(star.select(F.col("b").alias("vertex")), "vertex", "left_anti")
    ways = loose.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / cluster).cast("long").alias("ways"))
    asking = loose.join(ways, "cluster").select(
        "cluster", F.pmod(F.xxhash64("vertex", F.lit(5)), F.col("ways")).alias("way"), _numbers(blocks).alias("block"), "vertex", "items")
    asked = rows.join(ways, "cluster").select("cluster", _numbers(F.col("ways")).alias("way"), "block", "vertex", "items")
    return star.unionByName(_confirm_groups(asking.unionByName(asked), ["cluster", "way", "block"], percent, tasks))


def sized(clusters: DataFrame) -> DataFrame:
    """Rows ``cluster, vertex`` with their cluster's size ``n`` and least vertex ``anchor``: sets need not be shuffled to be counted."""
    return clusters.join(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("vertex").alias("anchor")), "cluster")


def confirm(members: DataFrame, percent: int = PERCENT, cluster: int = CLUSTER, *, tasks: int | None = None) -> DataFrame:
    """``vertex, component`` of the vertices of ``members`` that full sets link with others.

    Rows hold ``cluster, vertex, n, anchor`` (see ``sized``) and ``items``.
    """
    found = written(_confirm_groups(members.where(F.col("n") <= cluster), ["cluster"], percent, tasks), "links")
    small = found.select(F.col("b").alias("vertex"), F.col("a").alias("component")).unionByName(
        found.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct())
    large = members.where(F.col("n") > cluster)
    if large.isEmpty():
        return small
    return small.unionByName(connected_components(_confirm_large(large, percent, cluster, tasks), tasks=tasks))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, **options) -> DataFrame:
    """``doc_id, n_shingles, vertex, component_id, kept``: one row per row of ``docs``.

    ``vertex`` names the shingle set of the text; it is null where the row is linked with nothing.

    Documents are linked where 100 times the shingles in common reach ``percent`` times those of either.
    ``component_id`` is the least ``doc_id`` reachable, ``kept`` marks its document. Rows that share a
    ``doc_id`` are linked by their own texts. A null or empty text has an empty set and no links; a
    null ``doc_id`` is linked with nothing, has a null component and is kept. Other columns are ignored.
    """
    rows = written(signed(docs, shingle), "signatures")
    tasks = tasks_for(rows.count())
    vertices = rows.where(F.col("vertex").isNotNull()).groupBy("vertex").agg(
        F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"))
    vertices = written(dealt(vertices, tasks), "vertices")
    clusters = connected_components(candidate_edges(vertices, tasks=tasks, **options), tasks=tasks).withColumnRenamed("component", "cluster")
    clusters = written(dealt(sized(clusters), tasks), "clusters")
    # Only documents in clusters are read again, one row a set is shuffled, and no text is.
    first_ids = key_bitmap(clusters.join(vertices.select("vertex", "first_id"), "vertex").select("first_id"))
    wanted = key_bitmap(clusters.select("vertex"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = batch.filter(pa.array(may_match(first_ids.value, batch.column("doc_id").to_numpy())))
            for part in batches_of([few], _BATCH):
                items, sizes = shingle_sets(part.column("text"), shingle)
                names = vertex_of(items, sizes)
                own = pa.RecordBatch.from_arrays([pa.array(names), lists(items, sizes)], ["vertex", "items"])
                yield own.filter(pa.array((sizes > 0) & may_match(wanted.value, names)))

    again = map_arrow(texts(docs).where("doc_id IS NOT NULL"), sets, "vertex long, items binary").dropDuplicates(["vertex"])
    members = written(dealt(again.join(clusters, "vertex"), tasks), "sets")
    found = confirm(members, percent, tasks=tasks)
    least = found.join(vertices.select("vertex", "first_id"), "vertex")
    least = least.join(least.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("vertex", "component_id")
    names = vertices.select("vertex", "first_id").join(least, "vertex", "left").select(
        "vertex", F.coalesce("component_id", "first_id").alias("component_id"))
    out = rows.drop("signature").join(names, "vertex", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "vertex", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, **options) -> DataFrame:
    """``docs`` with one row of each component, that of the least ``doc_id``; columns as they were.

    Rows that repeat a ``doc_id`` with the same words count as copies. Rows with a null ``doc_id`` and texts without
    words all stay, any further column is carried along, whatever its name, and an empty table stays empty.
    Only rows whose ``doc_id`` loses something are shuffled.
    """
    judged = written(near_duplicates(docs, shingle, percent, **options).where("vertex IS NOT NULL"), "judged")
    gone = judged.where(~F.col("kept")).select("doc_id", "vertex")
    twice = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    bitmap = key_bitmap(gone.select("doc_id").unionByName(twice))
    schema = docs.schema
    vertex, lost, its = unused_names(docs, "vertex", "lost", "its")

    def split(touched: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                hit = may_match(bitmap.value, ids.fill_null(0).cast(pa.int64()).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == touched))
        return run

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, _BATCH):
            items, sizes = shingle_sets(batch.column("text"), shingle)
            yield batch.append_column(vertex, pa.array(vertex_of(items, sizes), mask=sizes == 0))

    named = map_arrow(map_arrow(docs, split(True), schema), name, StructType([*schema.fields, StructField(vertex, LongType())]))
    # Without words there is nothing to be a copy of; such rows all stay.
    wordless = named.where(F.col(vertex).isNull()).drop(vertex)
    gone = gone.select(F.col("doc_id").alias(lost), F.col("vertex").alias(its)).distinct()
    left = named.where(F.col(vertex).isNotNull()).join(
        gone, (F.col("doc_id") == F.col(lost)) & (F.col(vertex) == F.col(its)), "left_anti")
    return map_arrow(docs, split(False), schema).unionByName(wordless).unionByName(left.dropDuplicates(["doc_id", vertex]).drop(vertex))
