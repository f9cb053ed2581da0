"""How far the sources of a language differ in their words, from sorted pointers to word starts.

A task cuts its texts into slices. In a slice, a pointer to the start of every term is sorted by multikey
quicksort: by the next eight bytes, then each run of equal keys by the eight bytes after them, until the
terms end. Equal runs then give every term's occurrences and documents per source. The slices' counts are
summed by Spark, so that no term and no source, however frequent, goes to one task.

Distances are summed over blocks of terms, each a small dense matrix of terms by sources; sources are
dealt into tiles, so the matrix and the sums have a bound whatever the number of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.tables import batches_of, map_arrow, written
from tickframe.llm.words import lower, text_bytes

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
PRIOR = 5
_SLICE = 8 << 20
_TILE = 1024
_ROWS = 1 << 16
_CELLS = 1 << 21

_TERM = np.zeros(256, bool)
_TERM[ord("A"):ord("Z") + 1] = _TERM[ord("a"):ord("z") + 1] = _TERM[0x80:] = True


def term_pointers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and text number of every term: runs of letters and of bytes from 0x80 on."""
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = _TERM[data]
    begins = solid[:-1].copy()
    begins[1:] &= ~solid[:-2]
    edge = bounds[1:-1]
    edge = edge[edge < len(data)]
    begins[edge] = solid[edge]
    ends = solid[:-1] & ~solid[1:]
    last = bounds[1:-1][bounds[1:-1] > 0] - 1
    ends[last] = solid[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(bounds, starts, "right") - 1


def multikey_sort(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by their terms, and whether each one in that order begins a run of equal terms."""
    n = len(starts)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    order, heads, still, depth = np.arange(n), np.zeros(n, bool), np.arange(n), 0
    heads[:1] = True
    while len(still):
        own = order[still]
        left = sizes[own] - depth
        key = np.zeros(len(own), np.uint64)
        some = np.flatnonzero(left > 0)
        key[some] = eights[starts[own[some]] + depth]
        cut = (64 - 8 * np.clip(left[some], 0, 8)).astype(np.uint64)
        key[some] = key[some] >> cut << cut  # bytes after the term count as zero, which no term has
        sort = np.argsort(key, kind="quicksort")
        if depth:
            run = np.cumsum(heads)[still]
            sort = sort[np.argsort(run[sort], kind="stable")]
        order[still], key = own[sort], key[sort]
        heads[still[1:]] |= key[1:] != key[:-1]
        # A run goes on if its key is full and it has more than one pointer.
        single = heads.copy()
        single[:-1] &= heads[1:]
        still = still[(key & np.uint64(0xFF) != 0) & ~single[still]]
        depth += 8
    return order, heads


def slice_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``lang, source, term, n, docs`` of one slice; every group of it also has one row with the empty term."""
    groups = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
    names = pa.table({"lang": batch.column("lang"), "source": batch.column("source"), "row": pa.array(np.arange(len(groups)))})
    names = names.group_by(["lang", "source"]).aggregate([("row", "list")])
    lists = names.column("row_list").combine_chunks()
    rank = np.empty(len(groups), np.int64)  # documents in the order of their groups
    rank[lists.flatten().to_numpy()] = np.arange(len(groups))
    group = np.repeat(np.arange(len(names)), pc.list_value_length(lists).to_numpy())

    data, bounds = text_bytes(batch.column("text"))
    data = lower(data)
    starts, sizes, text = term_pointers(data, bounds)
    order, heads = multikey_sort(data, starts, sizes)
    code = (np.cumsum(heads) - 1) * len(groups) + rank[text[order]]
    code.sort()
    new_doc = np.diff(code, prepend=-1) != 0
    run, doc = np.divmod(code, max(len(groups), 1))
    pair = run * len(names) + group[doc]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.diff(first, append=len(code))
    docs = np.add.reduceat(new_doc, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)

    shown = order[heads]
    upto = np.cumsum(sizes[shown])
    flat = data[np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts[shown] - upto + sizes[shown], sizes[shown])]
    terms = pa.LargeStringArray.from_buffers(len(shown), pa.py_buffer(np.concatenate([[0], upto]).astype(np.int64)),
                                             pa.py_buffer(np.ascontiguousarray(flat))).cast(pa.string())
    at = pa.array(np.concatenate([group[doc[first]], np.arange(len(names))]))
    empty = np.zeros(len(names), np.int64)
    return pa.RecordBatch.from_arrays(
        [names.column("lang").combine_chunks().take(at), names.column("source").combine_chunks().take(at),
         pa.concat_arrays([terms.take(pa.array(run[first])), pa.array([""] * len(names), pa.string())]),
         pa.array(np.concatenate([n, empty])), pa.array(np.concatenate([docs, empty]))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term in every group of ``docs``.

    Null ``lang``, ``source`` and ``text`` count as empty text; every row is a document, whatever its id.
    Every occurring group has one row more, with the empty term and zeros. Further columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, _SLICE):
            yield slice_counts(batch)

    columns = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return (map_arrow(columns, run, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / total), exact for any 64-bit counts; 0 where the total is 0."""
    return F.expr(f"CASE WHEN {total} > 0 THEN 1 + (cast({SCALE} AS decimal(10, 0)) * cast({n} + {PRIOR} AS decimal(20, 0))) "
                  f"div cast({total} AS decimal(20, 0)) ELSE 0L END")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of ``lang`` and ``source``.

    Terms of a language are those in at least ``min_docs`` of its documents. Part ``pair`` has every other
    source of the language with the sum of absolute differences of all terms' shares; part ``term`` has
    the ``top`` terms that the group has more of than the language. Nulls, repeated rows and further
    columns as in :func:`term_counts`; an empty table gives no rows.
    """
    same_term = Window.partitionBy("lang", "term")
    counted = (term_counts(docs)
               .withColumn("lang_docs", F.sum("docs").over(same_term)).withColumn("lang_n", F.sum("n").over(same_term))
               .withColumn("first", (F.row_number().over(same_term.orderBy("source")) == 1).cast("long"))
               .where((F.col("lang_docs") >= min_docs) | (F.col("term") == "")))
    kept = written(counted.drop("docs", "lang_docs"), "audit-terms")
    terms = kept.where("term != ''")
    of_lang = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("v"))
    groups = (kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
              .join(of_lang, "lang", "left").na.fill(0, ["lang_total", "v"])
              .withColumn("total", F.expr(f"group_total + {PRIOR} * v")).withColumn("lang_total", F.expr(f"lang_total + {PRIOR} * v"))
              .withColumn("base", _share("0", "total"))
              .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
              .withColumn("blocks", F.floor((F.count(F.lit(1)).over(Window.partitionBy("lang")) + (_TILE - 1)) / _TILE).cast("int")))
    groups = written(groups, "audit-groups")
    shares = (terms.join(groups, ["lang", "source"])
              .withColumn("p", _share("n", "total")).withColumn("q", _share("lang_n", "lang_total")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    surplus = (shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                            (F.col("p") - F.col("q")).alias("value"))
               .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))
    pairs = _distances(shares, groups).withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(surplus)


def _distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Both directions of every pair of sources of a language, with the sum over all its terms."""
    sizes = groups.agg(F.max("place")).first()[0]
    rows = shares.count()
    buckets = max(1, rows // max(_ROWS, ((sizes or 0) + 1) ** 2))
    tiles = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    own = F.floor(F.col("place") / _TILE).cast("int")
    spots = [F.least("own", "other").alias("tile_a"), F.greatest("own", "other").alias("tile_b")]
    of_terms = (shares.select("lang", F.expr(f"cast(pmod(xxhash64(term), {buckets}) AS int)").alias("bucket"), "term", "place", "p", own.alias("own"), tiles))
    of_groups = (groups.select("lang", "place", F.col("base").alias("p"), own.alias("own"), tiles)
                 .select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit("").alias("term")))
    dealt = (of_terms.unionByName(of_groups).select("lang", *spots, "bucket", "term", "place", "p")
             .repartition("lang", "tile_a", "tile_b", "bucket").sortWithinPartitions("lang", "tile_a", "tile_b", "bucket", "term"))
    limits = _TILE, _ROWS, _CELLS
    parts = (map_arrow(dealt, lambda batches: _tile_sums(batches, *limits), "lang string, a int, b int, part long, seen long")
             .groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen")))
    left = groups.select("lang", F.col("place").alias("a"), F.col("source").alias("left"), F.col("base").alias("left_base"), "v")
    right = groups.select("lang", F.col("place").alias("b"), F.col("source").alias("right"), F.col("base").alias("right_base"))
    # A term that no source of a tile has is missing there: both shares are those of a count of zero.
    whole = (parts.join(left, ["lang", "a"]).join(right, ["lang", "b"])
             .withColumn("value", F.expr("part + (v - seen) * abs(left_base - right_base)")))
    ends = F.explode(F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")),
                             F.struct(F.col("right").alias("source"), F.col("left").alias("item")))).alias("e")
    return whole.select("lang", "value", ends).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")


def _tile_sums(batches: Iterator[pa.RecordBatch], tile: int, rows: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Sums of |p - q| over the terms of each (lang, tiles, bucket), whose rows come sorted, the groups' own first."""
    key, sums, kept = None, None, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        while len(table):
            head = tuple(table.column(c)[0].as_py() for c in ("lang", "tile_a", "tile_b", "bucket"))
            same = np.ones(len(table), bool)
            for name, value in zip(("lang", "tile_a", "tile_b", "bucket"), head):
                same &= pc.equal(table.column(name), value).to_numpy()
            upto = len(table) if same.all() else int(np.argmin(same))
            if head != key:
                if sums is not None:
                    yield from sums.done()
                key, sums = head, _Sums(*head[:3], tile, rows, cells)
            sums.add(table.slice(0, upto))
            table = table.slice(upto)
    if sums is not None:
        yield from sums.done()


class _Sums:
    """Distances of the sources of one tile; holds about ``rows`` rows and a matrix of about ``cells`` cells."""

    def __init__(self, lang: str, tile_a: int, tile_b: int, tile: int, rows: int, cells: int):
        self.lang, self.cross, self.tile, self.rows, self.cells = lang, tile_a != tile_b, tile, rows, cells
        self.places, self.base = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.total, self.seen, self.rest = None, 0, None

    def add(self, rows: pa.Table) -> None:
        own = pc.equal(rows.column("term"), "").to_numpy()
        if own.any():
            self.places = np.concatenate([self.places, rows.column("place").to_numpy()[own]])
            self.base = np.concatenate([self.base, rows.column("p").to_numpy()[own]])
            rows = rows.filter(pa.array(~own))
        if len(rows):
            self.rest = rows if self.rest is None else pa.concat_tables([self.rest, rows])
            if len(self.rest) >= self.rows:
                self._fold(False)

    def _fold(self, all_rows: bool) -> None:
        if self.total is None:
            order = np.argsort(self.places)
            self.places, self.base = self.places[order], self.base[order]
            self.total = np.zeros((len(order), len(order)), np.int64)
        rows = self.rest
        if rows is None or not len(rows):
            return
        term = rows.column("term").combine_chunks()
        new = np.concatenate([[True], pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)])
        upto = len(rows) if all_rows else int(np.flatnonzero(new)[-1])  # the last term may go on in the next batch
        self.rest = rows.slice(upto)
        number = np.cumsum(new[:upto]) - 1
        if not upto:
            return
        column = np.searchsorted(self.places, rows.column("place").to_numpy()[:upto])
        p = rows.column("p").to_numpy()[:upto]
        self.seen += int(number[-1]) + 1
        step = max(1, self.cells // max(1, len(self.places)))
        for first in range(0, int(number[-1]) + 1, step):
            a, b = np.searchsorted(number, [first, first + step])
            matrix = np.tile(self.base, (min(step, int(number[-1]) + 1 - first), 1))
            matrix[number[a:b] - first, column[a:b]] = p[a:b]
            for k in range(len(self.places) - 1):
                self.total[k, k + 1:] += np.abs(matrix[:, k + 1:] - matrix[:, k:k + 1]).sum(0)

    def done(self) -> Iterator[pa.RecordBatch]:
        self._fold(True)
        tile = self.places // self.tile
        for k in range(len(self.places) - 1):
            other = np.arange(k + 1, len(self.places))
            other = other[tile[other] != tile[k]] if self.cross else other
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.lang] * len(other), pa.string()), pa.array(np.full(len(other), self.places[k]), pa.int32()),
                 pa.array(self.places[other], pa.int32()), pa.array(self.total[k, other]), pa.array(np.full(len(other), self.seen, np.int64))],
                ["lang", "a", "b", "part", "seen"])
