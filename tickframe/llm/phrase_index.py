"""Collocations from bidirectional FM-indexes over word ids, one for each slice of texts.

A slice becomes a sequence of word ids with separators between pieces. Two indexes, of the sequence and of
its reverse, hold the last symbols of the suffixes in the order of their next words; as phrases have at
most ``DEPTH`` words, sorting by that many words is enough. A phrase is an interval in each of them.
Extending all intervals of a level by one word, to the right and to the left in turn, lists the phrases of the next
level with their counts and keeps both intervals in step. Spark sums the counts over all slices.

A phrase can be frequent only if its parts are, so a level takes only extensions whose words and pairs of
words may be frequent in all slices together, by bitmaps of fixed size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.key_filter import key_bitmap, may_match
from tickframe.llm.tables import batches_of, map_arrow, written
from tickframe.llm.words import hash_spans, lower, mix, text_bytes

DEPTH = 4
MIN_COUNT = 30
TOP = 2000
PERCENT = 80
UNKNOWN = "und"
_SLICE = 8 << 20
_BORDER = re.compile(rb"[.,;:!?\x0A-\x0D]")
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_WORDS = [f"w{k + 1}" for k in range(DEPTH)]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Lower-cased bytes, bounds of the texts and their languages; a very long text is cut between pieces."""
    for batch in batches_of(batches, _SLICE):
        data, bounds = text_bytes(batch.column("text"))
        data, langs = lower(data), batch.column("lang").to_pylist()
        if len(data) <= 2 * _SLICE:
            yield data, bounds, langs
            continue
        for k, lang in enumerate(langs):
            at, raw = int(bounds[k]), data[bounds[k]:bounds[k + 1]].tobytes()
            begin = 0
            while begin < len(raw):
                found = _BORDER.search(raw, begin + _SLICE)
                end = found.end() if found else len(raw)
                yield data[at + begin:at + end], np.array([0, end - begin]), [lang]
                begin = end


class Words:
    """Every word of a slice: where it lies, a 64-bit code of it and its language, whether a piece begins with it."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, langs: list[str]):
        solid = np.zeros(len(data) + 1, bool)
        solid[:-1] = ~_GAP[data]
        begins, ends = solid[:-1].copy(), solid[:-1] & ~solid[1:]
        begins[1:] &= ~solid[:-2]
        inner = bounds[1:-1]
        begins[inner[inner < len(data)]] = solid[inner[inner < len(data)]]
        ends[inner[inner > 0] - 1] = solid[inner[inner > 0] - 1]
        self.data, self.starts = data, np.flatnonzero(begins)
        self.stops = np.flatnonzero(ends) + 1
        self.names = sorted(set(langs))
        number = {name: k for k, name in enumerate(self.names)}
        text = np.searchsorted(bounds, self.starts, "right") - 1
        self.lang = np.array([number[x] for x in langs], np.int64)[text] if langs else text
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.names] or [0], np.uint64)
        self.codes = mix(hash_spans(data, self.starts, self.stops) ^ seeds[self.lang])
        self.codes[self.codes == 0] = 1  # zero stands for no word
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])[self.starts]
        self.fresh = np.ones(len(self.starts), bool)
        self.fresh[1:] = (np.diff(breaks) > 0) | (np.diff(text) > 0)

    def counts(self) -> pa.RecordBatch:
        """``lang, word, code, n`` of every distinct word; the empty word of a language counts all of them."""
        codes, at, n = np.unique(self.codes, return_index=True, return_counts=True)
        starts, sizes = self.starts[at], self.stops[at] - self.starts[at]
        upto = np.cumsum(sizes)
        flat = self.data[np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - upto + sizes, sizes)]
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], upto]).astype(np.int64)),
                                                 pa.py_buffer(np.ascontiguousarray(flat))).cast(pa.string())
        names = pa.array(self.names, pa.string())
        every = np.bincount(self.lang, minlength=len(names))[:len(names)]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([names.take(pa.array(self.lang[at])), names]), pa.concat_arrays([words, pa.array([""] * len(names), pa.string())]),
             pa.array(np.concatenate([codes, np.zeros(len(names), np.uint64)]).view(np.int64)), pa.array(np.concatenate([n, every]))],
            ["lang", "word", "code", "n"])

    def sequence(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes by word id, and the ids with 0 between pieces and in place of words that are not frequent."""
        keep = may_match(frequent, self.codes)
        after_gap = self.fresh.copy()
        after_gap[1:] |= ~keep[:-1]
        own, gap = self.codes[keep], after_gap[keep]
        if len(gap):
            # A dropped word may lie between two kept ones without touching the second.
            gap[1:] |= np.diff(np.flatnonzero(keep)) > 1
            gap[0] = True
        codes, ids = np.unique(own, return_inverse=True)
        out = np.zeros(len(ids) + int(gap.sum()) + 1, np.int64)
        out[np.arange(len(ids)) + np.cumsum(gap)] = ids + 1
        return np.concatenate([np.zeros(1, np.uint64), codes]), out


class Index:
    """One direction: for every suffix, in order, the symbol before it and where the suffix with it lies."""

    def __init__(self, sequence: np.ndarray, symbols: int, depth: int):
        rank, upto = sequence, 1
        while upto < depth:
            ahead = np.zeros_like(rank)
            ahead[:-upto] = rank[upto:]
            pair = rank * (int(rank.max(initial=0)) + 1) + ahead
            rank, upto = np.unique(pair, return_inverse=True)[1], 2 * upto
        suffixes = np.argsort(rank, kind="stable")
        self.before = sequence[suffixes - 1]
        # Stepping back from a suffix keeps the order among those with the same symbol.
        self.step = np.empty(len(sequence), np.int64)
        self.step[np.argsort(self.before, kind="stable")] = np.arange(len(sequence))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])


class Phrases:
    """Intervals of all phrases of one length, in the index and in the reversed one, with their words."""

    def __init__(self, words: list[np.ndarray], at: np.ndarray, back: np.ndarray, n: np.ndarray):
        self.words, self.at, self.back, self.n = words, at, back, n

    def where(self, keep: np.ndarray) -> "Phrases":
        return Phrases([w[keep] for w in self.words], self.at[keep], self.back[keep], self.n[keep])

    def _extended(self, index: Index, symbols: int, at: np.ndarray, other: np.ndarray):
        upto = np.cumsum(self.n)
        owner = np.repeat(np.arange(len(self.n)), self.n)
        row = np.arange(len(owner)) + np.repeat(at - upto + self.n, self.n)
        key = owner * symbols + index.before[row]
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(head, append=len(key))
        owner, symbol = np.divmod(key[head], symbols)
        # Extensions by smaller symbols come first in the interval of the other direction.
        beside = other[owner] + head - (upto - self.n)[owner]
        real = symbol > 0
        return owner[real], symbol[real], index.step[row[order[head[real]]]], beside[real], n[real]

    def to_the_left(self, index: Index, symbols: int) -> "Phrases":
        owner, symbol, at, back, n = self._extended(index, symbols, self.at, self.back)
        return Phrases([symbol, *(w[owner] for w in self.words)], at, back, n)

    def to_the_right(self, reverse: Index, symbols: int) -> "Phrases":
        owner, symbol, back, at, n = self._extended(reverse, symbols, self.back, self.at)
        return Phrases([*(w[owner] for w in self.words), symbol], at, back, n)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ (b << np.uint64(21) | b >> np.uint64(43))


def _pair_key_column():
    b = F.col("w2")
    return F.col("w1").bitwiseXOR(F.shiftleft(b, 21).bitwiseOR(F.shiftrightunsigned(b, 43)))


def enumerate_phrases(codes: np.ndarray, sequence: np.ndarray, lengths: set[int], pairs: np.ndarray | None = None) -> Iterator[Phrases]:
    """All phrases of the given lengths in a sequence; longer ones only if every two neighbours may be a pair of the bitmap."""
    symbols, depth = len(codes), max(lengths)
    index, reverse = Index(sequence, symbols, depth), Index(sequence[::-1], symbols, depth)
    ids = np.arange(1, symbols)
    n = np.diff(index.first)[1:]
    found = Phrases([ids], index.first[1:-1], reverse.first[1:-1], n)
    for length in range(2, depth + 1):
        right = length % 2 == 0
        found = found.to_the_right(reverse, symbols) if right else found.to_the_left(index, symbols)
        if pairs is not None:
            new = found.words[-2:] if right else found.words[:2]
            found = found.where(may_match(pairs, pair_key(codes[new[0]], codes[new[1]])))
        if length in lengths:
            yield found


def _counted(docs: DataFrame, lengths: set[int], frequent, pairs=None) -> DataFrame:
    """``w1..w4, n`` over all slices: codes of the words, zero after the last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, bounds, langs in slices(batches):
            codes, sequence = Words(data, bounds, langs).sequence(frequent.value)
            for found in enumerate_phrases(codes, sequence, lengths, pairs.value if pairs else None):
                words = [pa.array(codes[w].view(np.int64)) for w in found.words]
                none = [pa.array(np.zeros(len(found.n), np.int64))] * (DEPTH - len(words))
                yield pa.RecordBatch.from_arrays([*words, *none, pa.array(found.n)], [*_WORDS, "n"])

    used = _WORDS[:max(lengths)]
    counted = map_arrow(docs, run, ", ".join(f"{c} long" for c in [*_WORDS, "n"]))
    counted = counted.groupBy(*used).agg(F.sum("n").alias("n"))
    return counted.select(*(F.col(c) if c in used else F.lit(0).cast("long").alias(c) for c in _WORDS), "n")


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, code, n`` of all words of prepared texts; the empty word counts all words of the language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, bounds, langs in slices(batches):
            yield Words(data, bounds, langs).counts()

    return map_arrow(docs, run, "lang string, word string, code long, n long").groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Words and phrases of 2 to ``DEPTH`` words that occur at least ``min_count`` times in a language.

    The words as in :func:`word_counts`, the phrases as ``w1..w4, n``. Null texts are empty, null languages
    ``und``; every row counts, whatever its id; further columns are ignored.
    """
    docs = prepared(docs)
    words = written(word_counts(docs).where((F.col("n") >= min_count) | (F.col("word") == "")), "phrase-words")
    frequent = key_bitmap(words.where("word != ''").select("code"))
    pairs = written(_counted(docs, {2}, frequent).where(F.col("n") >= min_count), "phrase-pairs")
    able = key_bitmap(pairs.select(_pair_key_column().alias("pair")))
    longer = written(_counted(docs, set(range(3, DEPTH + 1)), frequent, able).where(F.col("n") >= min_count), "phrase-longer")
    return words, pairs.unionByName(longer)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of each language that hold together best.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the weakest cut, ``n`` all words. A phrase that
    mostly (``percent``) occurs within a longer one is left out. Nulls, repeated rows and further
    columns as in :func:`phrase_counts`; an empty table gives no rows.
    """
    words, phrases = phrase_counts(docs, min_count)
    size = F.expr(" + ".join(f"cast({w} != 0 AS int)" for w in _WORDS))
    phrases = phrases.withColumnRenamed("n", "a").withColumn("size", size)
    parts = phrases.select(*_WORDS[:-1], F.col("a").alias("f")).where("w4 = 0").unionByName(
        words.where("word != ''").select(F.col("code").alias("w1"), *(F.lit(0).cast("long").alias(w) for w in _WORDS[1:-1]), F.col("n").alias("f")))

    def part(side: str, first, number) -> list:
        """Columns with words ``first`` and on, ``number`` of them, then zeros."""
        every = F.array(*_WORDS)
        return [F.when(F.lit(k) < number, F.get(every, first + k)).otherwise(F.lit(0)).cast("long").alias(f"{side}{k + 1}") for k in range(DEPTH - 1)]

    cuts = (phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .select("*", *part("x", F.lit(0), F.col("k")), *part("y", F.col("k"), F.col("size") - F.col("k"))))
    for side, name in (("x", "l"), ("y", "r")):
        keys = [f"{side}{k + 1}" for k in range(DEPTH - 1)]
        cuts = cuts.join(parts.toDF(*keys, name), keys)
    whole = F.expr("cast((cast(2000000 AS decimal(10, 0)) * cast(a AS decimal(20, 0))) div (cast(l AS decimal(20, 0)) + r) AS long)")
    weakest = (cuts.withColumn("score", whole).groupBy(*_WORDS, "a")
               .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(*_WORDS, "a", "cut.score", "cut.l", "cut.r"))

    # A longer phrase around this one is around one with one word more, which occurs as often at least.
    zero = F.lit(0).cast("long")
    larger = phrases.where("size > 2")
    begins = larger.select(*(F.when(F.col("size") > k + 1, F.col(w)).otherwise(zero).alias(w) for k, w in enumerate(_WORDS)), "a")
    rest = larger.select(*(F.col(w).alias(v) for v, w in zip(_WORDS, _WORDS[1:])), zero.alias(_WORDS[-1]), "a")
    around = begins.unionByName(rest).groupBy(*_WORDS).agg(F.max("a").alias("around"))
    kept = (weakest.join(around, _WORDS, "left")
            .where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * percent)).drop("around"))

    # Ranks first without the words, ties included; only what may be shown is spelled out.
    named = kept.join(words.where("word != ''").select(F.col("code").alias("w1"), "lang", F.col("word").alias("s1")), "w1")
    in_lang = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    named = named.withColumn("rank", F.rank().over(in_lang)).where(F.col("rank") <= top).drop("rank")
    for k in range(1, DEPTH):
        named = named.join(words.where("word != ''").select(F.col("code").alias(_WORDS[k]), F.col("word").alias(f"s{k + 1}")), _WORDS[k], "left")
    totals = words.where("word = ''").select("lang", "n")
    phrase = F.concat_ws(" ", *(f"s{k + 1}" for k in range(DEPTH)))
    return (named.withColumn("phrase", phrase)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
            .where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
