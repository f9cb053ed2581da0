"""Plain versions of the operators' results, and documents with awkward cases."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import SparkSession

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

BASE = ("The old harbour lay quiet in the morning light. Boats rocked gently against the worn stone pier while gulls cried. "
        "Nobody had come down the hill road since the storm broke over the northern cape last winter and sank two ships.")
OTHER = ("Engineers measured every beam twice before the bridge was opened. Traffic began at noon under heavy rain and wind. "
         "A small crowd waited on the far bank with flags, drums and one enormous painted banner that nobody could read.")


def words(text, lower=True):
    text = text or ""
    return _WORD.findall(text.translate(_FOLD) if lower else text)


def awkward_rows() -> list[tuple]:
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(9000))
    return [
        (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("gently", "slowly")), (4, OTHER), (5, None), (6, ""), (7, " \n\t "),
        (8, "one two three"), (9, "one two three"), (10, "x" * 70 + " y"), (11, long), (12, "Ünïcode é\u00a0ß\u2003日本語 👍🏽 <|endoftext|> it's"),
        (13, "a  b \n c\n\n d \x1c e \x00 f"), (14, OTHER + "\n" + BASE), (15, "Zz zz. " + BASE), (None, BASE), (None, None),
        (16, "spam " * 60), (17, BASE.upper()), (18, "line one is here\n" * 6), (19, "# * $ % & | < > " * 12), (20, BASE + " " + OTHER),
    ]


def documents(spark: SparkSession, rows=None):
    """With columns whose names the operators use inside."""
    rows = awkward_rows() if rows is None else rows
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1.5, 7, "v") for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double, vertex long, component_id string"
                                 ).repartition(3)


def shingle_set(text, size):
    w = words(text)
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(sets: dict, percent: int) -> dict:
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    names = list(sets)
    for k, a in enumerate(names):
        for b in names[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def grams(text, n):
    w = words(text)
    return Counter(tuple(w[k:k + n]) for k in range(len(w) - n + 1))
