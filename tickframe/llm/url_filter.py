"""Allow and block rules for urls, as a trie over reversed host labels and path segments.

A rule is ``host/path``. It fits its host and every subdomain of it, if the url's path starts with the
rule's. Of all rules that fit, the longest text wins; of an allow and a block rule of the
same text, block wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.tables import map_arrow

# The trie is broadcast, so its size is bounded: larger lists are refused, not cut.
MOST_RULE_BYTES = 64 << 20
DEFAULT = "allow"
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


class Node:
    """A trie node. ``here``: rules that end at this segment border; ``parts``: rules that end inside the next segment."""

    __slots__ = ("labels", "segments", "here", "parts")

    def __init__(self):
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.here: tuple[str, str] | None = None
        self.parts: list[tuple[str, tuple[str, str]]] = []


def build(rules: Iterable[tuple[str, str]]) -> Node:
    """The trie of ``(verdict, rule)``; a rule without a slash has an empty path."""
    root, size = Node(), 0
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        size += len(rule.encode())
        if size > MOST_RULE_BYTES:
            raise ValueError(f"more than {MOST_RULE_BYTES} bytes of rules; join them as a table instead")
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.translate(_FOLD).split(".") if host else []):
            node = node.labels.setdefault(label, Node())
        found = (rule, verdict)
        if not slash:
            if node.here is None or verdict == "block":
                node.here = found
            continue
        *whole, last = path.split("/")
        node = node.segments.setdefault("", Node())  # the slash that begins the path
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        if last:
            same = [k for k, (part, _) in enumerate(node.parts) if part == last]
            if not same:
                node.parts.append((last, found))
            elif verdict == "block":
                node.parts[same[0]] = (last, found)
        elif node.here is None or verdict == "block":
            node.here = found
    return root


def _better(best, found):
    return found if found and (best is None or len(found[0]) > len(best[0])) else best


def match(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """Rule and verdict of the longest rule that fits."""
    best, node = None, root
    segments = path.split("/") if path else []
    labels = reversed(host.split(".")) if host else ()
    for label in (None, *labels):
        if label is not None:
            node = node.labels.get(label)
            if node is None:
                break
        best = _better(best, node.here)
        at = node
        for k, segment in enumerate(segments):
            for part, found in at.parts:
                if segment.startswith(part):
                    best = _better(best, found)
            # A segment is passed whole only if a slash follows it.
            at = at.segments.get(segment) if k + 1 < len(segments) else None
            if at is None:
                break
            best = _better(best, at.here)
    return best


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = DEFAULT, url: str = "url",
          key: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: key, ``host, path, rule, verdict``.

    A null url or one without ``://`` has an empty host and path, fits no rule and gets ``default``. Null
    keys stay null, repeated rows give repeated rows, other columns are ignored.
    """
    rest = F.expr("substring(_url, instr(_url, '://') + 3)")
    source = pages.select(F.col(key), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url"))
    plain = (source.withColumn("_rest", F.when(F.instr("_url", "://") > 0, rest).otherwise(F.lit("")))
             .withColumn("host", F.translate(F.regexp_extract("_rest", "^([^/?#]*)", 1), _UPPER, _LOWER))
             .withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1))
             .select(key, "host", "path"))
    trie = pages.sparkSession.sparkContext.broadcast(build(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie.value
        for batch in batches:
            found = [match(root, h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f and f[0] for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())], [key, "host", "path", "rule", "verdict"])

    kind = dict(plain.dtypes)[key]
    return map_arrow(plain, run, f"{key} {kind}, host string, path string, rule string, verdict string")
