"""Encoding and decoding by a SentencePiece file of merge type, with a table of prefixes.

Every prefix of a word has one last token, whatever follows. It is found from left to right: an automaton
over the vocabulary gives the tokens that end at a character, the longest first, and the right one is the
first whose pair with the last token before it is stable, which means that merging the characters of both
never joins across the border. The ids are then read off the table backwards.

A word here is a run of characters without a place that no token spans; tokens cannot cross such
places, so equal words have equal ids. A batch encodes its distinct words together, character by
character, as numpy arrays. Tables are built by the driver and have the size of the vocabulary.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.bpe import tokenizer_path
from tickframe.llm.tables import batches_of, map_arrow, texts
from tickframe.llm.words import text_bytes

MODEL = "piece_bpe_32k.model"
SPACE = 0x2581
_BATCH = 4 << 20
_LONG = 400  # words of more characters are walked one by one
_SLOTS = 1 << 20
_NEVER = 1 << 30


@dataclass
class Tables:
    """What the workers need of a model; every size is bounded by the vocabulary."""

    chars: np.ndarray  # code points that tokens have, ascending; class k + 1 is chars[k]
    neighbours: np.ndarray  # class << 16 | class of characters side by side in a token
    lengths: np.ndarray  # characters of a token
    order: np.ndarray  # when a token is merged; -1 for single characters
    left: np.ndarray  # the two tokens it is merged from
    right: np.ndarray
    joins: np.ndarray  # ascending left << 32 | right of every two tokens whose join is a token
    joined: np.ndarray  # the order of that token
    steps: np.ndarray  # ascending state << 16 | class of the automaton
    targets: np.ndarray
    fail: np.ndarray
    longest: np.ndarray  # by state: the longest token that ends there
    shorter: np.ndarray  # by token: the next shorter token that ends where it ends
    byte_ids: np.ndarray
    end: int
    surface: np.ndarray  # bytes of all tokens in a row, spaces as such
    surface_bounds: np.ndarray
    is_byte: np.ndarray
    begins_word: np.ndarray  # the token's first character is the space mark
    coder: Pieces | None = None  # the worker's own


def _merged(piece: str, known: dict[str, int], order: np.ndarray) -> list[str]:
    """Symbols left when no two neighbours of ``piece`` can be merged; its last merge comes last."""
    parts = list(piece)
    while len(parts) > 2:
        found = [(order[known[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in known]
        if not found:
            break
        k = min(found)[1]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return parts


def build(path: str) -> Tables:
    """Reads a model file. Refuses models of another kind than merges over characters with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    names = [model.id_to_piece(i) for i in range(size)]
    special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(size)]
    if model.encode("  ") == model.encode("") or any(model.is_unused(i) for i in range(size)) or sum(map(model.is_byte, range(size))) != 256:
        raise ValueError(f"{path}: white space must be kept, every byte must have an id and no piece may be unused")
    known = {names[i]: i for i in range(size) if not special[i]}
    characters = sorted({c for name in known for c in name})
    if any(c not in known for c in characters):
        raise ValueError(f"{path}: a character of a piece is no piece")

    scores = np.array([model.get_score(i) for i in range(size)])
    order = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
    lengths = np.array([0 if s else len(n) for n, s in zip(names, special)])
    order[lengths <= 1] = -1
    left, right = np.full(size, -1), np.full(size, -1)
    usable = [i for i in known.values() if lengths[i] == 1]
    for name, i in known.items():
        parts = _merged(name, known, order) if lengths[i] > 1 else []
        if len(parts) == 2:
            left[i], right[i] = known[parts[0]], known[parts[1]]
            usable.append(i)
            if max(order[left[i]], order[right[i]]) > order[i]:
                raise ValueError(f"{path}: piece {i} is merged before its parts")
    able = set(usable)
    joins = sorted((known[n[:k]] << 32 | known[n[k:]], int(order[i])) for n, i in known.items() for k in range(1, len(n))
                   if known.get(n[:k]) in able and known.get(n[k:]) in able)

    classes = {c: k + 1 for k, c in enumerate(characters)}
    neighbours = sorted({classes[a] << 16 | classes[b] for n in known for a, b in zip(n, n[1:])})
    children: list[dict[int, int]] = [{}]
    ends, state_of = {}, {}
    for i in usable:
        state = 0
        for c in names[i]:
            state = children[state].setdefault(classes[c], len(children))
            if state == len(children):
                children.append({})
        ends[state], state_of[i] = i, state
    fail, longest, shorter = [0] * len(children), [-1] * len(children), np.full(size, -1)
    queue = deque([0])
    while queue:
        state = queue.popleft()
        for c, child in children[state].items():
            back = fail[state]
            while state and back and c not in children[back]:
                back = fail[back]
            fail[child] = children[back].get(c, 0) if state else 0
            longest[child] = ends.get(child, longest[fail[child]])
            queue.append(child)
    for i in usable:
        shorter[i] = longest[fail[state_of[i]]]
    steps = sorted((state << 16 | c, child) for state, edges in enumerate(children) for c, child in edges.items())

    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    surfaces = [b"" if model.is_control(i) else bytes([int(names[i][1:-1], 16)]) if model.is_byte(i)
                else " ⁇ ".encode() if model.is_unknown(i) else names[i].replace("▁", " ").encode() for i in range(size)]
    return Tables(np.array([ord(c) for c in characters], np.int64), np.array(neighbours, np.int64), lengths, order, left, right,
                  np.array([j for j, _ in joins], np.int64), np.array([o for _, o in joins], np.int64),
                  np.array([s for s, _ in steps], np.int64), np.array([t for _, t in steps], np.int64), np.array(fail), np.array(longest), shorter,
                  byte_ids, model.eos_id(), np.frombuffer(b"".join(surfaces), np.uint8),
                  np.cumsum([0, *map(len, surfaces)]), np.isin(np.arange(size), byte_ids),
                  np.array([not s and n.startswith("▁") for n, s in zip(names, special)]))


def _find(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return slot, table[slot] == codes


class Pieces:
    """Encodes and decodes columns of texts. Memory is bounded by the batch and by the tables."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.class_of = np.zeros(0x110000, np.uint16)
        self.class_of[tables.chars] = np.arange(1, len(tables.chars) + 1)
        n = len(tables.chars) + 1
        self.spanned = np.zeros(n * n, bool)
        self.spanned[(tables.neighbours >> 16) * n + (tables.neighbours & 0xFFFF)] = True
        self.pairs = np.full(_SLOTS, -1, np.int64)
        self.verdicts = np.zeros(_SLOTS, bool)

    def _unstable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of both tokens would ever join across their border.

        Undoes the merges of both sides, the latest first, and asks for every two symbols that face each
        other whether their join comes before the merge that ends them. Of equal merges the left is first.
        """
        t = self.t
        a, b = a.copy(), b.copy()
        bad = np.zeros(len(a), bool)
        until_a, until_b = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            slot, hit = _find(t.joins, x << 32 | y)
            when = np.where(hit, t.joined[slot], _NEVER)
            broken = hit & (when < until_a[live]) & (when <= until_b[live])
            bad[live[broken]] = True
            when_x, when_y = t.order[x], t.order[y]
            go = ~broken & ((when_x >= 0) | (when_y >= 0))
            first = when_x > when_y
            at = live[go & first]
            until_a[at], a[at] = t.order[a[at]], t.right[a[at]]
            at = live[go & ~first]
            until_b[at], b[at] = t.order[b[at]], t.left[b[at]]
            live = live[go]
        return bad

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        codes = a << 32 | b
        slot = ((codes * 0x9E3779B97F4A7C1) >> 20) & (_SLOTS - 1)
        new = self.pairs[slot] != codes
        if new.any():
            fresh = np.unique(codes[new])
            known = ~self._unstable(fresh >> 32, fresh & 0xFFFFFFFF)
            at = ((fresh * 0x9E3779B97F4A7C1) >> 20) & (_SLOTS - 1)
            out = np.empty(len(codes), bool)
            out[~new] = self.verdicts[slot[~new]]
            out[new] = known[np.searchsorted(fresh, codes[new])]
            # Of two pairs with one slot either may stay, but key and verdict must be of the same one.
            at, only = np.unique(at, return_index=True)
            self.pairs[at], self.verdicts[at] = fresh[only], known[only]
            return out
        return self.verdicts[slot]

    def _last_tokens(self, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For every place of every word the last token of the word up to there."""
        t = self.t
        last = np.full(len(classes), -1, np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[by_size], sizes[by_size]
        state = np.zeros(len(starts), np.int64)
        for i in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -i, "left"))
            if n <= 2 and sizes[0] > _LONG and i > _LONG:
                break  # what is left is walked singly
            at = starts[:n] + i
            c = classes[at].astype(np.int64)
            now, todo = state[:n], np.arange(n)
            while len(todo):
                slot, hit = _find(t.steps, now[todo] << 16 | c[todo])
                now[todo[hit]] = t.targets[slot[hit]]
                todo = todo[~hit]
                now[todo] = t.fail[now[todo]]  # a single character always has a step from the root
            token = t.longest[now]
            todo = np.arange(n)
            while len(todo):
                before = i - t.lengths[token[todo]]
                inner = np.flatnonzero(before >= 0)
                ok = np.ones(len(todo), bool)
                ok[inner] = self._stable(last[starts[todo[inner]] + before[inner]], token[todo[inner]])
                todo = todo[~ok]
                token[todo] = t.shorter[token[todo]]
            last[at] = token
        else:
            return last
        for k in range(n):
            self._walk(classes, last, int(starts[k]), i, int(sizes[k]), int(state[k]))
        return last

    def _walk(self, classes, last, start: int, i: int, size: int, state: int) -> None:
        """The same for one long word, character by character, from place ``i`` on."""
        t = self.t
        if not hasattr(self, "_edges"):
            self._edges = dict(zip(t.steps.tolist(), t.targets.tolist()))
            self._lists = [x.tolist() for x in (t.fail, t.longest, t.shorter, t.lengths)]
        edges, (fail, longest, shorter, lengths), known = self._edges, self._lists, {}
        tokens = last[start:start + i].tolist()
        for c in classes[start + i:start + size].tolist():
            while state << 16 | c not in edges:
                state = fail[state]
            state = edges[state << 16 | c]
            token = longest[state]
            while True:
                before = len(tokens) - lengths[token]
                if before < 0:
                    break
                pair = tokens[before], token
                if pair not in known:
                    known[pair] = bool(self._stable(np.array([pair[0]]), np.array([token]))[0])
                if known[pair]:
                    break
                token = shorter[token]
            tokens.append(token)
        last[start:start + size] = tokens

    def _encode_words(self, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = self._last_tokens(classes, starts, sizes)
        ends = np.zeros(len(classes), bool)
        at, first = starts + sizes - 1, starts
        while len(at):  # backwards, all words at once
            ends[at] = True
            at = at - self.t.lengths[last[at]]
            inside = at >= first
            at, first = at[inside], first[inside]
        number = np.concatenate([[0], np.cumsum(ends)])
        return last[ends].astype(np.int32), number[starts + sizes] - number[starts]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, without the end id, and their number per text. Null counts as empty."""
        data, bounds = text_bytes(column)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
        full = np.flatnonzero(np.diff(places))
        points = np.insert(np.where(points == 0x20, SPACE, points), places[full], SPACE)
        begin = places[full] + np.arange(len(full))
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(bounds) - 1, np.int64)
        classes = self.class_of[points]
        wide = classes.astype(np.int32)
        cut = np.empty(len(points), bool)
        cut[1:] = ~self.spanned[wide[:-1] * (len(self.t.chars) + 1) + wide[1:]]
        cut[begin] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=len(points))

        # Distinct words by their bytes; a character without a token is a word of its own.
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(2 * np.append(starts, len(points))), pa.py_buffer(np.ascontiguousarray(classes))])
        coded = whole.dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()
        word_bounds = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1] // 2
        flat = np.frombuffer(words.buffers()[2], np.uint16)[:word_bounds[-1]]
        unknown = np.flatnonzero(flat[word_bounds[:-1]] == 0)
        some = np.ones(len(words), bool)
        some[unknown] = False
        word_sizes = np.diff(word_bounds)
        ids, number = self._encode_words(flat, word_bounds[:-1][some], word_sizes[some])
        count = np.zeros(len(words), np.int64)
        count[some] = number
        first = np.cumsum(count) - count

        lost = np.flatnonzero(classes[starts] == 0)
        own = count[code]
        own_first = first[code]
        if len(lost):
            raw = pc.binary_length(pa.array([chr(c) for c in points[starts[lost]]], pa.string()))
            own[lost] = raw.to_numpy()
            own_first[lost] = len(ids) + np.cumsum(own[lost]) - own[lost]
            spelled = "".join(map(chr, points[starts[lost]])).encode()
            ids = np.concatenate([ids, self.t.byte_ids[np.frombuffer(spelled, np.uint8)]])
        upto = np.cumsum(own)
        out = ids[np.arange(upto[-1]) + np.repeat(own_first - upto + own, own)]
        per_text = np.zeros(len(bounds) - 1, np.int64)
        per_text[full] = np.diff(np.concatenate([[0], upto])[np.append(np.searchsorted(starts, begin), len(starts))])
        return out, per_text

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of each run of ids, in a row, and the bounds of each. One leading space mark is dropped."""
        t = self.t
        data, token_sizes = gathered(t.surface, t.surface_bounds, ids)
        upto = np.concatenate([[0], np.cumsum(token_sizes)])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        bounds = upto[edges]
        heads = np.searchsorted(upto, bounds[:-1], "right") - 1  # the first token of each run that shows
        heads = heads[bounds[1:] > bounds[:-1]]
        drop = upto[heads[t.begins_word[ids[heads]]]]
        if len(drop):
            data = np.delete(data, drop)
            bounds = bounds - np.searchsorted(drop, bounds)
        # Bytes on both sides of a token without a surface make no character together.
        silent = np.flatnonzero(token_sizes == 0)
        split = silent[(silent > 0) & (silent + 1 < len(ids))]
        split = split[t.is_byte[ids[split - 1]] & t.is_byte[ids[split + 1]]]
        if t.is_byte[ids].any() and (len(split) or not _valid(data)):
            gaps = upto[silent] - np.searchsorted(drop, upto[silent])
            edges = np.unique(np.concatenate([bounds, gaps]))
            parts = [_repaired(data[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
            ends = np.cumsum([0, *map(len, parts)])
            data, bounds = np.frombuffer(b"".join(parts), np.uint8), ends[np.searchsorted(edges, bounds)]
        return data, bounds


def gathered(data: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the given rows of a table of byte strings, one after another, and their sizes."""
    sizes = (bounds[1:] - bounds[:-1])[rows]
    upto = np.cumsum(sizes)
    return data[np.arange(upto[-1] if len(upto) else 0) + np.repeat(bounds[rows] - upto + sizes, sizes)], sizes


def _valid(data: np.ndarray) -> bool:
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


def _repaired(raw: bytes) -> bytes:
    """Every byte that begins no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(raw[at:at + error.start].decode() + "�")
            at += error.start + 1
    return "".join(out).encode()


_loaded: dict[str, Tables] = {}


def _shared(docs: DataFrame, model: str):
    path = model if "/" in model else tokenizer_path(model)
    if path not in _loaded:
        _loaded[path] = build(path)
    return docs.sparkSession.sparkContext.broadcast(_loaded[path])


def _worker(tables) -> Pieces:
    if tables.value.coder is None:
        tables.value.coder = Pieces(tables.value)
    return tables.value.coder


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, ids`` (array of int, the end id last) of every text, null as empty.

    One row per row of ``docs``; a null ``doc_id`` stays null and further columns are ignored.
    """
    tables = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, _BATCH):
            ids, sizes = with_end(*_worker(tables).encode(batch.column("text")), tables.value.end)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return map_arrow(texts(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``. Null lists give the empty text; ids outside the vocabulary are an error."""
    tables = _shared(encoded, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            data, bounds = _worker(tables).decode(column.flatten().to_numpy(zero_copy_only=False), sizes)
            text = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text.cast(pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(sizes), end), sizes + 1


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids of each text and of what they decode to.

    Rows as in :func:`encode`: null and empty texts have the end id only.
    """
    tables = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = [f"{i} ".encode() for i in range(len(tables.value.lengths))]
        number_data, number_bounds = np.frombuffer(b"".join(numbers), np.uint8), np.cumsum([0, *map(len, numbers)])
        for batch in batches_of(batches, _BATCH):
            pieces = _worker(tables)
            ids, sizes = with_end(*pieces.encode(batch.column("text")), tables.value.end)
            spelled, lengths = gathered(number_data, number_bounds, ids)
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
            decoded, bounds = pieces.decode(ids, sizes)
            columns = [pa.array([hashlib.sha256(memoryview(x)[a:b]).hexdigest() for a, b in edges], pa.string()) for x, edges in (
                (np.ascontiguousarray(spelled), zip(np.concatenate([[0], ends[:-1]]).tolist(), (ends - 1).tolist())),
                (np.ascontiguousarray(decoded), zip(bounds[:-1].tolist(), bounds[1:].tolist())))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *columns],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
