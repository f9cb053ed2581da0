"""Whole texts to token ids with a public tokenizer file, as flat numpy arrays.

Both tokenizers cut a text before every run of white space, and no token crosses such a cut. So a
text is encoded as the sequence of its space-separated pieces, and a piece that a worker has seen
before is a dictionary lookup. Pieces are further cut into letters and trailing punctuation,
between which both tokenizers cut as well. Texts with white space that these rules do not
cover go to the tokenizer whole, so the ids are those of the tokenizer in every case.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa

from tickframe.llm.words import hash_spans, spans, text_bytes

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"

_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_ENDS = r"[.,;:!?*#$%&|)]*"
# White space other than single spaces and line ends, by its UTF-8: bytes of their own, and the last bytes of
# U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F and U+3000 by the bytes before.
_ODD_BYTES = np.zeros(256, bool)
_ODD_BYTES[[0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20)]] = True
_ODD_ENDS = {(0xC2,): (0x85, 0xA0), (0xE1, 0x9A): (0x80,), (0xE2, 0x80): (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF),
             (0xE2, 0x81): (0x9F,), (0xE3, 0x80): (0x80,)}
_ODD_LEADS = np.zeros(256, bool)
_ODD_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True

# A worker's cache is emptied beyond this many bytes, by an estimate.
CACHE_BYTES = 192 << 20
_JOINED = 2_000
_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; every executor has them installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a file, with truncation and padding off."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoder(name: str) -> "Encoder":
    """The worker's encoder for a file name or path. Tasks that share a worker share its cache."""
    if name not in _encoders:
        path = name if "/" in name else tokenizer_path(name)
        _encoders[name] = (ByteEncoder if "byte" in path.rsplit("/", 1)[-1] else WordEncoder)(path)
    return _encoders[name]


def release_all() -> None:
    """Gives the caches of this worker's encoders back; for tasks that come after all encoding."""
    for own in _encoders.values():
        if len(own.hashes):
            own.release()


def odd_texts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Numbers of the texts with white space that pieces do not cover: a space after white space, or any other kind."""
    if not len(data):
        return np.zeros(0, np.int64)
    odd = _ODD_BYTES[data]
    odd[1:] |= (data[1:] == 0x20) & ((data[:-1] == 0x20) | (data[:-1] == 0x0A))
    firsts = bounds[:-1][bounds[:-1] < len(data)]
    odd[firsts] &= data[firsts] != 0x20  # what is before belongs to another text
    lead = np.flatnonzero(_ODD_LEADS[data])
    for before, last in _ODD_ENDS.items():
        at = lead[lead + len(before) < len(data)]
        for k, byte in enumerate(before):
            at = at[data[at + k] == byte]
        odd[at[np.isin(data[at + len(before)], last)]] = True
    return np.unique(np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1)


class Encoder:
    """Encodes columns of texts; keeps pieces of at most about ``CACHE_BYTES``, then starts anew.

    Pieces are known by their hash. Every piece is one atom of letters and one of punctuation,
    each a run of ``ids``.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.codes = np.zeros(0, np.int64)
        self.letters: dict[str, int] = {}
        self.ends: dict[str, int] = {"": 0}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.known = 1

    def cached_bytes(self) -> int:
        """About what the cache takes; a string with its place in a dictionary counts 200 bytes."""
        return 16 * len(self.hashes) + 200 * (len(self.letters) + len(self.ends)) + 16 * self.known + 4 * self.used

    def release(self) -> None:
        """Gives the cache back. For workers that have other work to do next."""
        self._clear()
        pa.default_memory_pool().release_unused()

    def _add_atoms(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Appends atoms; the number of the first one."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(sizes) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        first = self.known
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[first:first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:first + len(sizes)] = sizes
        self.used += len(ids)
        self.known += len(sizes)
        return first

    def _encode_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(sizes.sum())), sizes

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces: many in one call, cut apart where a piece begins or ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([self._join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        sizes = self._cut(ids)
        return (ids, sizes) if len(sizes) == len(pieces) else self._encode_each(pieces)

    def _learn_letters(self, words: list[str]) -> None:
        for k in range(0, len(words), _JOINED):
            some = words[k:k + _JOINED]
            first = self._add_atoms(*self._joined(some))
            self.letters.update(zip(some, range(first, first + len(some))))

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Codes of pieces not seen before."""
        found = [self._simple(p) for p in pieces]
        self._learn_letters(list({f[1] for f in found if f}.difference(self.letters)))
        for end in {f[2] for f in found if f}.difference(self.ends):
            self.ends[end] = self._add_atoms(*self._encode_each([end]))
        other = [p for p, f in zip(pieces, found) if not f]
        atoms: dict[str, int] = {}
        for encode, kind in ((self._joined, [p for p in other if self._begins_alone(p)]),
                             (self._encode_each, [p for p in other if not self._begins_alone(p)])):
            for k in range(0, len(kind), _JOINED):
                some = kind[k:k + _JOINED]
                first = self._add_atoms(*encode(some))
                atoms.update(zip(some, range(first, first + len(some))))
        letters, ends = self.letters, self.ends
        return np.array([letters[f[1]] << 32 | ends[f[2]] if f else atoms[p] << 32 for p, f in zip(pieces, found)], np.int64)

    def _codes(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        hashes, at, back = np.unique(hash_spans(data, starts, stops), return_index=True, return_inverse=True)
        slot = np.searchsorted(self.hashes, hashes)
        if len(self.hashes):
            new = self.hashes[np.minimum(slot, len(self.hashes) - 1)] != hashes
        else:
            new = np.ones(len(hashes), bool)
        if new.any():
            raw = data.tobytes()
            pieces = [raw[a:b].decode() for a, b in zip(starts[at[new]].tolist(), stops[at[new]].tolist())]
            learned = self._learn(pieces)
            self.codes = np.insert(self.codes, slot[new], learned)
            self.hashes = np.insert(self.hashes, slot[new], hashes[new])
            slot = np.searchsorted(self.hashes, hashes)
        return self.codes[slot][back]

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids per text. Null counts as empty."""
        if self.cached_bytes() > CACHE_BYTES:
            self._clear()
        texts = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string())
        data, bounds = text_bytes(texts)
        whole = odd_texts(data, bounds).tolist() if self._may_be_odd else []
        starts, stops = self._spans(data, bounds)
        codes = self._codes(data, starts, stops)
        atoms = np.empty(2 * len(codes), np.int64)
        atoms[0::2], atoms[1::2] = codes >> 32, codes & 0xFFFFFFFF
        sizes = self.sizes[atoms]
        upto = np.cumsum(sizes)
        ids = self.ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.starts[atoms] - upto + sizes, sizes)]
        ends = np.concatenate([[0], upto])[2 * np.searchsorted(starts, bounds)]
        if whole:
            parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
            for i in whole:
                parts[i] = self._encode_each([texts[i].as_py()])[0]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, np.diff(ends)


class WordEncoder(Encoder):
    """For the tokenizer that lower-cases and drops white space; words end in marked tokens."""

    _may_be_odd = False

    @staticmethod
    def _begins_alone(piece: str) -> bool:
        return False

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        form = re.compile(f"({_LETTERS})({_ENDS})")
        self._form = form.fullmatch

    def _spans(self, data, bounds):
        return spans(data, bounds)

    def _simple(self, piece: str):
        found = self._form(piece)
        return found and (piece, found[1].lower(), found[2])

    def _join(self, words: list[str]) -> str:
        return " ".join(words)

    def _cut(self, ids: np.ndarray) -> np.ndarray:
        return np.diff(np.flatnonzero(self.last[ids]), prepend=-1)


class ByteEncoder(Encoder):
    """For the byte-level tokenizer; a piece is a space and what follows up to the next one."""

    _may_be_odd = True

    @staticmethod
    def _begins_alone(piece: str) -> bool:
        """Whether the piece begins with its own space, so that it may follow any other."""
        return piece[0] == " " and "\n" not in piece

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab()
        self.first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.first[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self._simple = re.compile(f"( {_LETTERS})({_ENDS})").fullmatch

    def _spans(self, data, bounds):
        begins = data == 0x20
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(begins)
        return starts, np.append(starts[1:], len(data))

    def _join(self, words: list[str]) -> str:
        return "".join(words)

    def _cut(self, ids: np.ndarray) -> np.ndarray:
        return np.diff(np.flatnonzero(self.first[ids]), append=len(ids))
