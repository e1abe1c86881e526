"""Byte-level BPE ids of whole Arrow chunks.

The pre-tokeniser's pattern (contractions, then letters, digits or other signs with one space before them, then white space) is
evaluated with array operations on code points. Equal pieces are encoded once and kept, up to a bound, so that the encoder
sees each new piece only. The ids are those of the tokenizers library for the same vocabulary: the vocabulary's added tokens are
cut out of the text first, and what lies between them is read as if it stood alone.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from itertools import chain

import numpy as np

from .textops import Chunk, Hasher

_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 0
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_MOST_PIECES = 300_000
_loaded: dict = {}


def _classes() -> np.ndarray:
    if "classes" not in _loaded:
        kinds = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
        table = np.where(kinds == ord("L"), _LETTER, np.where(kinds == ord("N"), _DIGIT, _OTHER)).astype(np.uint8)
        table[_WHITE] = _SPACE
        _loaded["classes"] = table
    return _loaded["classes"]


class Encoder:
    """``ranks``: path of a file of base64 tokens and their ranks; ``pattern``: the encoder's own pattern, used for single pieces; ``added``: (text, id) of added tokens."""

    def __init__(self, ranks: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(ranks, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.known: dict[int, list[int]] = {}
        self.added = {text.encode(): i for text, i in added}
        self.finder = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if added else None

    @classmethod
    def shared(cls, *key) -> Encoder:
        """One for each worker process."""
        if key not in _loaded:
            _loaded[key] = cls(*key)
        return _loaded[key]

    def ends_sentence(self) -> np.ndarray:
        """By id: does a sentence or line end after this token."""
        if "ends" not in _loaded:
            ends = np.zeros(max([*self.ranks.values(), *self.added.values()]) + 1, bool)
            for piece, i in self.ranks.items():
                ends[i] = b"\n" in piece or piece.rstrip().endswith((b".", b"!", b"?"))
            _loaded["ends"] = ends
        return _loaded["ends"]

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, and where each text's begin (one more than texts)."""
        cuts = self._added_places(c)
        begins, owner_at = _pieces(c, cuts)
        if not len(begins):
            return np.zeros(0, np.int32), np.zeros(c.n + 1, np.int64)
        ends = np.append(begins[1:], len(c.data))
        ends = np.minimum(ends, c.offsets[1:][owner_at])
        hashes = Hasher(c.data).ranges(begins, ends)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > _MOST_PIECES:
            self.known.clear()
        known, lists = self.known, []
        for key, at in zip(keys.tolist(), first.tolist(), strict=True):
            ids = known.get(key)
            if ids is None:
                piece = c.data[begins[at] : ends[at]].tobytes()
                ids = known[key] = [self.added[piece]] if piece in self.added else self.bpe.encode_ordinary(piece.decode())
            lists.append(ids)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
        place = np.cumsum(sizes) - sizes
        each = sizes[which]
        upto = np.cumsum(each)
        ids = flat[np.arange(upto[-1]) + np.repeat(place[which] - (upto - each), each)]
        counts = np.bincount(owner_at, weights=each, minlength=c.n).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])


    def _added_places(self, c: Chunk) -> np.ndarray:
        """(begin, end) of added tokens, which never reach from one text into the next."""
        if not self.finder:
            return np.zeros((0, 2), np.int64)
        found = np.array([m.span() for m in self.finder.finditer(c.data.tobytes())], np.int64).reshape(-1, 2)
        inside = np.searchsorted(c.offsets, found[:, 0], "right") == np.searchsorted(c.offsets, found[:, 1], "left")
        if inside.all():
            return found
        spans = [m.span() for i in range(c.n) for m in self.finder.finditer(c.bytes_of(i))]
        owners = [i for i in range(c.n) for _ in self.finder.finditer(c.bytes_of(i))]
        return np.array(spans, np.int64).reshape(-1, 2) + c.offsets[np.array(owners, np.int64)][:, None]


def _pieces(c: Chunk, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces begin (bytes), and the text of each. ``cuts``: stretches that are one piece each."""
    if not len(c.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((c.data & 0xC0) != 0x80)  # bytes at which code points begin
    points = np.frombuffer(c.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind, n = _classes()[points], len(points)
    text_start = np.zeros(n + 1, bool)
    text_start[np.searchsorted(at, c.offsets)] = True
    text_start[np.searchsorted(at, cuts.ravel())] = True
    text_start = text_start[:-1]
    start = text_start.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after_white = np.zeros(n, bool)  # something else after white space, in the same text
    after_white[1:] = (kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~text_start[1:]
    i = np.flatnonzero(after_white)
    start[i - 1] = True  # the last white space stands alone, or, if it is a blank, goes with what follows
    start[i[points[i - 1] == 0x20]] = False
    _contractions(points, kind, start, text_start)
    for a, b in np.searchsorted(at, cuts).tolist():
        start[a + 1 : b] = False
    begins = at[start]
    return begins, np.searchsorted(c.offsets, begins, "right") - 1


def _contractions(points: np.ndarray, kind: np.ndarray, start: np.ndarray, text_start: np.ndarray) -> None:
    n = len(points)
    for i in np.flatnonzero((points == 0x27) & start).tolist():
        if i + 1 >= n or text_start[i + 1]:
            continue
        a = chr(points[i + 1])
        b = chr(points[i + 2]) if i + 2 < n and not text_start[i + 2] else ""
        size = 1 if a in "stmd" else 2 if a + b in ("re", "ve", "ll") else 0
        if size:
            start[i + 1] = False
            after = i + 1 + size
            if after < n and kind[after] == _LETTER:
                start[after] = True
