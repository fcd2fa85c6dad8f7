"""Cutting texts where no token can cross, so that a tokenizer sees each distinct chunk of a group of texts once.

The pre-tokenizers used here cut a text by the pattern of byte-level BPE, in which a piece is an optional space with
letters, digits or other signs, or a run of white space that leaves its last space to a following word. A piece thus
never crosses the point before a space that has a non-space sign on its left or on its right:

* on the right: the white space before it gives up exactly that space, whatever it is;
* on the left: pieces of signs never take a space at their end.

The tokens of a text are therefore the tokens of its chunks in order. Only spaces inside longer white space are not cut.
A word of ASCII letters and a stop at
its end are two pieces, so the word is remembered without the stop. Cutting, finding the distinct chunks and laying out their ids work on whole Arrow columns; Python sees distinct chunks.

``Pieces`` cuts further, for the pattern of GPT-2 only, in which letters never lead to another sign and a line break is
a piece of its own where it stands alone:

* behind letters, before a sign that is neither letter nor digit;
* behind one line break between two signs that are no white space.

It cuts by pairs of bytes and decides only by what is certain from them; where it is not, the chunk is longer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tactus.llm.common import strings

#: A space with white space on both sides is no cut. Python's \s holds all white space of the tokenizers and more.
_CUT = re.compile(r"(?<!\s) | (?!\s)")
#: Bytes that may end a white-space sign on the left of a space, and that may begin one on its right.
_BEFORE = np.array([9 <= b <= 13 or 28 <= b <= 32 or b >= 0x80 for b in range(256)])
_AFTER = np.array([9 <= b <= 13 or 28 <= b <= 32 or b in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])

#: Entries of one generation, the longest chunk that is kept, and bytes handled at a time: a worker's memory bound.
CACHE_ENTRIES = 450_000
CACHE_CHARS = 48
GROUP_BYTES = 1 << 24
STOPS = ".,;:!?"


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each text's bounds in them."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def groups(texts: pa.Array, size: int | None = None) -> Iterator[pa.Array]:
    """The column in slices of about ``size`` bytes, GROUP_BYTES at most, one text at least."""
    size = min(size or GROUP_BYTES, GROUP_BYTES)
    if not len(texts):
        return
    _, ends = _bytes(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size)) - 1)
        yield texts.slice(first, last - first)
        first = last


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Each text's chunks, and which text is where: those that may hold a space inside white space go last."""
    data, ends = _bytes(texts)
    at = np.flatnonzero((data[1:-1] == 32) & _BEFORE[data[:-2]] & _AFTER[data[2:]]) + 1
    slow = np.zeros(len(texts), bool)
    slow[np.searchsorted(ends, at, "right") - 1] = True
    if not slow.any():
        return pc.split_pattern(texts, " "), np.arange(len(texts))
    plain = pc.split_pattern(texts.filter(pa.array(~slow)), " ")
    rest = pa.array([_CUT.split(x) for x in texts.filter(pa.array(slow)).to_pylist()], plain.type)
    return pa.concat_arrays([plain, rest]), np.concatenate([np.flatnonzero(~slow), np.flatnonzero(slow)])


#: Classes of bytes: signs, space, line break, what may be white space, ASCII letters and digits; first bytes of characters
#: of which some are white space, and of others; and further bytes of characters.
_SIGN, _SPACE, _BREAK, _BLANK, _LETTER, _DIGIT, _WIDE, _LEAD, _INNER = range(9)


def _class(b: int) -> int:
    if b >= 0x80:
        return _INNER if b < 0xC0 else _WIDE if b in (0xC2, 0xE1, 0xE2, 0xE3) else _LEAD
    if b == 32 or b == 10:
        return _SPACE if b == 32 else _BREAK
    return _BLANK if 9 <= b <= 13 or 28 <= b <= 31 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN


#: What a pair of classes says of the point between its bytes: no cut, a cut, or what else must hold for one.
_NONE, _SURE, _IF_SPACE, _IF_LETTER, _IF_ALONE = range(5)


def _point(left: int, right: int) -> int:
    if right == _SPACE:
        return _SURE if left in (_SIGN, _LETTER, _DIGIT) else _IF_SPACE
    if right in (_SIGN, _BREAK) and left in (_LETTER, _INNER):
        return _SURE if left == _LETTER else _IF_LETTER
    return _IF_ALONE if left == _BREAK and right in (_SIGN, _LETTER, _DIGIT, _LEAD) else _NONE


_CLASSES = bytes(map(_class, range(256)))
_POINTS = bytes(_point(b >> 4, b & 15) for b in range(256))
_CLASS = np.frombuffer(_CLASSES, np.uint8)


def _no_blank_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place, one of several bytes or of ASCII, is certainly no white space."""
    c, b, a = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    blank = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0)) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    kind = _CLASS[c]
    return (kind == _INNER) & ~blank | (kind == _SIGN) | (kind == _LETTER) | (kind == _DIGIT)


def _no_blank_behind(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins at each place is certainly no white space."""
    a, b = (data[np.minimum(at + k, len(data) - 1)] for k in (0, 1))
    kind = _CLASS[a]
    wide = (a == 0xC2) & (b != 0x85) & (b != 0xA0) | (a == 0xE1) & (b != 0x9A) & (b != 0xA0) | (a == 0xE2) & (b != 0x80) & (b != 0x81) | (a == 0xE3) & (b != 0x80)
    return wide | (kind == _SIGN) | (kind == _LETTER) | (kind == _DIGIT) | (kind == _LEAD)


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, as slices of the same bytes, and the bounds of each text's."""
    data, ends = _bytes(texts)
    kinds = np.frombuffer(data.tobytes().translate(_CLASSES), np.uint8)
    point = np.zeros(len(data), np.uint8)
    if len(data) > 1:
        point[1:] = np.frombuffer((kinds[:-1] << 4 | kinds[1:]).tobytes().translate(_POINTS), np.uint8)
    first = np.zeros(len(data) + 1, bool)
    first[ends] = True
    unsure = np.flatnonzero(point > _SURE)
    why = point[unsure]
    at = unsure[why == _IF_SPACE]
    point[at] = _no_blank_before(data, at) | ~first[at + 1] & _no_blank_behind(data, at + 1)
    at = unsure[why == _IF_LETTER]  # U+00C0 to U+027F are letters but for two signs
    c, b = data[at - 1], data[np.maximum(at - 2, 0)]
    point[at] = (b >= 0xC3) & (b <= 0xC9) & ~((b == 0xC3) & ((c == 0x97) | (c == 0xB7)))
    at = unsure[why == _IF_ALONE]
    point[at] = _no_blank_before(data, at - 1)
    point[first[:-1]] = _SURE
    cuts = np.flatnonzero(point)
    offsets = np.append(cuts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(cuts), pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(cuts, ends)


class Chunks:
    """Encodes texts chunk by chunk. ``known[w]`` is the encoding of a space and w; recent short chunks are remembered
    in two generations, and those new in a group of texts go to ``encode_many`` together."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], width: int, entries: int = CACHE_ENTRIES, group_bytes: int | None = None):
        self.encode_many, self.width, self.entries, self.group_bytes = encode_many, width, entries, group_bytes
        #: Signs that are a piece of their own behind letters, at a chunk's end.
        self.stops = dict(zip(STOPS, encode_many(list(STOPS))))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The encodings of distinct words, each behind a space."""
        if len(self.known) >= self.entries:
            self.older, self.known = self.known, {}
        out = list(map(self.known.get, words))
        ended, unknown, fresh = [], [], {}
        for i in [i for i, ids in enumerate(out) if ids is None]:
            w = words[i]
            if w[-1:] in self.stops and (own := w[:-1]).isascii() and own.isalpha():
                ended.append((i, own))
                w = own
                if w in self.known:
                    continue
            else:
                unknown.append(i)
            if (ids := self.older.get(w)) is None:
                fresh[w] = b""
            else:
                self.known[w] = ids
        fresh.update(zip(fresh, self.encode_many([" " + w for w in fresh])))
        self.known.update({w: ids for w, ids in fresh.items() if len(w) <= CACHE_CHARS})
        for i in unknown:
            out[i] = fresh.get(words[i]) or self.known[words[i]]
        for i, own in ended:
            out[i] = (fresh.get(own) or self.known[own]) + self.stops[words[i][-1]]
        return out

    def group(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all texts in order, each followed by ``end``, and the bounds of each text's."""
        lists, order = _cut(texts)
        first = lists.offsets.to_numpy()
        heads, words = first[:-1], lists.values
        is_head = np.zeros(len(words), bool)
        is_head[heads] = True
        found = pc.if_else(pa.array(is_head), pa.scalar(None, words.type), words).dictionary_encode()
        codes = found.indices.fill_null(0).to_numpy().astype(np.int64)
        codes[heads] = len(found.dictionary) + np.arange(len(heads))
        entries = [*self._encoded(strings(found.dictionary)), *self.encode_many(strings(words.take(pa.array(heads)))), end]
        # the columns in the order of the texts, each with the end behind it
        back = np.argsort(order, kind="stable")
        sizes = np.diff(first)[back] + 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(bounds[-1]) + np.repeat(heads[back] - bounds[:-1], sizes)
        at[bounds[1:] - 1] = 0
        codes = codes[at] if len(codes) else at
        codes[bounds[1:] - 1] = len(entries) - 1
        lengths = np.fromiter(map(len, entries), np.int64, len(entries)) // self.width
        starts = np.cumsum(lengths) - lengths
        own = lengths[codes]
        ends = np.cumsum(own)
        ids = np.frombuffer(b"".join(entries), f"<u{self.width}")[np.repeat(starts[codes] - (ends - own), own) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends[bounds[1:] - 1]])

    def texts(self, texts: pa.Array, end: bytes = b"") -> Iterator[np.ndarray]:
        """The ids of each text."""
        for part in groups(texts, self.group_bytes):
            ids, bounds = self.group(part, end)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield ids[a:b]


class Pieces(Chunks):
    """Chunks for the pattern of GPT-2, cut also behind letters and line breaks, so that fewer of them differ. ``known[w]`` is the
    encoding of a space and w, ``bare[w]`` that of w itself, both in two generations."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], width: int, entries: int = CACHE_ENTRIES, group_bytes: int | None = None):
        super().__init__(encode_many, width, entries - entries // 8, group_bytes)
        self.bare_entries = entries // 8
        self.bare: dict[str, bytes] = {}
        self.older_bare: dict[str, bytes] = {}

    def _remembered(self, words: list[str], known: dict[str, bytes], older: dict[str, bytes], before: str) -> list[bytes]:
        """The encodings of distinct words behind ``before``, the new ones remembered in ``known``."""
        out = list(map(known.get, words))
        fresh = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            if (ids := older.get(words[i])) is None:
                fresh.append(i)
            else:
                out[i] = known[words[i]] = ids
        new = [words[i] for i in fresh]
        for i, w, ids in zip(fresh, new, self.encode_many([before + w for w in new] if before else new)):
            out[i] = ids
            if len(w) <= CACHE_CHARS:
                known[w] = ids
        return out

    def group(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        chunks, bounds = _pieces(texts)
        found = chunks.dictionary_encode()
        spaced = pc.starts_with(found.dictionary, " ")
        if len(self.known) >= self.entries:
            self.older, self.known = self.known, {}
        if len(self.bare) >= self.bare_entries:
            self.older_bare, self.bare = self.bare, {}
        entries = self._remembered(strings(pc.utf8_slice_codeunits(found.dictionary.filter(spaced), 1)), self.known, self.older, " ")
        own = spaced.to_numpy(zero_copy_only=False)
        place = np.where(own, np.cumsum(own) - 1, len(entries) + np.cumsum(~own) - 1)
        entries += self._remembered(strings(found.dictionary.filter(pc.invert(spaced))), self.bare, self.older_bare, "")
        codes = place[found.indices.to_numpy()]
        if end:
            codes = np.insert(codes, bounds[1:], len(entries))
            bounds = bounds + np.arange(len(bounds))
            entries.append(end)
        laid = pa.array(entries, pa.large_binary()).take(pa.array(codes, pa.int64()))
        ends = np.frombuffer(laid.buffers()[1], np.int64)[: len(codes) + 1]
        return np.frombuffer(laid.buffers()[2] or b"", f"<u{self.width}", int(ends[-1]) // self.width), ends[bounds] // self.width
