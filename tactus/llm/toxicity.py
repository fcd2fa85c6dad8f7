"""Toxicity by a subsequence string kernel over sentences, Nyström landmarks and a support vector machine.

A sentence is the set of its parts: the letters and digits of each word, runs of single signs read together ("i d i o t")
and neighbours of two or three signs read together ("id iot"). Two parts are compared by their subsequences of three
characters within SPAN characters, each weighted by DECAY for every character skipped, so "i.d.i.o.t", "idiiot" or
"mxoxrxoxn" still share much of "idiot" or "moron"; the kernel of two parts is a power of the normed sum, and the kernel
of two sentences the sum over the pairs of their parts. The same kernel serves in fitting and in scoring, without a cut.

Landmarks are one-part sentences: among the parts that tell labelled texts apart, those that a pivoted Cholesky
decomposition finds least alike. With their kernel matrix M a sentence's features are M^-1/2 k(sentence, landmarks), and a
squared-hinge machine is solved on them by Newton steps. Labels are of texts, sentences have none: the machine learns
from each toxic text's worst sentence under the machine before (at first under the parts' log odds), from each clean text's
worst sentence of every round, and from one of its sentences by hash. A text is as toxic as its worst sentence, in which
the parts add up, so two words may be an insult that neither is. A cut and a slope from the training texts' margins turn
a margin into a score from 0 to 1.

Training sees only labelled texts outside the held-out fold, at most MAX_LABELLED of them by a hash, whole. The driver
gets LANDMARKS numbers for a text and CANDIDATES parts, never texts.

Edge cases: a null or empty text, and one without letters, has no sentence and gets less than the bias; labels other than
0 and 1 are ignored; repeated ids take the larger label and each of their texts is an example, but texts with the same
sign (the least hash of three words: copies) are one; if no part tells toxic texts apart all scores are 0.1; repeated rows
score equally; sentences of more than SENTENCE words and parts of more than PART characters are read in pieces that
overlap by half, so texts of any length are read whole; other columns, whatever their names, are not read; of equally bad
sentences the first counts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import string
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm.common import let, no_null, strings, table, written

FOLDS = 5
#: The most labelled texts that training reads.
MAX_LABELLED = 20_000
#: Parts that may become landmarks, of each class, and landmarks of toxic and of clean texts.
CANDIDATES = 1_000
LANDMARKS = (96, 32)
ROUNDS = 3

SPAN = 6
DECAY = 0.7
DAMPING = 3.0
#: The kernel is this power of the normed sum over subsequences: parts that share little count for little.
POWER = 3
SENTENCE = 40
PART = 24
#: Margins of words that one of two generations remembers, the longest such word, and characters of text handled at a time.
CACHE = 400_000
CACHE_CHARS = 48
GROUP_CHARS = 1 << 22
#: Parts whose kernel values are computed together, and training texts whose examples are.
TOGETHER = 2048
AT_ONCE = 256

_SIGN = re.compile(r"[\W_]+")
_LONG_RUN = re.compile(r"(.)\1{2,}")
_BETWEEN = re.compile(r".(.)(?:.\1)+.?")
#: White space of one byte in UTF-8, the signs that end a sentence, and all other white space.
_SPACE = np.array([9 <= b <= 13 or 28 <= b <= 32 for b in range(256)])
_STOP = np.array([chr(b) in ".!?" for b in range(256)])
_WIDE_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SIGNS = 32
#: Middle and last character of a subsequence, counted from its first, and the weight by the last.
_SHAPES = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
_WEIGHTS = np.array([DECAY ** (k - 2) for k in range(2, SPAN)])


def _alphabet() -> np.ndarray:
    """Letters by their base letter, one code for other letters and one for digits; 0 is no character."""
    out = np.zeros(1 << 16, np.int32)
    for point in range(1, 1 << 16):
        sign = chr(point)
        if sign.isalnum():
            base = unicodedata.normalize("NFKD", sign)[0].lower()
            out[point] = ord(base) - 96 if "a" <= base <= "z" else 28 if base.isdigit() else 27
    out[ord("^")] = 29
    return out


_CODES = _alphabet()


def _subsequences(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, subsequence, weight) of all parts, sorted, each with a start mark, and each part's norm."""
    lengths = np.array([len(p) + 1 for p in parts])
    points = np.frombuffer("".join(["^" + p for p in parts]).encode("utf-32-le"), "<u4")
    kind = np.int32 if len(parts) * _SIGNS**3 * len(_WEIGHTS) < 1 << 31 else np.int64
    x = np.where(points < 1 << 16, _CODES[np.minimum(points, (1 << 16) - 1)], 27).astype(kind)
    of = np.repeat(np.arange(len(parts), dtype=kind), lengths)
    first, keys = of * _SIGNS + x, []
    for j, k in _SHAPES:
        key = ((first[:-k] * _SIGNS + x[j : j - k]) * _SIGNS + x[k:]) * len(_WEIGHTS) + (k - 2)
        keys.append(key[of[k:] == of[:-k]])
    key = np.concatenate(keys)
    key.sort()
    weight = key % len(_WEIGHTS)  # each with its weight's number
    key //= len(_WEIGHTS)
    new = np.flatnonzero(np.diff(key, prepend=-1))
    key, weight = key[new], np.add.reduceat(_WEIGHTS[weight], new) if len(new) else np.zeros(0)
    part = key // _SIGNS**3
    norm = np.sqrt(DAMPING + np.bincount(part, weight**2, len(parts)))
    return part, key % _SIGNS**3, weight, norm


def _pieces(items: list | str, most: int) -> list:
    """The whole, or pieces of ``most`` that overlap by half."""
    if len(items) <= most:
        return [items]
    return [items[i : i + most] for i in range(0, len(items) - most // 2, most // 2)]


def plain(word: str) -> str:
    """The word's letters and digits."""
    word = word.strip(string.punctuation)
    return word if word.isalnum() else _SIGN.sub("", word)


def parts_of(word: str) -> list[str]:
    """What the kernel compares of a word: its letters and digits, in pieces if it is long; also with long runs of a sign
    as one, and without a sign that stands between all others."""
    own = word if word.isalnum() else plain(word)
    if len(own) < 2:
        return []
    parts = [own] if len(own) <= PART else list(dict.fromkeys(_pieces(own, PART)))
    if _LONG_RUN.search(own):
        parts += _pieces(_LONG_RUN.sub(r"\1", own), PART)
    if own[1:2] == own[3:4] and _BETWEEN.fullmatch(own):
        parts += _pieces(own[::2], PART)
    return parts


class Read(NamedTuple):
    """The sentences of some texts: the distinct words of all, which of them each sentence has, each once and in order,
    the sentences' bounds in that, and the texts' bounds in the sentences."""

    words: list[str]
    codes: np.ndarray
    bounds: np.ndarray
    texts: np.ndarray

    def sentence(self, i: int) -> list[str]:
        return [self.words[c] for c in self.codes[self.bounds[i] : self.bounds[i + 1]].tolist()]


def read(texts: list[str]) -> Read:
    """The texts' sentences, which end at a line's end or after a stop; sentences of more than SENTENCE words in pieces.
    Texts are cut as bytes of one array, so Python sees each distinct word of all texts once."""
    held = [(x.lower() if x.isascii() else _WIDE_SPACE.sub(" ", x.lower())).encode() for x in texts]
    data = np.frombuffer(b"\n".join([b"", *held, b""]), np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, behind = edges[::2], edges[1::2]
    if not len(first):
        return Read([], np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64))
    offsets = np.concatenate([[0], np.cumsum(behind - first)])
    found = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])]).dictionary_encode()
    words, sizes = strings(found.dictionary), pc.utf8_length(found.dictionary).to_numpy()
    codes = found.indices.to_numpy().astype(np.int64)
    last = _STOP[data[behind - 1]]
    ended = np.searchsorted(first, np.flatnonzero(data == 10)) - 1  # the word before each line's end
    last[ended[ended >= 0]] = True
    # pieces that overlap by half
    stop = np.flatnonzero(last) + 1
    begin, half = np.concatenate([[0], stop[:-1]]), SENTENCE // 2
    many = np.where(stop - begin <= SENTENCE, 1, -(-(stop - begin - half) // half))
    begin = np.repeat(begin, many) + half * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    length = np.minimum(np.repeat(stop, many) - begin, SENTENCE)
    starts = np.cumsum(length) - length
    piece = np.repeat(np.arange(len(length)), length)
    codes = codes[np.arange(len(piece)) + np.repeat(begin - starts, length)]
    ends = np.concatenate([[0], np.cumsum([len(x) + 1 for x in held])])
    bounds = np.searchsorted(begin, np.searchsorted(first, ends))
    # joined words stand behind their piece's own
    joined, at = _joined(words, found.dictionary, sizes, codes, piece)
    if len(at):
        piece = np.concatenate([piece, piece[at]])
        order = np.argsort(piece, kind="stable")
        codes, piece = np.concatenate([codes, joined])[order], piece[order]
        length = np.bincount(piece, minlength=len(length))
        starts = np.cumsum(length) - length
    # each word once, where it stands first
    wide, deep = len(words), int(length.max())
    key = np.sort((piece * wide + codes) * deep + np.arange(len(piece)) - np.repeat(starts, length))
    again = key[1:][key[1:] // deep == key[:-1] // deep]
    again_in = again // (wide * deep)
    keep = np.ones(len(codes), bool)
    keep[starts[again_in] + again % deep] = False
    length = length - np.bincount(again_in, minlength=len(length))
    return Read(words, codes[keep], np.concatenate([[0], np.cumsum(length)]), bounds)


def _joined(words: list[str], known: pa.Array, sizes: np.ndarray, codes: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of short neighbours, and runs of three or more single signs, each as one word: its code and where it begins.
    New words are appended to ``words``, which begins as the column ``known``."""
    size = sizes[codes]
    short = size < 4
    pair = np.flatnonzero(short[:-1] & short[1:] & (size[:-1] + size[1:] > 3) & (piece[:-1] == piece[1:]))
    key, which = np.unique(codes[pair] * len(sizes) + codes[pair + 1], return_inverse=True)
    texts = [words[a] + words[b] for a, b in zip((key // len(sizes)).tolist(), (key % len(sizes)).tolist())]
    single = np.flatnonzero(size == 1)
    edges = np.flatnonzero((np.diff(single) > 1) | (np.diff(piece[single]) > 0)) + 1
    run, end = np.concatenate([[0], edges]), np.concatenate([edges, [len(single)]])
    long = end - run > 2
    run, many = single[run[long]] if len(single) else np.zeros(0, np.int64), (end - run)[long]
    signs = "".join([words[c] for c in codes[np.repeat(run - (np.cumsum(many) - many), many) + np.arange(many.sum())].tolist()])
    runs = [signs[b - n : b] for b, n in zip(np.cumsum(many).tolist(), many.tolist())]
    if not texts and not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = pa.array(texts + runs, known.type)
    out = pc.index_in(both, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
    fresh = np.flatnonzero(out < 0)
    new = both.take(pa.array(fresh)).dictionary_encode()
    out[fresh] = len(words) + new.indices.to_numpy()
    words += strings(new.dictionary)
    return np.concatenate([out[: len(texts)][which], out[len(texts) :]]), np.concatenate([pair, run])


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence."""
    cut = read([text])
    return [cut.sentence(i) for i in range(len(cut.bounds) - 1)]


def grouped(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in groups of about GROUP_CHARS, one text at least."""
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


class Landmarks:
    """The kernel between parts and some landmarks."""

    def __init__(self, marks: list[str]):
        self.marks = marks
        of, sub, weight, norm = _subsequences(marks)
        order = np.argsort(sub, kind="stable")
        #: For each subsequence which landmarks have it, from first to first + many, and how much of it.
        self.of, self.value = of[order], weight[order] / norm[of[order]]
        self.many = np.bincount(sub, minlength=_SIGNS**3)
        self.first = np.cumsum(self.many) - self.many

    def kernel(self, parts: list[str]) -> np.ndarray:
        """(parts x landmarks)."""
        size = len(self.marks)
        out = np.empty((len(parts), size))
        for begin in range(0, len(parts), TOGETHER):
            of, sub, weight, norm = _subsequences(parts[begin : begin + TOGETHER])
            many = self.many[sub]
            hit = np.flatnonzero(many)
            many = many[hit]
            at = np.repeat(self.first[sub[hit]] - (np.cumsum(many) - many), many)
            at += np.arange(len(at))
            cell = np.repeat(of[hit].astype(np.int64) * size, many)
            cell += self.of[at]
            both = np.repeat(weight[hit], many)
            both *= self.value[at]
            shared = np.bincount(cell, both, len(norm) * size).reshape(-1, size) / norm[:, None]
            out[begin : begin + TOGETHER] = shared**POWER if POWER != 3 else shared * shared * shared
        return out

    def weighed(self, parts: list[str], weights: np.ndarray) -> np.ndarray:
        """``kernel(parts) @ weights``, without all of the kernel at once."""
        steps = [self.kernel(parts[i : i + TOGETHER]) @ weights for i in range(0, len(parts), TOGETHER)]
        return np.concatenate(steps) if steps else np.zeros(0)

    def words(self, words: list[str], value) -> np.ndarray:
        """For each word the sum over its parts of ``value``, which maps parts to an array."""
        parts = [parts_of(w) for w in words]
        flat = [p for own in parts for p in own]
        number = {p: i for i, p in enumerate(dict.fromkeys(flat))}
        values = value(list(number))
        if not number:
            return np.zeros((len(words), *values.shape[1:]))
        rows = values[list(map(number.__getitem__, flat))]
        sizes = np.array(list(map(len, parts)))
        out = np.zeros((len(words), *values.shape[1:]))
        out[sizes > 0] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[sizes > 0], axis=0)
        return out

    def sentence(self, words: list[str]) -> np.ndarray:
        return self.words(words, self.kernel).sum(axis=0)

    def sentences(self, many: list[list[str]]) -> np.ndarray:
        """``sentence`` of each, with each distinct word once."""
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(many)))}
        values = self.words(list(number), self.kernel)
        return np.array([values[[number[w] for w in words]].sum(axis=0) if words else np.zeros(len(self.marks)) for words in many])


def _machine(features: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """A squared-hinge support vector machine, bias last, by Newton steps that are halved until they improve."""
    x = np.hstack([features, np.ones((len(features), 1))])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6

    def loss(w: np.ndarray) -> float:
        return float(w @ penalty @ w + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        inside = y * (x @ w) < 1
        own = x[inside] * weight[inside, None]
        step = np.linalg.solve(penalty + own.T @ x[inside], own.T @ y[inside]) - w
        size = 1.0
        while size > 1e-6 and loss(w + size * step) >= now:
            size /= 2
        then = loss(w + size * step)
        if size <= 1e-6 or now - then < 1e-9 * now:
            break
        w, now = w + size * step, then
    return w


def _variants(word: str) -> list[str]:
    """The word with characters inserted: one, one doubled, and one between all."""
    half = len(word) // 2
    return [word[:half] + "x" + word[half:], word[:half] + word[half - 1 : half] + word[half:], "x".join(word)]


class Model:
    """A weight for each landmark, the bias, and the cut and slope of a text's score."""

    def __init__(self, landmarks: Landmarks, weights: np.ndarray, bias: float, cut: float = 0.0, slope: float = 1.0):
        self.landmarks, self.weights, self.bias, self.cut, self.slope = landmarks, weights, bias, cut, slope

    @classmethod
    def solved(cls, landmarks: Landmarks, marked: int, toxic: np.ndarray, clean: np.ndarray) -> Model:
        """From the kernel rows of example sentences. The first ``marked`` landmarks are of toxic texts: with inserted
        characters they are examples too, of little weight."""
        value, vector = np.linalg.eigh(landmarks.kernel(landmarks.marks))
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        inserted = landmarks.kernel([v for m in landmarks.marks[:marked] for v in _variants(m)])
        y = np.repeat([1.0, 1.0, -1.0], [len(toxic), len(inserted), len(clean)])
        weight = np.repeat([1.0, 0.2 * len(toxic) / max(1, len(inserted)), 1.0], [len(toxic), len(inserted), len(clean)])
        weight[y > 0] *= len(clean) / weight[y > 0].sum()
        w = _machine(np.vstack([toxic, inserted, clean]) @ root, y, weight)
        return cls(landmarks, root @ w[:-1], float(w[-1]))

    @classmethod
    def fitted(cls, landmarks: list[str], toxic: list[str], clean: list[str]) -> Model:
        """From example sentences."""
        marks = Landmarks(landmarks)
        toxic, clean = (np.array([marks.sentence(s) for x in texts for s in sentences(x)]) for texts in (toxic, clean))
        return cls.solved(marks, len(landmarks), toxic, clean)

    def __reduce__(self):
        return _rebuilt, (self.landmarks.marks, self.weights, self.bias, self.cut, self.slope)

    def margins(self, words: list[str]) -> np.ndarray:
        """What each word adds to a sentence's margin."""
        return self.landmarks.words(words, lambda parts: self.landmarks.weighed(parts, self.weights))

    def calibrate(self, margins: np.ndarray, toxic: np.ndarray) -> None:
        """The cut with the fewest errors, in the middle of the widest such gap; the slope from the classes' distance."""
        order = np.argsort(margins, kind="stable")
        m, t = margins[order], toxic[order]
        errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
        edges = np.concatenate([[m[0] - 1], m, [m[-1] + 1]])
        gaps = np.where(errors == errors.min(), edges[1:] - edges[:-1], -1)
        at = int(gaps.argmax())
        self.cut = float((edges[at] + edges[at + 1]) / 2)
        apart = abs(float(np.median(m[t == 1]) - np.median(m[t == 0]))) if 0 < t.sum() < len(t) else 1.0
        self.slope = 8 / max(apart, 1e-3)


def _rebuilt(marks: list[str], weights: np.ndarray, bias: float, cut: float, slope: float) -> Model:
    return Model(Landmarks(marks), weights, bias, cut, slope)


class Evidence:
    """Before any machine: a sentence's margin is the sum of the log odds of its parts."""

    bias = 0.0

    def __init__(self, odds: dict[str, float]):
        self.odds = odds

    def margins(self, words: list[str]) -> np.ndarray:
        return np.array([sum([self.odds.get(p, 0.0) for p in parts_of(w)]) for w in words])


class Scorer:
    """Texts' margins. What recent words add is remembered in two generations; those new in a group of texts are computed
    together, words with the same letters and digits once."""

    def __init__(self, model: Model | Evidence):
        self.model = model
        self.known: dict[str, float] = {}
        self.older: dict[str, float] = {}

    def all(self, texts: Iterable[str]) -> Iterator[tuple[float, list[str]]]:
        """For each text the margin of its worst sentence, and that sentence's words; without words one below the
        bias, and none."""
        for group in grouped(texts):
            cut = read(group)
            for margin, at in zip(*self.worst_of(cut)):
                yield margin, [] if at < 0 else cut.sentence(at)

    def worst_of(self, cut: Read) -> tuple[list[float], list[int]]:
        """For each text the margin of its worst sentence and which it is, or -1."""
        begin, end = cut.texts[:-1], cut.texts[1:]
        margin, at = np.full(len(begin), self.model.bias - 1.0), np.full(len(begin), -1)
        some = np.flatnonzero(begin < end)
        if len(some):
            sums = np.add.reduceat(self._added(cut.words)[cut.codes], cut.bounds[:-1]) + self.model.bias
            margin[some] = np.maximum.reduceat(sums, begin[some])
            most = np.flatnonzero(sums == np.repeat(margin, end - begin))
            at[some] = most[np.searchsorted(most, begin[some])]
        return [round(m, 9) for m in margin.tolist()], at.tolist()

    def _added(self, words: list[str]) -> np.ndarray:
        """What each of the distinct words adds to a sentence's margin: it depends on letters and digits alone, so these
        are what is remembered."""
        if len(self.known) >= CACHE:
            self.older, self.known = self.known, {}
        words = [w if w.isalnum() else plain(w) for w in words]
        out = list(map(self.known.get, words))
        new: dict[str, int] = {}
        missing, which = [], []
        for i in [i for i, value in enumerate(out) if value is None]:
            w = words[i]
            if (value := self.older.get(w)) is None:
                missing.append(i)
                which.append(new.setdefault(w, len(new)))
                continue
            out[i] = value
            if len(w) <= CACHE_CHARS:
                self.known[w] = value
        out = np.array(out, float)
        if new:
            values = self.model.margins(list(new))
            out[missing] = values[which]
            self.known.update({w: value for w, value in zip(new, values.tolist()) if len(w) <= CACHE_CHARS})
        return out

    def worst(self, text: str) -> tuple[float, list[str]]:
        return next(self.all([text]))


_ready: list[tuple[int, Scorer]] = []


def _scorer(stamp: int, model: Model) -> Scorer:
    if not _ready or _ready[0][0] != stamp:
        _ready[:] = [(stamp, Scorer(model))]
    return _ready[0][1]


def margins(rows: DataFrame, model: Model) -> DataFrame:
    """(key, margin) of rows (key long, text)."""
    shared, stamp = rows.sparkSession.sparkContext.broadcast(model), hash((model.bias, *model.weights.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(stamp, shared.value)
        for batch in batches:
            out = [m for group in grouped(x.as_py() for x in batch.column(1)) for m in scorer.worst_of(read(group))[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["key", "margin"])

    return rows.select("key", no_null("text").alias("text")).mapInArrow(run, "key long, margin double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(sign, toxic, text) of at most MAX_LABELLED different texts of labelled documents outside the held-out fold."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = MAX_LABELLED / max(1, marked.count())
    if share < 1:  # by hash first: a limit alone would bring so many rows of every partition together
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    marked = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))
    sign = let(F.split(F.lower(no_null("text")), r"\s+"), lambda words: F.array_min(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))))
    rows = docs.join(marked, "doc_id").select("toxic", no_null("text").alias("text")).withColumn("sign", sign)
    one = rows.groupBy("sign").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    one = written(one, "labelled")
    chosen = one.select("sign").orderBy("sign").limit(MAX_LABELLED)
    return one.join(F.broadcast(chosen), "sign")


def _counts(rows: DataFrame) -> DataFrame:
    """(part, bad, n): in how many toxic texts, and in how many at all, each part is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = iter(batch.column(0).to_pylist())
            for group in grouped(x.as_py() for x in batch.column(1)):
                cut = read(group)
                own, places = [parts_of(w) for w in cut.words], cut.bounds[cut.texts].tolist()
                parts, toxic = [], []
                for a, b, mark in zip(places, places[1:], marked):
                    parts += {p for c in set(cut.codes[a:b].tolist()) for p in own[c]}
                    toxic += [mark] * (len(parts) - len(toxic))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(toxic, pa.int32())], names=["part", "toxic"])

    return rows.select("toxic", "text").mapInArrow(run, "part string, toxic int").groupBy("part").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))


def _examples(rows: DataFrame, landmarks: Landmarks, model: Model | Evidence) -> tuple[np.ndarray, ...]:
    """(toxic, margin, worst, other): for each text its worst sentence's kernel row, and that of one by hash."""
    shared = rows.sparkSession.sparkContext.broadcast((landmarks.marks, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, score = Landmarks(shared.value[0]), Scorer(shared.value[1])
        for batch in batches:
            rest = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for group in grouped(x.as_py() for x in batch.column(2)):
                cut = read(group)
                pairs, toxic = [], []
                margin, worst = score.worst_of(cut)
                for first, end, at, (sign, mark) in zip(cut.texts.tolist(), cut.texts[1:].tolist(), worst, rest):
                    pairs += [cut.sentence(at) if at >= 0 else [], [] if mark or first == end else cut.sentence(first + sign % (end - first))]
                    toxic.append(mark)
                for i in range(0, len(toxic), AT_ONCE):
                    z = [x.tobytes() for x in marks.sentences(pairs[2 * i : 2 * (i + AT_ONCE)]).astype("<f4")]
                    yield pa.RecordBatch.from_arrays([pa.array(toxic[i : i + AT_ONCE], pa.int32()), pa.array(margin[i : i + AT_ONCE], pa.float64()), pa.array(z[::2], pa.binary()), pa.array(z[1::2], pa.binary())], names=["toxic", "margin", "worst", "other"])

    seen = rows.select("sign", "toxic", "text").mapInArrow(run, "toxic int, margin double, worst binary, other binary").collect()  # at most MAX_LABELLED
    z = [np.array([np.frombuffer(r[c], "<f4") for r in seen], float).reshape(len(seen), -1) for c in ("worst", "other")]
    return np.array([r["toxic"] for r in seen]), np.array([r["margin"] for r in seen]), *z


def spread(parts: list[str], weight: np.ndarray, most: int) -> list[str]:
    """At most ``most`` of the parts, by pivoted Cholesky: next comes the one whose kernel those before explain least,
    times its weight."""
    if not parts:
        return []
    kernel = Landmarks(parts).kernel(parts)
    left, rows, chosen = kernel.diagonal().copy(), [], []
    while len(chosen) < min(most, len(parts)):
        at = int(np.argmax(left * weight))
        if left[at] < 1e-3:
            break
        row = (kernel[at] - sum([r[at] * r for r in rows], np.zeros(len(parts)))) / math.sqrt(left[at])
        rows.append(row)
        left = left - row**2
        left[at] = 0
        chosen.append(at)
    return [parts[i] for i in chosen]


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The fitted model, or None if no part tells toxic texts apart."""
    rows = training_rows(docs, labels)
    size = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count("*").alias("n")).first()
    bad, n = size["bad"], size["n"]
    if not 0 < bad < n:
        return None
    counts = written(_counts(rows), "part-counts")
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n - bad + 1))
    # the likelihood ratio of a part's own share of toxic texts against that of all texts
    ratio = F.col("bad") * F.log(F.col("bad") * n / (F.col("n") * bad)) + F.when(F.col("n") > F.col("bad"), (F.col("n") - F.col("bad")) * F.log((F.col("n") - F.col("bad")) * n / (F.col("n") * (n - bad)))).otherwise(0.0)
    telling = counts.where("bad >= 2 and length(part) > 2").select("part", odds.alias("odds"), ratio.alias("ratio")).where("odds > 0 and ratio > 4")
    toxic = telling.orderBy(F.desc("ratio"), "part").limit(CANDIDATES).collect()
    clean = counts.where("bad = 0 and length(part) > 2").orderBy(F.desc("n"), "part").limit(CANDIDATES).collect()
    if not toxic:
        return None
    marks = spread([r["part"] for r in toxic], np.sqrt([r["ratio"] for r in toxic]), LANDMARKS[0])
    marked = len(marks)
    marks += spread([r["part"] for r in clean], np.ones(len(clean)), LANDMARKS[1])
    landmarks, model, least, others = Landmarks(marks), Evidence({r["part"]: r["odds"] for r in toxic}), 0.0, []
    for turn in range(ROUNDS):
        y, margin, worst, other = _examples(rows, landmarks, model)
        # later on, sentences beyond the margin would not move the machine
        others += [worst[(y == 0) & (margin > -1)]] if turn else [worst[y == 0], other[y == 0]]
        found = worst[(y == 1) & (margin > least)]  # a text whose worst sentence is plainly clean teaches nothing
        if not len(found):
            break
        model, least = Model.solved(landmarks, marked, found, np.vstack(others)), -0.8
    if isinstance(model, Evidence):
        return None
    seen = margins(rows.withColumn("key", F.col("toxic").cast("long")), model).collect()  # at most MAX_LABELLED
    model.calibrate(np.array([r["margin"] for r in seen]), np.array([r["key"] for r in seen]))
    return model


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of (doc_id, text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("key"), "text")
    if model is None:
        out = keyed.select("key", F.lit(0.1).alias("score"))
    else:
        z = F.lit(model.slope) * (F.col("margin") - F.lit(model.cut))
        out = margins(keyed, model).select("key", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))
    return out.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model of the labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return scored(docs, train(docs, table(spark, sf_dir, "labels", ["doc_id", "toxic"])))
