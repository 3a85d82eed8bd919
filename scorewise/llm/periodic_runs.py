"""Periodic run detection by online dyadic square catching.

Words are appended to a stream.  For every level k, each completed block of
``b = 2**k`` words at a multiple of ``b`` is a catcher for the periods
``2b-1 .. 4b-2``: the first period of any square of such a period holds one
aligned block whole, and the block comes again one period later.  An appended
word completes one window per level and is compared with the two catchers that
are alive at that distance; a match is extended to both sides by comparisons of
power-of-two windows.  A stretch that still reaches the end of the stream stays
open and every later word advances it.  Stretches of two periods or more are
squares; squares of one extent merge into one run under their smallest period.

Windows are compared by 64-bit names and every reported run is checked word by
word; a false match makes the catcher replay its words under other names, so
the result is exact.  A stream of n words costs O(n log n), whatever repeats.

Documents of a batch share one stream, parted by codes that occur once.  The
work of a document never leaves its task and nothing is shuffled.

Defined results: null text has no words (n_runs 0, four nulls, both digests of
the empty string); a null doc_id is no decimal number, its words stay as they
are; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from binascii import crc32
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.llm.common import text_of

#: Fewest words of a run.
LEAST = 12
#: Words that one stream of documents gathers before it is searched (one longer document is a stream alone).
STREAM_WORDS = 200_000
_U = np.uint64


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9 + 2 * seed)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB + 4 * seed)
    return x ^ (x >> _U(31))


class _Growing:
    """A numpy array that rows are appended to."""

    def __init__(self, kind):
        self.held, self.n = np.empty(1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            more = np.empty(max(2 * len(self.held), self.n + len(x)), self.held.dtype)
            more[:self.n] = self.held[:self.n]
            self.held = more
        self.held[self.n:self.n + len(x)] = x
        self.n += len(x)

    @property
    def v(self) -> np.ndarray:
        return self.held[:self.n]


class SquareCatcher:
    """Runs of a stream of integer codes, fed in pieces of any length.

    ``longest`` bounds the length of a run (the longest document of the
    stream), so that no catchers for longer periods are kept; None: no bound.
    """

    def __init__(self, least: int = LEAST, longest: int | None = None, seed: int = 0):
        self.least, self.longest, self.seed = least, longest, seed
        self.codes = _Growing(np.int64)
        self.names: list[_Growing] = [_Growing(np.uint64)]
        self.open = np.empty((0, 2), np.int64)              # start, period of stretches that reach the end
        self.closed: list[np.ndarray] = []                  # start, end, period

    def append(self, codes) -> None:
        codes = np.asarray(codes, np.int64)
        if not len(codes):
            return
        old = self.codes.n
        self.codes.add(codes)
        n = self.codes.n
        self.names[0].add(_mixed(codes.view(np.uint64), self.seed))
        while 3 * (b := len_of(len(self.names))) - 1 <= n and (self.longest is None or 2 * b - 1 <= self.longest // 2):
            self.names.append(_Growing(np.uint64))          # the first window of this level can be caught
        for k in range(1, len(self.names)):                 # names of the windows completed by these words
            lower, half, mine = self.names[k - 1].v, len_of(k - 1), self.names[k]
            upto = n - 2 * half + 1
            if upto > mine.n:
                a, b = lower[mine.n:upto], lower[mine.n + half:upto + half]
                mine.add(_mixed(a * _U(0x9E3779B97F4A7C15) + b, self.seed))
        if len(self.open):                                  # open stretches advance
            start, p = self.open.T
            self.open = self.open[:0]
            self._settle(start, old + self._right(np.full(len(p), old) - p, p), p)
        for k in range(len(self.names)):
            self._catch(k, old, n)

    def _catch(self, k: int, old: int, n: int) -> None:
        b, names = len_of(k), self.names[k].v
        lo, hi = max(2 * b - 1, old - b + 1), len(names)    # second windows that these words complete
        if lo >= hi:
            return
        first = (lo - 2 * b + 1) // b                       # block that is nearest to window lo
        last = (hi - 2 * b) // b
        near = np.repeat(names[first * b:last * b + 1:b], b)[(lo - 2 * b + 1) - first * b:][:hi - lo]
        at1 = np.flatnonzero(names[lo:hi] == near) + lo
        a1 = (at1 - (2 * b - 1)) // b * b
        low2 = max(lo, 3 * b - 1)                           # the block before that one
        if low2 < hi:
            before = (low2 - 2 * b + 1) // b - 1
            far = np.repeat(names[before * b:(last - 1) * b + 1:b], b)[(low2 - 3 * b + 1) - before * b:][:hi - low2]
            at2 = np.flatnonzero(names[low2:hi] == far) + low2
            a2 = (at2 - (2 * b - 1)) // b * b - b
            at1, a1 = np.concatenate([at1, at2]), np.concatenate([a1, a2])
        if not len(at1):
            return
        p = at1 - a1
        ok = np.full(len(p), True) if self.longest is None else 2 * p <= self.longest
        order = np.lexsort((a1[ok], p[ok]))
        a1, p = a1[ok][order], p[ok][order]
        fresh = np.ones(len(p), bool)                       # neighbouring blocks caught at one period are one stretch
        fresh[1:] = (p[1:] != p[:-1]) | (a1[1:] != a1[:-1] + b)
        if len(self.open):                                  # caught before and still open
            known = self.open[np.argsort(self.open[:, 1])]
            j = np.searchsorted(known[:, 1], p).clip(max=len(known) - 1)
            fresh &= ~((known[j, 1] == p) & (known[j, 0] <= a1))
        a1, p = a1[fresh], p[fresh]
        if len(p):
            self._settle(a1 - self._left(a1, p), a1 + p + self._right(a1, p), p)

    def _settle(self, start, end, p) -> None:
        live = end == self.codes.n
        self.open = np.unique(np.concatenate([self.open, np.stack([start, p], 1)[live]]), axis=0)
        done = ~live & (end - start >= np.maximum(self.least, 2 * p))
        if done.any():
            self.closed.append(np.stack([start, end, p], 1)[done])

    def _right(self, a, p) -> np.ndarray:
        """Words from ``a`` on that are alike at distance ``p``."""
        r = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            b, names = len_of(k), self.names[k].v
            go = np.arange(len(a))
            while len(go):
                x = a[go] + r[go]
                go = go[x + p[go] + b <= self.codes.n]
                x = a[go] + r[go]
                go = go[names[x] == names[x + p[go]]]
                r[go] += b
                if k < len(self.names) - 1:
                    break
        return r

    def _left(self, a, p) -> np.ndarray:
        """Words before ``a`` that are alike at distance ``p``."""
        r = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            b, names = len_of(k), self.names[k].v
            go = np.arange(len(a))
            while len(go):
                x = a[go] - r[go] - b
                go = go[x >= 0]
                x = a[go] - r[go] - b
                go = go[names[x] == names[x + p[go]]]
                r[go] += b
                if k < len(self.names) - 1:
                    break
        return r

    def runs(self) -> np.ndarray:
        """Rows ``start, end, period`` by start, then period, of all words appended so far."""
        start, p = self.open.T
        whole = np.concatenate([*self.closed, np.stack([start, np.full(len(p), self.codes.n), p], 1)])
        whole = whole[whole[:, 1] - whole[:, 0] >= np.maximum(self.least, 2 * whole[:, 2])]
        whole = whole[np.lexsort((whole[:, 2], whole[:, 1], whole[:, 0]))]
        best = np.ones(len(whole), bool)                    # one extent: its smallest period
        best[1:] = (whole[1:, :2] != whole[:-1, :2]).any(axis=1)
        whole = whole[best]
        if not all(self._holds(*map(int, row)) for row in whole):
            again = SquareCatcher(self.least, self.longest, self.seed + 1)
            again.append(self.codes.v)
            return again.runs()
        return whole[np.lexsort((whole[:, 2], whole[:, 0]))]

    def _holds(self, start: int, end: int, p: int) -> bool:
        s = self.codes.v
        return bool((s[start:end - p] == s[start + p:end]).all()) and (start == 0 or s[start - 1] != s[start + p - 1]) and (
            end == len(s) or s[end] != s[end - p])


def len_of(level: int) -> int:
    return 1 << level


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words that the contract searches: of every tenth document (by crc32 of its id) the tail is made periodic."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    reps = -(-(n - a) // p)
    return words[:a] + (words[a:a + p] * reps)[:n - a]


def document_runs(texts: list[list[bytes]], least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each list of words its runs (rows ``start, end, period``) and a mask of the words that stay."""
    code: dict = defaultdict(count().__next__)
    parts, starts, at = [], [], 0
    for i, words in enumerate(texts):
        parts.append(np.fromiter(map(code.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([-1 - i]))
        starts.append(at)
        at += len(words) + 1
    catcher = SquareCatcher(least, max(map(len, texts), default=0))
    catcher.append(np.concatenate(parts) if parts else np.empty(0, np.int64))
    found = catcher.runs()
    level = np.zeros(at + 1, np.int64)
    np.add.at(level, found[:, 0] + found[:, 2], 1)
    np.add.at(level, found[:, 1], -1)
    stays = np.cumsum(level) == 0
    of = np.searchsorted(starts, found[:, 0], "right") - 1
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    return [(found[cut[i]:cut[i + 1]] - np.array([s, s, 0]), stays[s:s + len(texts[i])]) for i, s in enumerate(starts)]


_FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
           ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def _row(words: list[bytes], runs: np.ndarray, stays: np.ndarray) -> tuple:
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs.tolist())
    text = b" ".join(words) if stays.all() else b" ".join(compress(words, stays.tolist()))
    best = (None,) * 4
    if len(runs):
        s, e, p = runs[np.lexsort((runs[:, 2], runs[:, 0], runs[:, 0] - runs[:, 1]))[0]].tolist()
        best = (s, e - s, p, 1000 * (e - s) // p)
    return (len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  change=planted, stream_words: int = STREAM_WORDS) -> DataFrame:
    """One row per document: its number of runs, the longest one, and digests of
    all runs and of the text without the repeated words.  ``change`` (words, id)
    gives the words to search (None: the words as they are)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n, first = [], 0, 0
            for i, x in enumerate(batch.column("text")):
                words = x.as_py().split()
                held.append(change(words, batch.column("doc_id")[i].as_py()) if change else words)
                n += len(words)
                if n >= stream_words or i + 1 == batch.num_rows:
                    out = [_row(w, *r) for w, r in zip(held, document_runs(held, least), strict=True)]
                    cols = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(first, len(held)), *[pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)]],
                        ["doc_id", *[f for f, _ in _FIELDS]])
                    held, n, first = [], 0, i + 1

    types = ", ".join(f"{f} {'string' if t == pa.string() else 'long'}" for f, t in _FIELDS)
    return rows.mapInArrow(run, f"doc_id {kind}, {types}")
