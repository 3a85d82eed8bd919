"""Byte-pair encoding and decoding as bounded-lookahead streaming transducers.

**Lookahead.**  Merge a string and the same string with another continuation
side by side, rank by rank.  Left of a front both are cut alike; the front
moves left only when a merge ``(u, v)`` reaches across it, by the length of
``u``, and each such merge has a higher rank than the one before.  The next
one, ``(u', v')``, must find ``v'`` at the new front, where one string still has
``u`` and the other a token that begins with ``u``: so ``u`` is on the left spine
of ``v'`` (``v'``, its left part, the left part of that, ...).  The longest chain
of merges of rising rank under that rule bounds how far any continuation can
reach back; ``lookahead`` computes it in one pass over the merge list.  Tokens
that end that far before the end of the known text are stable.

**Encoder.**  Text comes in pieces of any length.  It is parted at the special
tokens, then into pretokens (a piece that later text could still change waits),
and every pretoken is merged.  A pretoken longer than ``LONG_PRETOKEN``
characters is streamed: stable tokens leave, the lookahead stays.  Memory is
bounded by the piece, the lookahead, and a cache of short pretokens of fixed
size.  **Decoder.**  Token bytes go through an incremental UTF-8 state machine
that keeps the bytes of an unfinished character (three at most).

Defined results: null text is the empty text (no tokens; digests of nothing);
repeated rows give repeated results; other columns are ignored.  Tokenizer files
with normalizers, prefix spaces, dropout, unknown tokens or matching flags are
refused, as their semantics are not built.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.llm.common import text_of

#: Fixed value: the pattern by which this kind of tokenizer parts text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A match that ends this many characters before the end of the known text is final.
SETTLED = 4
#: Characters of text handed to the encoder at a time.
PIECE = 1 << 16
#: Characters from which an unfinished pretoken is streamed.
LONG_PRETOKEN = 1 << 12
#: Longest pretoken (characters) and number of pretokens that the cache keeps.
CACHED_CHARS, CACHED = 48, 1 << 19
#: Characters of text whose pretokens are merged side by side.
GROUP = 1 << 18
NO_MERGE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such a vocabulary: printable Latin-1
    bytes stand for themselves, the others follow from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def left_spine(token: int, left: dict[int, int]) -> Iterator[int]:
    while token is not None:
        yield token
        token = left.get(token)


def lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Bytes that a continuation can reach back, for merges ``(u, v, uv)`` in order of rank."""
    left = {uv: u for u, _, uv in reversed(merges)}
    reach: dict[int, int] = {}                             # token u -> longest chain whose last merge has u at its left
    for u, v, _ in merges:
        far = max(reach.get(t, 0) for t in left_spine(v, left)) + length[u]
        reach[u] = max(reach.get(u, 0), far)
    return max(reach.values(), default=0)


class Vocabulary:
    """Merges, token bytes and special tokens of a byte-level tokenizer file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                 and not spec.get("normalizer") and (spec.get("decoder") or {}).get("type") == "ByteLevel"
                 and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
        if not plain or any(t[x] for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only plain byte-level BPE files are supported")
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.byte_ids = [vocab[c] for c in letters]
        self.merges = []
        for m in model["merges"]:
            u, v = m.split(" ") if isinstance(m, str) else m
            self.merges.append((vocab[u], vocab[v], vocab[u + v]))
        self.rank = {(u, v): (r, uv) for r, (u, v, uv) in reversed(list(enumerate(self.merges)))}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        texts = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.bytes = {i: bytes(map(back.__getitem__, t)) if all(c in back for c in t) else t.encode() for i, t in texts.items()}
        self.length = {i: len(b) for i, b in self.bytes.items()}
        self.lookahead = lookahead(self.merges, self.length)
        keys = {u << 32 | v: r for r, (u, v, _) in reversed(list(enumerate(self.merges)))}
        self.pair_keys = np.array(sorted(keys), np.int64)
        self.pair_ranks = np.array([keys[k] for k in self.pair_keys.tolist()], np.int64)
        self.made = np.array([uv for _, _, uv in self.merges], np.int64)
        table = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.all_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.array([len(t) for t in table])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=lambda t: (-len(t), t))))) if self.specials else None

    def ranks(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Rank of every pair; NO_MERGE where the list has none."""
        if not len(self.pair_keys):
            return np.full(len(u), NO_MERGE)
        key = u << 32 | v
        at = np.searchsorted(self.pair_keys, key).clip(max=len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_MERGE)

    def merged_many(self, pretokens: list[bytes]) -> list[bytes]:
        """Packed ids of many short pretokens (none empty), merged side by side: each
        round merges in every pretoken all places of its lowest rank, from the left."""
        ids = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(pretokens), np.uint8)]
        owner = np.repeat(np.arange(len(pretokens)), [len(p) for p in pretokens])
        rank = np.full(len(ids), NO_MERGE)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self.ranks(ids[inside], ids[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(ids)))
            going = low < NO_MERGE
            if not going.all():
                done.append((ids[~going], owner[~going]))
                ids, owner, rank, low = ids[going], owner[going], rank[going], low[going]
            at = np.flatnonzero(rank == low)
            if not len(at):
                break
            begins = np.append(True, at[1:] != at[:-1] + 1)           # places in a row are u u u: every second one
            offset = at - np.repeat(at[begins], np.diff(np.flatnonzero(begins), append=len(at)))
            at = at[offset % 2 == 0]
            ids[at] = self.made[rank[at]]
            stays = np.full(len(ids), True)
            stays[at + 1] = False
            new = (np.cumsum(stays) - 1)[at]
            ids, owner, rank = ids[stays], owner[stays], rank[stays]
            for touched in (new, new[new > 0] - 1):                   # the pairs of a new token with its neighbours
                rank[touched] = NO_MERGE
                touched = touched[touched + 1 < len(ids)]
                touched = touched[owner[touched] == owner[touched + 1]]
                rank[touched] = self.ranks(ids[touched], ids[touched + 1])
        ids, owner = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(owner, kind="stable")
        flat, ends = packed(ids[order]), 4 * np.cumsum(np.bincount(owner, minlength=len(pretokens)))
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]  # noqa: B905

    def merged(self, data: bytes) -> list[int]:
        """Token ids of the bytes of one pretoken: lowest rank first, leftmost first."""
        ids = [self.byte_ids[b] for b in data]
        rank = self.rank
        if len(ids) > 32:
            return self._merged_long(ids)
        while len(ids) > 1:
            best = min((rank[p] for p in zip(ids, ids[1:]) if p in rank), default=None)  # noqa: B905
            if best is None:
                break
            u, v, new = self.merges[best[0]]
            out, i, last = [], 0, len(ids) - 1
            while i <= last:
                if i < last and ids[i] == u and ids[i + 1] == v:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            r, new, i = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or rank.get((ids[i], ids[j])) != (r, new):
                continue                                   # one of the two was merged meanwhile
            ids[i], ids[j] = new, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (new, ids[after[i]])) in rank:
                    heapq.heappush(heap, (*rank[p], i))
            if before[i] >= 0 and (p := (ids[before[i]], new)) in rank:
                heapq.heappush(heap, (*rank[p], before[i]))
        return [t for t in ids if t is not None]


def packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class Cache(dict):
    """Pretoken -> packed ids; emptied when full, long pretokens are not kept.
    Packed ids stand for themselves."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, pretoken: str | bytes) -> bytes:
        return pretoken if isinstance(pretoken, bytes) else packed(self.vocabulary.merged(pretoken.encode()))

    def learn(self, pretokens: set) -> None:
        new = [p for p in pretokens if p not in self and type(p) is str and len(p) <= CACHED_CHARS]
        if len(self) + len(new) > CACHED:
            self.clear()
            new = [p for p in pretokens if type(p) is str and len(p) <= CACHED_CHARS]
        if new:
            self.update(zip(new, self.vocabulary.merged_many([p.encode() for p in new]), strict=True))

    def some(self, pretokens: set) -> dict:
        """Packed ids of these pretokens, merged side by side where they are new."""
        self.learn(pretokens)
        return dict(zip(pretokens, map(self.__getitem__, pretokens), strict=True))


class MergeStream:
    """Merges of one pretoken that comes in pieces: tokens leave once no continuation can change them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held, self.block = vocabulary, b"", max(1 << 12, vocabulary.lookahead)

    def feed(self, data: bytes, last: bool = False) -> list[int]:
        self.held += data
        out: list[int] = []
        while not last and len(self.held) >= self.v.lookahead + 2 * self.block:
            known = self.held[:self.v.lookahead + self.block]
            out += self._stable(known)
        if last:
            out += self.v.merged(self.held)
            self.held = b""
        elif len(self.held) >= self.v.lookahead + self.block:
            out += self._stable(self.held)
        return out

    def _stable(self, known: bytes) -> list[int]:
        out, end = [], 0
        for t in self.v.merged(known):
            if end + self.v.length[t] > len(known) - self.v.lookahead:
                break
            end += self.v.length[t]
            out.append(t)
        self.held = self.held[end:]
        return out


_SPLIT = regex.compile(PATTERN)


def _ranges(kind: str, upto: int) -> str:
    """The characters of a class below a code point, as ranges for the plain ``re``."""
    return "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in regex.finditer(kind + "+", "".join(map(chr, range(upto)))))


def _narrow_split(upto: int) -> tuple[re.Pattern, re.Pattern]:
    """The same pattern for text below a code point, with its classes spelt out
    (``re`` is twice as fast on them), and a test whether a text is such."""
    letter, number, space = (_ranges(kind, upto) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    words = rf"'s|'t|'re|'ve|'m|'ll|'d| ?(?:[{letter}]+|[{number}]+|[^{space}{letter}{number}]+)"
    return re.compile(rf"{words}|[{space}]+(?![^{space}])|[{space}]+"), re.compile(f"[\\x00-\\U{upto - 1:08x}]*")


_NARROW, _IS_NARROW = _narrow_split(0x250)


def pretokens_of(text: str) -> list[str]:
    return _NARROW.findall(text) if _IS_NARROW.fullmatch(text) else _SPLIT.findall(text)


_RUNS = {c: regex.compile(p) for c, p in (("letter", r"\p{L}+"), ("number", r"\p{N}+"), ("space", r"\s+"), ("other", r"[^\s\p{L}\p{N}]+"))}


class Splitter:
    """Text in pieces -> settled pretokens (str) and, for special tokens and the
    stable part of long pretokens, packed ids (bytes)."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.raw = ""                                      # may begin a special token
        self.text = ""                                     # pretokens that later text may change
        self.run: tuple[str, MergeStream] | None = None    # kind of the long pretoken being streamed

    def feed(self, piece: str, last: bool = False) -> list:
        out: list = []
        self.raw += piece
        if self.v.special_pattern is not None:
            while m := self._special(last):
                out += self._plain(self.raw[:m.start()], True)
                out.append(packed([self.v.specials[m[0]]]))
                self.raw = self.raw[m.end():]
        keep = 0 if last else self._may_begin_special()
        body, self.raw = self.raw[:len(self.raw) - keep], self.raw[len(self.raw) - keep:]
        return out + self._plain(body, last)

    def _special(self, last: bool):
        """The first special token, once no longer one can stand in its place."""
        m = self.v.special_pattern.search(self.raw)
        if m and not last and any(len(t) > len(self.raw) - m.start() and t.startswith(self.raw[m.start():]) for t in self.v.specials):
            return None
        return m

    def _may_begin_special(self) -> int:
        longest = max(map(len, self.v.specials), default=0)
        return next((k for k in range(min(len(self.raw), longest), 0, -1) if any(t.startswith(self.raw[-k:]) for t in self.v.specials)), 0)

    def _plain(self, text: str, last: bool) -> list:
        """``last``: a special token or the end of the text follows."""
        self.text += text
        out: list = []
        if self.run:
            out += self._go_on(last)
            if self.run:
                return out
        pieces = pretokens_of(self.text)
        if last:
            self.text = ""
            return out + pieces
        end, upto, long = len(self.text), len(self.text) - SETTLED, ""
        while pieces and end > upto:
            long = pieces.pop()
            end -= len(long)
        out += pieces
        self.text = self.text[end:]
        if len(long) > LONG_PRETOKEN:
            kind = next(k for k, p in _RUNS.items() if p.fullmatch(long[-1]))
            self.run = kind, MergeStream(self.v)
            lead = long[:1] if kind != "space" and long[0] == " " else ""
            self.text = self.text[len(lead):]
            out.append(packed(self.run[1].feed(lead.encode())))
            out += self._go_on(False)
        return out

    def _go_on(self, last: bool) -> list:
        """Feeds the long pretoken what belongs to it; ends it where another kind of character follows."""
        kind, stream = self.run
        m = _RUNS[kind].match(self.text)
        n = m.end() if m else 0
        over = last or n < len(self.text)
        if kind == "space" and not (last and n == len(self.text)):
            n = max(n - 1, 0)                              # the last space goes to what follows it
        out = packed(stream.feed(self.text[:n].encode(), over))
        self.text = self.text[n:]
        if over:
            self.run = None
        return [out]


class Encoder:
    """Text in pieces -> packed token ids (little-endian unsigned 32-bit), in constant memory."""

    def __init__(self, vocabulary: Vocabulary, cache: Cache | None = None):
        self.cache, self.splitter = Cache(vocabulary) if cache is None else cache, Splitter(vocabulary)

    def feed(self, piece: str, last: bool = False) -> bytes:
        pretokens = self.splitter.feed(piece, last)
        return b"".join(map(self.cache.some(set(pretokens)).__getitem__, pretokens))

    def finish(self) -> bytes:
        return self.feed("", True)


class Decoder:
    """Token ids in pieces -> text; ids outside the vocabulary have no bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.sizes, self.starts, self.all_bytes = vocabulary.sizes, vocabulary.starts, vocabulary.all_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, last: bool = False) -> str:
        ids = np.asarray(ids, np.int64)
        if len(ids) and ids.max() >= len(self.sizes):
            ids = ids[ids < len(self.sizes)]
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[ids] - before, sizes) + np.arange(sizes.sum())
        return self.state.decode(self.all_bytes[at].tobytes(), last)

    def finish(self) -> str:
        return self.state.decode(b"", True)


_READY: dict[str, tuple[Vocabulary, Cache]] = {}


def ready(source: str) -> tuple[Vocabulary, Cache]:
    """Vocabulary and cache of this Python worker."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _READY:
        _READY.clear()
        v = Vocabulary(source)
        _READY[key] = v, Cache(v)
    return _READY[key]


class _Digest:
    """Streamed round trip of one text: tokens counted, ids and decoded text hashed as they leave."""

    def __init__(self, v: Vocabulary):
        self.splitter, self.decoder = Splitter(v), Decoder(v)
        self.n, self.ids, self.decoded = 0, hashlib.sha256(), hashlib.sha256()

    def take(self, got: bytes, last: bool) -> None:
        self.n += len(got) // 4
        self.ids.update(got)
        self.decoded.update(self.decoder.feed(np.frombuffer(got, "<u4"), last).encode())


def digests(v: Vocabulary, cache: Cache, texts: Iterator[str]) -> list[tuple[int, str, str]]:
    """(number of tokens, digest of the ids, digest of the decoded text) of each text."""
    out: list[_Digest] = []
    waiting: list[tuple[_Digest, list, bool]] = []
    size = 0

    def flush():
        known = cache.some(set().union(*[pretokens for _, pretokens, _ in waiting]))
        for to, pretokens, last in waiting:
            to.take(b"".join(map(known.__getitem__, pretokens)), last)
        waiting.clear()

    for text in texts:
        out.append(_Digest(v))
        for at in range(0, max(len(text), 1), PIECE):
            last = at + PIECE >= len(text)
            waiting.append((out[-1], out[-1].splitter.feed(text[at:at + PIECE], last), last))
            size += min(len(text) - at, PIECE)
            if size >= GROUP:
                flush()
                size = 0
    flush()
    return [(d.n, d.ids.hexdigest(), d.decoded.hexdigest()) for d in out]


def round_trip(docs: DataFrame, source: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of tokens, digest of the ids (little-endian
    unsigned 32-bit) and of the text decoded from them.  ``source`` is the JSON
    text of the tokenizer file (bounded by its vocabulary; sent once per executor)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cache = ready(sent.value)
        for b in batches:
            out = digests(v, cache, (x.as_py() for x in b.column("text")))
            cols = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)]],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, source: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids`` (the token ids of the whole text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cache = ready(sent.value)
        for b in batches:
            ids = []
            for x in b.column("text"):
                text, encoder = x.as_py(), Encoder(v, cache)
                ids.append(np.frombuffer(b"".join(encoder.feed(text[at:at + PIECE], at + PIECE >= len(text))
                                                  for at in range(0, max(len(text), 1), PIECE)), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(tokens: DataFrame, source: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per list of ids: ``doc_id, text``; null ids are no text (empty)."""
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    kind = dict(rows.dtypes)["doc_id"]
    sent = tokens.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = ready(sent.value)
        for b in batches:
            texts = [Decoder(v).feed([i for i in x.as_py() if i is not None and i >= 0], True) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")
