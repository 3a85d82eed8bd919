"""Operator 7, personal data by a linear-chain conditional random field.

The field labels white-space words O, email, ip, card or phone from features of
the word's shape and of its neighbours.  It is trained in numpy on a small
labelled table (``labelled_table``: sentence patterns filled by a seeded
generator, with many look-alikes labelled O) by gradient ascent on the exact
log-likelihood (forward-backward), and decoded by Viterbi in numpy batches.

Most words of a text have no digit and no @ ("plain").  Training ends with a
check of the weights: if O beats every other label for a plain word between
plain words whatever the labels beside it, the best path goes through O there
and the sequence is decoded in independent stretches around the other words,
with the same result as over the whole text.  If the check fails, whole
sequences are decoded.

Base spans come from fixed patterns and always stay.  Neighbouring words of one
label are one item until one of them is an item by itself or a phone number ends
or begins (``begins``); the field adds its items, less words that overlap a base
span.  Whole texts are read; spans are code points, end
exclusive.  A null text counts as empty.  Rows that repeat a doc_id are
searched each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"

# ---------------------------------------------------------------------------
# base patterns (fixed values of the method)
# ---------------------------------------------------------------------------
_LOCAL = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(48, 58)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the local part before it and a domain after it; the same
    spans as the whole pattern gives, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    d = np.frombuffer(digits.encode(), np.uint8)[::-1] - 48
    odd = d[1::2] * 2
    return (int(d[::2].sum()) + int((odd - 9 * (odd > 9)).sum())) % 10 == 0


def octets(address: str) -> bool:
    parts = [p.lstrip("0") for p in address.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)``, sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _IP.finditer(text):
        if octets(m[0]):
            out.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------------------
# features
# ---------------------------------------------------------------------------
CUES = {"email": 0, "mail": 0, "e-mail": 0, "contact": 0, "ip": 1, "address": 1, "host": 1, "server": 1, "card": 2, "visa": 2, "mastercard": 2,
        "credit": 2, "phone": 3, "tel": 3, "telephone": 3, "call": 3, "mobile": 3, "fax": 3, "cell": 3, "version": 4, "order": 4, "isbn": 4, "id": 4,
        "token": 4, "key": 4, "license": 4, "invoice": 4, "page": 4, "price": 4, "part": 4, "serial": 4, "total": 4, "amount": 4, "item": 4, "model": 4,
        "ticket": 4, "tracking": 4}
_TESTS = [re.compile(p) for p in (
    r"[0-9]", r"@", r"[^@]+@[^@.]+\.[^@]+", r"[^@]+@[^@.]+", r"\+[0-9]{1,3}", r"\([0-9]{2,5}\)", r"[0-9]{3}[-.][0-9]{4}", r"\(?[0-9]{3}\)?[-.][0-9]{3}[-.][0-9]{4}",
    r"\+?[0-9]{9,11}", r"[0-9]{12,19}", r"[0-9]{4}", r"[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,4}", r"[0-9]{1,3}(\.[0-9]{1,3}){3}", r"[0-9]{1,3}(\.[0-9]{1,3}){3}[:/][0-9]+",
    r"[0-9]+", r"[0-9]{1,3}", r"[0-9]+\.[0-9]+(\.[0-9]+)?", r"[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}", r"[0-9a-f]{16,}", r"(?=[^a-z]*[a-z])[^0-9]*[0-9].*", r"[0-9]{20,}", r".*[=\"'{}<>].*")]
_MATCH = [t.search if i < 2 else t.fullmatch for i, t in enumerate(_TESTS)]
N_TESTS = len(_TESTS) + 8                      # tests, cues (five kinds), check digits, octets, bias
TRIM_L, TRIM_R = "\"'<[{*#$%&|", "\"'>]},;:!?.*#$%&|"


@lru_cache(maxsize=50_000)
def shape(word: str) -> tuple[int, ...]:
    """Numbers of the features that a word has."""
    w = word.strip("\"'<>[]{},;:!?.*#$%&|").lower()
    on = [i for i, t in enumerate(_MATCH) if t(w)]
    cue = CUES.get(w.rstrip(")").lstrip("("))
    if cue is not None:
        on.append(len(_TESTS) + cue)
    digits = w.replace("-", "")
    if 12 <= len(digits) <= 19 and digits.isascii() and digits.isdigit() and luhn(digits):
        on.append(len(_TESTS) + 5)
    if _IP.fullmatch(w.split(":")[0].split("/")[0]) and octets(w.split(":")[0].split("/")[0]):
        on.append(len(_TESTS) + 6)
    return (*on, N_TESTS - 1)


PLAIN = (N_TESTS - 1,)


def design(words: list[str]) -> np.ndarray:
    """Features of each word, then those of its left and right neighbour."""
    own = np.zeros((len(words) + 2, N_TESTS))
    for i, w in enumerate(words):
        own[i + 1, list(shape(w))] = 1
    own[[0, -1], N_TESTS - 1] = 1
    return np.concatenate([own[1:-1], own[:-2], own[2:]], axis=1)


# ---------------------------------------------------------------------------
# labelled table
# ---------------------------------------------------------------------------
def labelled_table(n: int = 500, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Small table of labelled sentences: patterns with filled slots between
    common words of four languages.  Numbers shaped like an item are none after
    a word that names another thing (a price, a part)."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    nz = lambda k: str(rng.integers(1, 10)) + d(k - 1)
    filler = "the of and to in that is it for on was with as de la que le und der die el en los des ein nicht por una les est mit auf from this".split()
    word = lambda: str(rng.choice(filler)) + str(rng.choice(["", "", "", ",", ".", ";", ":", "!"]))
    octet = lambda: str(rng.integers(0, 256))
    name = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(3, 8)))
    check = lambda x: next(x + c for c in "0123456789" if luhn(x + c))
    valid = lambda k: check(nz(k - 1))
    grouped = lambda x: "-".join(x[i:i + 4] for i in range(0, 16, 4))

    def invalid(k):
        x = valid(k)
        return x[:-1] + str((int(x[-1]) + int(rng.integers(1, 10))) % 10)
    entity = {
        1: [lambda: [f"{name()}.{d(2)}@mail{d(1)}.example.com"], lambda: [f"{name()}@{name()}.org"], lambda: [f"{name()}_{d(3)}@{name()}.co.uk"], lambda: [f"{name()}+{name()}@{name()}.net"]],
        2: [lambda: [".".join(octet() for _ in range(4))], lambda: [".".join(octet() for _ in range(4)) + f":{nz(4)}"], lambda: [".".join(octet() for _ in range(4)) + f"/{rng.integers(8, 32)}"]],
        3: [lambda: [valid(16)], lambda: [valid(16)], lambda: [grouped(valid(16))], lambda: [valid(15)]],
        4: [lambda: [f"+{nz(1)}", f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"{nz(3)}-{d(3)}-{d(4)}"], lambda: [f"{nz(3)}.{d(3)}.{d(4)}"],
            lambda: [f"+{nz(2)}", d(3), d(3), d(4)], lambda: [f"+{nz(11)}"], lambda: [f"({nz(3)}){d(3)}-{d(4)}"]]}
    others = [w for w, kind in CUES.items() if kind == 4]
    other = lambda: str(rng.choice(others))
    alike = [lambda: [nz(4)], lambda: [nz(2)], lambda: [f"{nz(1)}.{d(1)}"], lambda: [f"{nz(1)}.{d(1)}.{d(1)}"], lambda: [f"{nz(4)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}"],
             lambda: ["token", "=", f'"{rng.bytes(20).hex()}"'], lambda: ["key", rng.bytes(16).hex()], lambda: ["version", f"{nz(1)}.{d(1)}."], lambda: ["order", nz(9)],
             lambda: ["isbn", invalid(13)], lambda: [f"${nz(3)}.{d(2)}"], lambda: [f"{nz(2)}%"], lambda: ["@"], lambda: [f"@{name()}"], lambda: [f"{name()}{d(2)}"], lambda: ["+"],
             lambda: [f"AKIA{d(4)}{name().upper()}"], lambda: [f"https://{name()}.org/{d(4)}"], lambda: [nz(24)], lambda: ["invoice", invalid(12)], lambda: [invalid(16)], lambda: [invalid(16)], lambda: [grouped(invalid(16))], lambda: ["card", invalid(16)],
             lambda: [f"{rng.integers(256, 999)}.{octet()}.{octet()}.{octet()}"], lambda: [f"{octet()}.{octet()}.{rng.integers(256, 999)}.{octet()}"], lambda: [nz(3), nz(3)],
             lambda: [f"{nz(2)}:{d(2)}"], lambda: [f"{nz(3)},{d(3)}"], lambda: ["id", invalid(16)], lambda: ["page", nz(3)], lambda: [f"{nz(1)}.{d(2)}.{d(2)}.{d(1)}.{d(2)}"], lambda: [f"({nz(2)})"], lambda: [f"({nz(4)})"],
             lambda: [other(), f"{nz(3)}.{d(3)}.{d(4)}"], lambda: [other(), f"{nz(3)}-{d(3)}-{d(4)}"], lambda: [other(), nz(10)]]
    cue = {1: ["email", "contact"], 2: ["ip", "server"], 3: ["card", "visa"], 4: ["phone", "call", "tel:"]}
    out = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(rng.integers(1, 4)):
            for _ in range(rng.integers(0, 7)):
                words.append(word())
                tags.append(0)
            if rng.random() < 0.55:
                k = int(rng.integers(1, 5))
                if rng.random() < 0.4:
                    words.append(str(rng.choice(cue[k])))
                    tags.append(0)
                new = entity[k][rng.integers(len(entity[k]))]()
                words += new[:-1] + [new[-1] + str(rng.choice(["", "", ",", ".", ";"]))]
                tags += [k] * len(new)
            else:
                new = alike[rng.integers(len(alike))]()
                words += new
                tags += [0] * len(new)
        if words:
            out.append((words, tags))
    return out


# ---------------------------------------------------------------------------
# the field
# ---------------------------------------------------------------------------
def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Field:
    """Weights: ``emit`` (3 * N_TESTS x labels) and ``move`` (labels x labels).
    A sequence stands between two words labelled O."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        own, left, right = np.split(emit, 3)
        p = (own + left + right)[N_TESTS - 1]                    # plain word between plain words
        via = lambda b: p[b] + move[:, b][:, None] + move[b][None]
        self.splits = all((via(0) > via(b)).all() for b in range(1, len(LABELS)))

    def log_likelihood(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value and gradients over sequences padded to one length: features
        ``x[step, sequence]``, labels ``y``, lengths ``n``."""
        long, many = y.shape
        e, live = x @ self.emit, np.arange(long)[:, None] < n
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = e[0] + self.move[0]
        for t in range(1, long):
            a[t] = np.where(live[t][:, None], e[t] + _lse(a[t - 1][:, :, None] + self.move, 1), a[t - 1])
        z = _lse(a[-1] + self.move[:, 0], 1)
        b[-1] = self.move[:, 0]
        for t in range(long - 2, -1, -1):
            b[t] = np.where(live[t + 1][:, None], _lse(self.move + (e[t + 1] + b[t + 1])[:, None], 2), self.move[:, 0])
        w = live[..., None]
        node = -np.exp(a + b - z[:, None]) * w
        np.add.at(node, (*np.nonzero(live), y[live]), 1)
        pair = a[:-1, :, :, None] + self.move + (e[1:] + b[1:])[:, :, None] - z[:, None, None]
        move = -(np.exp(pair) * live[1:, :, None, None]).sum(axis=(0, 1))
        np.add.at(move, (y[:-1][live[1:]], y[1:][live[1:]]), 1)
        seq = np.arange(many)
        last = y[n - 1, seq]
        move[0] -= np.exp(a[0] + b[0] - z[:, None]).sum(axis=0)
        move[:, 0] -= np.exp(a[n - 1, seq] + self.move[:, 0] - z[:, None]).sum(axis=0)
        np.add.at(move, (np.zeros(many, int), y[0]), 1)
        np.add.at(move, (last, np.zeros(many, int)), 1)
        steps = self.move[y[:-1], y[1:]] * live[1:]
        value = (np.take_along_axis(e, y[..., None], 2)[..., 0] * live).sum() + steps.sum() + (self.move[0, y[0]] + self.move[last, 0]).sum() - z.sum()
        return float(value), np.tensordot(x, node, ([0, 1], [0, 1])), move

    def viterbi(self, emits: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of several sequences, decoded side by side (longest first)."""
        order = sorted(range(len(emits)), key=lambda i: -len(emits[i]))
        out: list = [None] * len(emits)
        at = 0
        while at < len(order):
            long = len(emits[order[at]])
            some = order[at:at + max(1, 200_000 // long)]
            at += len(some)
            n = np.array([len(emits[i]) for i in some])
            e = np.zeros((long, len(some), len(LABELS)))
            for k, i in enumerate(some):
                e[:n[k], k] = emits[i]
            back = np.zeros(e.shape, np.int8)
            best = e[0] + self.move[0]
            final = best.copy()
            for t in range(1, long):
                go = np.searchsorted(-n, -t, "left")             # sequences longer than t
                step = best[:go, :, None] + self.move
                back[t, :go] = step.argmax(axis=1)
                best[:go] = step.max(axis=1) + e[t, :go]
                final[:go] = best[:go]
            y = (final + self.move[:, 0]).argmax(axis=1)
            path = np.zeros((long, len(some)), np.int8)
            for t in range(long - 1, -1, -1):
                go = np.searchsorted(-n, -t, "left")
                path[t, :go] = y[:go]
                if t:
                    y[:go] = back[t, np.arange(go), y[:go]]
            for k, i in enumerate(some):
                out[i] = path[:n[k], k]
        return out


@lru_cache(maxsize=4)
def default_field() -> Field:
    return train(labelled_table())


def train(table: list[tuple[list[str], list[int]]], rounds: int = 60, rate: float = 0.1, decay: float = 2e-3) -> Field:
    """Adam on the regularised log-likelihood, the whole table per step."""
    n = np.array([len(t) for _, t in table])
    x, y = np.zeros((n.max(), len(table), 3 * N_TESTS)), np.zeros((n.max(), len(table)), int)
    for i, (words, tags) in enumerate(table):
        x[:n[i], i], y[:n[i], i] = design(words), tags
    w = [np.zeros((3 * N_TESTS, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, rounds + 1):
        _, *g = Field(*w).log_likelihood(x, y, n)
        for i in range(2):
            gr = g[i] / len(table) - decay * w[i]
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.99 * v[i] + 0.01 * gr * gr
            w[i] = w[i] + rate * m[i] / (1 - 0.9 ** step) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
    return Field(*w)


_WORD, _PLAINLESS = re.compile(r"\S+"), re.compile(r"[0-9@]")


_FULL = {1: re.compile(r"[^@]+@[^@]+"), 2: re.compile(r"[0-9]+(\.[0-9]+){3}([:/][0-9]+)?"), 3: re.compile(r"(?:[0-9]-?){11,18}[0-9]"),
         4: re.compile(r"\(?[0-9]{3}\)?[-.]?[0-9]{3}[-.][0-9]{4}|\+?[0-9]{9,15}")}
_LEAD, _AREA, _END = re.compile(r"\+[0-9]+"), re.compile(r"\([0-9]{2,5}\)"), re.compile(r"[0-9]{3}[-.][0-9]{4}")


def begins(label: int, before: str, word: str) -> bool:
    """Whether ``word`` begins another item than the word before it, both with
    one label: either is an item by itself, or a number ends or begins there."""
    a, b = before.lstrip(TRIM_L).rstrip(TRIM_R), word.lstrip(TRIM_L).rstrip(TRIM_R)
    full = _FULL[label].fullmatch
    if full(a) or full(b):
        return True
    return label == 4 and bool(_END.fullmatch(a) or b.startswith("+") or _AREA.fullmatch(b) and not _LEAD.fullmatch(a))


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """``(start, kind number, end)`` of the field's spans in each text."""
    emits, where = [], []
    for k, text in enumerate(texts):
        if not _PLAINLESS.search(text) and field.splits:
            continue
        found = list(_WORD.finditer(text))
        words = [m[0] for m in found]
        if field.splits:
            odd = np.array([i for i, w in enumerate(words) if shape(w) != PLAIN])
            if not len(odd):
                continue
            edge = np.flatnonzero(np.diff(odd) > 4)
            lows, highs = odd[np.append(0, edge + 1)] - 1, odd[np.append(edge, len(odd) - 1)] + 2
        else:
            lows, highs = [0], [len(words)]
        for lo, hi in zip(lows, highs, strict=True):
            lo, hi = max(int(lo), 0), min(int(hi), len(words))
            around = design(words[max(lo - 1, 0):hi + 1])
            emits.append((around @ field.emit)[lo - max(lo - 1, 0):][:hi - lo])
            where.append((k, [(m.start(), m[0]) for m in found[lo:hi]]))
    out: list[list] = [[] for _ in texts]
    for (k, words), path in zip(where, field.viterbi(emits), strict=True):
        i = 0
        while i < len(path):
            if not path[i]:
                i += 1
                continue
            j = i
            while j + 1 < len(path) and path[j + 1] == path[i] and not begins(int(path[i]), words[j][1], words[j + 1][1]):
                j += 1
            first, last = words[i], words[j]
            start = first[0] + len(first[1]) - len(first[1].lstrip(TRIM_L))
            end = last[0] + len(last[1].rstrip(TRIM_R))
            if start < end:
                out[k].append((start, int(path[i]) - 1, end))
            i = j + 1
    return out


def all_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    out = []
    for text, extra in zip(texts, field_spans(field, texts), strict=True):
        base = base_spans(text)
        free = _free(text, extra, base)
        out.append(sorted([(*b, True) for b in base] + [(*x, False) for x in free]))
    return out


def _free(text, extra, base):
    """``extra`` less the words that overlap a span of ``base``, by a sweep over merged base spans."""
    if not base:
        return extra
    starts, ends, top = [], [], 0
    for s, _, e in base:
        top = max(top, e)
        starts.append(s)
        ends.append(top)
    # last base span that begins before the end; the ends of merged spans rise
    hit = lambda s, e: (i := bisect_left(starts, e) - 1) >= 0 and ends[i] > s
    out = []
    for s, k, e in extra:
        if not hit(s, e):
            out.append((s, k, e))
            continue
        left: list[tuple[int, int]] = []               # runs of whole words beside the base spans
        apart = True
        for m in _WORD.finditer(text, s, e):
            if hit(m.start(), m.end()):
                apart = True
            elif apart:
                left.append((m.start(), m.end()))
                apart = False
            else:
                left[-1] = (left[-1][0], m.end())
        for a, b in left:
            a += len(text[a:b]) - len(text[a:b].lstrip(TRIM_L))
            b = a + len(text[a:b].rstrip(TRIM_R))
            if _PLAINLESS.search(text[a:b]):
                out.append((a, k, b))
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None,
                       chunk_chars: int = 1_000_000) -> DataFrame:
    """One row per document: ``doc_id, spans`` (kind, start, end, base), sorted."""
    model = field or default_field()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for b in batches:
            held, size, spans = [], 0, []
            for x in b.column("text"):
                held.append(x.as_py())
                size += len(held[-1])
                if size >= chunk_chars:
                    spans += all_spans(model, held)
                    held, size = [], 0
            spans += all_spans(model, held) if held else []
            cells = [[{"kind": KINDS[k], "start": s, "end": e, "base": f} for s, k, e, f in row] for row in spans]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cells, kind)], ["doc_id", "spans"])
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, spans {SPAN}")
