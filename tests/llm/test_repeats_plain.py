"""Spans, copied parts and remaining texts against a plain version; recall of repeated passages by length."""

import collections
import hashlib

import numpy as np

from scorewise.llm import substring_dedup as D


def plain_chunks(text, reach=D.REPEAT_REACH):
    """Starts and ends of chunks by the definition: a position ends a chunk if its value over the
    last bytes exceeds those ``reach`` before it and is at least those ``reach`` after it."""
    h = []
    for i in range(len(text)):
        h.append(sum(int(D._GEAR[text[i - k]]) << (2 * k) for k in range(min(D.WINDOW, i + 1))) % 2**32)
    ends = [i + 1 for i in range(reach, len(text)) if h[i] > max(h[i - reach:i]) and h[i] >= max(h[i + 1:i + 1 + reach], default=0)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []


def plain_repeats(rows):
    """By row number: spans, copied parts and the remaining text of every row that shares a span."""
    texts = [(t or "").encode() for _, t in rows]
    places = collections.defaultdict(list)
    for n, text in enumerate(texts):
        for s, e in plain_chunks(text):
            places[text[s:e]].append((rows[n][0], n, s))
    out = {}
    for n, text in enumerate(texts):
        runs = []
        for s, e in plain_chunks(text):
            if len(places[text[s:e]]) < 2:
                continue
            copy = min(places[text[s:e]])[1:] != (n, s)
            if runs and runs[-1][-1][1] == s:
                runs[-1].append((s, e, copy))
            else:
                runs.append([(s, e, copy)])
        runs = [r for r in runs if r[-1][1] - r[0][0] >= D.MIN_BYTES]
        copies = []
        for r in runs:
            parts = []
            for s, e, copy in r:
                if parts and parts[-1][2] == copy:
                    parts[-1][1] = e
                else:
                    parts.append([s, e, copy])
            copies += [(s, e) for s, e, copy in parts if copy and e - s >= D.MIN_BYTES]
        if runs:
            gone = np.zeros(len(text), bool)
            for s, e in copies:
                while s < e and text[s] & 0xC0 == 0x80:         # a character that a span holds in part stays
                    s += 1
                while s < e < len(text) and text[e] & 0xC0 == 0x80:
                    e -= 1
                gone[s:e] = True
            out[n] = ([(r[0][0], r[-1][1]) for r in runs], copies, bytes(b for b, g in zip(text, gone, strict=True) if not g))
    return out


def test_spans_and_remaining_texts_equal_a_plain_version(spark):
    rng = np.random.default_rng(21)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijé"), rng.integers(2, 8))) for _ in range(n))
    passages = [text(n) for n in (5, 15, 25, 40, 60, 90)]
    rows = []
    for i in range(60):
        parts = [passages[rng.integers(len(passages))] if rng.random() < 0.4 else text(int(rng.integers(1, 40))) for _ in range(rng.integers(1, 6))]
        rows.append((int(rng.integers(0, 45)), " ".join(parts)))                  # some ids repeat
    rows += [(100, None), (101, ""), (102, "short"), (103, "ab " * 400), (104, "ab " * 400), (105, rows[0][1]), (rows[1][0], rows[1][1])]
    want = plain_repeats(rows)
    assert len(want) > 20 and any(c for _, c, _ in want.values())
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spans = lambda s: [tuple(map(int, x.split(":"))) for x in s.split(",")] if s else []
    got = sorted((r["doc_id"], spans(r["spans"]), spans(r["copied_spans"]), r["left_bytes"], r["left_sha256"]) for r in D.documents_with_repeats(d).collect())
    assert got == sorted((rows[n][0], s, c, len(left), hashlib.sha256(left).hexdigest()) for n, (s, c, left) in want.items())
    left = sorted((r["doc_id"], r["text"] or "") for r in D.drop_repeats(d).collect())
    assert left == sorted((i, want[n][2].decode() if n in want else t or "") for n, (i, t) in enumerate(rows))


def found(rng, size, tries):
    """Share of random passages of ``size`` bytes, between random bytes, that keep ``MIN_BYTES`` of whole shared chunks."""
    hits = 0
    for _ in range(tries):
        p, around = rng.integers(97, 123, size, np.uint8), lambda: rng.integers(97, 123, rng.integers(100, 300), np.uint8)
        pairs = []
        for _ in range(2):
            before = around()
            ends = D.boundaries(np.concatenate([before, p, around()]), D.REPEAT_REACH) - len(before)
            pairs.append({(int(s), int(e)) for s, e in zip(ends[:-1], ends[1:], strict=True) if s >= 0 and e <= size})
        both = sorted(pairs[0] & pairs[1])
        best = run = last = 0
        for s, e in both:
            run = run + e - s if s == last else e - s
            best, last = max(best, run), e
        hits += best >= D.MIN_BYTES
    return hits / tries


def test_recall_of_passages_by_length():
    rng = np.random.default_rng(4)
    assert found(rng, 160, 150) >= 0.9 and found(rng, 200, 150) >= 0.97 and found(rng, 230, 150) == 1
