"""Ranked lexical search, byte-pair encoding and periodic runs against brute force, a public library and DuckDB."""

import binascii
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scorewise.llm import bpe as B
from scorewise.llm import periodic_runs as R
from scorewise.llm import queries as Q
from scorewise.llm import ranked_search as S
from scorewise.llm.common import table
from tests.llm.test_llm_operators import DOCS, ROWS
from tests.oracle_util import _rows, duck_connection

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BIG = "x" * 30_000 + " " * 20_000 + "9" * 9_000 + "\n" * 7_000 + "=" * 8_000 + "日本" * 4_000 + "<|endoftext|>" + "ab" * 9_000
MORE = [(11, BIG, "s1"), (12, "<|endoftext|><|endof", "s1"), (13, "a b " * 400, "s2"), (14, "a b c " * 30 + "d " * 40, "s2"), (15, "A,B;A b", "s2")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "x", 7, "clash") for i, t, s in ROWS + MORE], DOCS)


@pytest.fixture(scope="module")
def source():
    with open(TOKENIZER, encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def vocabulary(source):
    return B.Vocabulary(source)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


# --------------------------------------------------------------- ranked search
def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(rows, items, k):
    held = [(i, terms(t)) for i, t in rows if terms(t)]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    out = []
    for item, text in set(items):
        scored = []
        for i, t in held:
            tf, m = Counter(t), 75 + 25 * len(t) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[q] + 1))) * (10**9 * tf[q] // (1000 * tf[q] + 12 * m)) for q in terms(text) if tf[q])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def search(docs, items, **how):
    return sorted((tuple(r) for r in S.ranked_search(docs, items, **how).collect()), key=str)


def test_search_equals_brute_force_on_edge_cases(spark, docs):
    items = [(1, "Null id text, a b!"), (2, None), (3, ""), (None, "the mit license"), (4, "w1x1 w2x2 w2x2"), (4, "a"), (5, "zzz"), (1, "Null id text, a b!"), (6, "été b twice")]
    table_ = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id int, text string, rank int, score string")
    want = brute_search([(i, t) for i, t, _ in ROWS + MORE], items, 3)
    assert search(docs, table_, k=3) == want and want
    assert search(docs, table_, k=3, block_bytes=20) == want                 # several blocks of items
    assert search(docs.limit(0), table_) == [] == search(docs, table_.limit(0))


def test_search_equals_brute_force_over_many_shards(spark, monkeypatch):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    zipf = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rnd.choices(vocabulary, zipf, k=rnd.randint(0, 60)))) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]                      # ties
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 12)))) for i in range(30)]
    monkeypatch.setattr(S, "SHARD_DOCS", 64)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert search(df, spark.createDataFrame(items, "item_id long, text string")) == brute_search(rows, items, 20)


def test_common_terms_make_no_accumulators():
    n = 2000
    sizes = np.array([1 + (i % 100 == 0) for i in range(n)])                  # every 100th document also holds the rare term 2
    held = np.concatenate([[1, 2] if s == 2 else [1] for s in sizes])
    c = S.Collection(n, 10 * n, [0], [(np.array([2, 1]), np.array([1, 1]))], np.array([0, S.weight(n, n // 2), S.weight(n, 20)]))
    shard = S.Shard(c, np.full(n, 10), sizes, held, np.ones(len(held), int))
    found, score, made = shard.scores(*c.terms[0], 20, np.empty(0, np.int64))
    assert made == 1 and found.tolist() == list(range(0, n, 100))
    every, whole, made = shard.scores(*c.terms[0], 21, np.empty(0, np.int64))
    assert made == 2 and len(every) == n and (whole[found] == score).all()    # survivors are scored exactly


def test_search_query_equals_its_sql(spark):
    got = Q.QUERIES["op11_ranked_search"](spark, SF)
    cur = duck_connection(SF).execute(Q.ORACLES["op11_ranked_search"])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(cols, cur.fetchall())


# --------------------------------------------------------- byte-pair encoding
def streamed(vocabulary, text, cuts):
    encoder, out, at = B.Encoder(vocabulary), b"", 0
    for c in cuts:
        out += encoder.feed(text[at:at + c])
        at += c
    return np.frombuffer(out + encoder.feed(text[at:]) + encoder.finish(), "<u4").tolist()


PARTS = st.one_of(st.text(max_size=8), st.sampled_from(["'s", "'LL", "'", " ", "  ", "\n\n", "\t", "12", "<|endoftext|>", "<|endof", "the", " été", "日本", "😀", "\x1c", "\xa0"]),
                  st.builds(lambda c, n: c * n, st.sampled_from(["a", " ", "9", "=", "é", "ab", "\n", "日"]), st.sampled_from([3, 700, 5000])))


@settings(max_examples=60, deadline=None)
@given(st.lists(PARTS, max_size=9).map("".join), st.lists(st.sampled_from([1, 2, 3, 40, 4999, 9000]), max_size=12))
def test_streams_equal_the_library(vocabulary, library, text, cuts):
    want = library.encode(text, add_special_tokens=False).ids
    assert streamed(vocabulary, text, cuts) == want
    decoder, got, at = B.Decoder(vocabulary), "", 0
    for c in cuts:
        got += decoder.feed(want[at:at + c])
        at += c
    assert got + decoder.feed(want[at:]) + decoder.finish() == text


def test_every_character_is_parted_as_the_library_does(vocabulary, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 1 << 16):
        text = "".join(f"a{c}1{c} {c}{c}" for c in every[at:at + (1 << 16)])
        assert streamed(vocabulary, text, []) == library.encode(text, add_special_tokens=False).ids


def test_decoding_broken_bytes_equals_the_library(vocabulary, library):
    rnd = random.Random(2)
    for _ in range(200):
        ids = [rnd.randrange(50_257) for _ in range(30)] + [rnd.choice(vocabulary.byte_ids[128:]) for _ in range(5)] + [60_000]
        assert B.Decoder(vocabulary).feed(ids, True) == library.decode(ids, skip_special_tokens=False)


def test_lookahead_bounds_what_a_continuation_changes():
    rnd = random.Random(7)
    for _ in range(300):
        merges, made, length = [], [0, 1, 2], {0: 1, 1: 1, 2: 1}
        pairs = set()
        while len(merges) < rnd.randint(2, 14):
            u, v = rnd.choice(made), rnd.choice(made)
            if (u, v) in pairs:
                continue
            pairs.add((u, v))
            new = len(length)
            length[new] = length[u] + length[v]
            merges.append((u, v, new))
            made.append(new)
        far = B.lookahead(merges, length)

        def cut(s, merges=merges):
            for u, v, new in merges:
                out, i = [], 0
                while i < len(s):
                    both = s[i:i + 2] == [u, v]
                    out.append(new if both else s[i])
                    i += 1 + both
                s = out
            return s

        def stable(s, n, length=length, far=far):
            out, end = [], 0
            for t in cut(s[:n]):
                end += length[t]
                if end > n - far:
                    break
                out.append(t)
            return out
        for _ in range(20):
            s = [rnd.randrange(3) for _ in range(60)]
            n = rnd.randint(1, 60)
            early = stable(s, n)
            assert cut(s)[:len(early)] == early


def test_merge_lists_of_both_forms_agree(vocabulary):
    rnd = random.Random(3)
    some = ["".join(rnd.choice("aeinrst é日") for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    many = vocabulary.merged_many([s.encode() for s in some])
    assert many == [B.packed(vocabulary.merged(s.encode())) for s in some]
    assert all(vocabulary._merged_long([vocabulary.byte_ids[b] for b in s.encode()]) == vocabulary.merged(s.encode()) for s in some[:500])


def test_memory_of_a_long_pretoken_is_bounded(vocabulary):
    splitter, most = B.Splitter(vocabulary), 0
    for _ in range(60):
        splitter.feed("abcde" * 2000)
        most = max(most, len(splitter.text) + len(splitter.raw) + (len(splitter.run[1].held) if splitter.run else 0))
    assert most < 2 * B.LONG_PRETOKEN + 20_000 + 2 * vocabulary.lookahead


def test_round_trip_operator(docs, source, library):
    got = sorted((tuple(r) for r in B.round_trip(docs, source).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in ROWS + MORE:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert got == sorted(want, key=str)
    ids = B.encoded(docs, source)
    assert {(r[0], tuple(r[1])) for r in ids.collect()} == {(i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ROWS + MORE}
    assert {tuple(r) for r in B.decoded(ids, source).collect()} == {(i, t or "") for i, t, _ in ROWS + MORE}
    assert B.round_trip(docs.limit(0), source).count() == 0
    with pytest.raises(ValueError):
        B.Vocabulary(source.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))


def test_bpe_query_equals_the_library_on_a_whole_table(spark, library):
    got = {r["doc_id"]: r for r in Q.QUERIES["op12_bpe"](spark, SF).collect()}
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


# -------------------------------------------------------------- periodic runs
def brute_runs(s, least=12):
    s, out = np.asarray(s), {}
    for p in range(1, len(s) // 2 + 1):
        same = np.concatenate([[False], s[:-p] == s[p:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for x, y in zip(edge[::2], edge[1::2] + p, strict=True):
            if y - x >= max(least, 2 * p):
                out.setdefault((int(x), int(y)), p)
    return sorted(((x, y, p) for (x, y), p in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = words_kept_case(text)
    n, h = len(w), binascii.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    code = {x: i for i, x in enumerate(w)}
    runs = brute_runs([code[x] for x in w])
    gone = {i for x, y, p in runs for i in range(x + p, y)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *four, sha("".join(f"{x},{y - x},{p}\n" for x, y, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def words_kept_case(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=9), st.integers(1, 9)), max_size=6), st.sampled_from([1, 2, 5, 10_000]), st.sampled_from([1, 2, 12]))
def test_catcher_equals_brute_force(parts, step, least):
    s = [x for u, times in parts for x in u * times]
    catcher = R.SquareCatcher(least)
    for at in range(0, len(s), step):
        catcher.append(s[at:at + step])
        if step == 5:                                                         # squares are reported online
            assert [tuple(r) for r in catcher.runs().tolist()] == brute_runs(s[:at + step], least)
    assert [tuple(r) for r in catcher.runs().tolist()] == brute_runs(s, least)


def test_names_that_collide_lead_to_a_replay(monkeypatch):
    plain = R._mixed
    monkeypatch.setattr(R, "_mixed", lambda x, seed: plain(x, seed) % R._U(2) if seed == 0 else plain(x, seed))
    rnd = random.Random(4)
    s = [rnd.randrange(3) for _ in range(200)] + [0, 1, 2, 3] * 9
    catcher = R.SquareCatcher(2)
    catcher.append(s)
    assert [tuple(r) for r in catcher.runs().tolist()] == brute_runs(s, 2)


def test_periodic_operator_equals_brute_force(docs):
    got = sorted((tuple(r) for r in R.periodic_runs(docs, stream_words=50).collect()), key=str)
    assert got == sorted((brute_row(i, t) for i, t, _ in ROWS + MORE), key=str)
    assert R.periodic_runs(docs.limit(0)).count() == 0
    plain = {r["doc_id"]: r["n_runs"] for r in R.periodic_runs(docs, change=None).collect()}
    assert plain[13] == 1 and plain[14] == 2


def test_periodic_query_equals_brute_force_on_a_whole_table(spark):
    got = sorted(tuple(r) for r in Q.QUERIES["op13_periodic_runs"](spark, SF).collect())
    assert got == sorted(brute_row(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect())
    assert sum(r[1] for r in got) > 10
