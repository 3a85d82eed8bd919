"""Training-data operators against brute force and on edge cases."""

import binascii
import collections
import hashlib
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from scorewise.llm import embedding_dedup as E
from scorewise.llm import exact_dedup as X
from scorewise.llm import license_scan as L
from scorewise.llm import lm_score as M
from scorewise.llm import mixing as MX
from scorewise.llm import packing as K
from scorewise.llm import pii_crf as P
from scorewise.llm import quality_pu as Q
from scorewise.llm import simhash as S
from scorewise.llm import substring_dedup as D
from scorewise.llm.components import components

DOCS = "doc_id long, text string, source string, size string, kept int, h string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(6000))
ROWS = [(1, "a b c d", "s1"), (2, "a b c d", "s2"), (3, None, "s1"), (4, "", None), (5, LONG, "s2"), (6, LONG + " tail", "s2"),
        (7, "mail me@x.example.com or +1 (202) 555-0147 now", "s1"), (None, "null id text", "s1"), (8, "Released under the MIT License. Released under the MIT License", "s3"),
        (9, "Été \t\n\x0b b \x1c c", "s3"), (10, "twice", "s1"), (10, "twice", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "x", 7, "clash") for i, t, s in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_components(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 32))
    v = np.concatenate([base, base[:20] + rng.standard_normal((20, 32)) * 0.15, base[:1] + rng.standard_normal((1300, 32)) * 0.1, base[:5] * 3, base[:5]])
    rows = [(int(i), x.tolist(), "e") for i, x in enumerate(v)]
    n = len(rows)
    rows += [(n, None, "e"), (n + 1, [0.0] * 32, "e"), (n + 2, [float("nan")] * 32, "e"), (n + 3, [], "e"), (n + 4, [1.0, 0.0], "e"), (n + 5, [float("inf")] + [1.0] * 31, "e"),
             (n + 6, [None] * 32, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")
    got = E.near_vectors(df).toPandas().set_index("vec_id").sort_index()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert (got.n_links[:n].to_numpy() >= link.sum(1) * 0.995).all() and (got.n_links[:n].to_numpy() <= link.sum(1)).all()
    assert got.n_links[:n].sum() >= 0.999 * link.sum()
    assert got.component_id[:n].tolist() == brute_components(n, zip(*np.nonzero(link), strict=True))
    assert (got.n_links[n:] == 0).all() and (got.component_id[n:] == got.index[n:]).all() and got.kept[n:].all()
    assert E.near_vectors(df.limit(0)).count() == 0


def test_license_scan(spark, docs, none):
    got = {r["doc_id"]: r for r in L.scan_licenses(docs).collect()}
    assert (got[8]["n_base"], got[8]["first_word"], got[8]["last_word"], got[8]["base_labels"], got[8]["labels"]) == (2, 1, 6, "mit", "mit")
    assert got[3]["n_words"] == 0 and got[3]["labels"] == "" and got[3]["score"] == 0 and got[5]["n_words"] == 6000
    assert L.scan_licenses(none).count() == 0 and len(L.scan_licenses(docs).collect()) == len(ROWS)
    t = spark.createDataFrame([(1, "GNU Lesser General Public License, version 2.1"), (2, "Licensed under CC BY-NC 4.0."), (3, "SPDX-License-Identifier: MPL-2.0"),
                               (4, "die Lizenz mit der Version 2"), (5, "Apache License Version 2 apache license version 2")], "doc_id long, text string")
    labels = {r["doc_id"]: r["labels"] for r in L.scan_licenses(t).collect()}
    assert labels == {1: "lgpl-2.1", 2: "cc-by-nc,cc-by-nc-4.0", 3: "mpl-2", 4: "", 5: "apache-2"}
    assert len(L.rules()) > 200


def test_lm_scores(spark, docs, none):
    got = M.lm_scores(docs).toPandas()
    learn = collections.Counter()
    held = lambda i: i is None or binascii.crc32(str(i).encode()) % 7 == 2
    for i, t, _ in ROWS:
        if not held(i):
            learn.update([*words(t), ""])
    total, vocab = sum(learn.values()), len(learn)
    want = sorted((i or -1, len(words(t)) + 1, sum(learn[w] > 0 for w in [*words(t), ""]),
                   round(sum(np.log10((learn[w] + 1) / (total + vocab + 1)) for w in [*words(t), ""]), 6)) for i, t, _ in ROWS)
    have = sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got.itertuples())
    assert [h[:3] for h in have] == [w[:3] for w in want] and np.allclose([h[3] for h in have], [w[3] for w in want], atol=1e-5)
    assert (got.train_tokens == total).all() and (got.score < 0).all() and np.isfinite(got.score).all()
    assert M.lm_scores(none).count() == 0


def test_lm_chances_add_up_and_training_helps():
    rng = np.random.default_rng(1)
    noise = np.log(rng.dirichlet(np.ones(12)))
    m = M.Model(noise)
    before = rng.integers(0, 13, (3, 1))
    assert abs(sum(np.exp(m.log_chances(before, np.array([t])))[0] for t in range(12)) - 1) < 1e-5
    seq = np.arange(24_000) % 12                      # each output follows from the one before
    ctx = np.stack([np.concatenate([np.full(j, 12), seq[:-j]]) for j in (1, 2, 3)])
    tr, old = M.Trainer(m), m.log_chances(ctx, seq).mean()
    for _ in range(20):
        for i in range(0, len(seq), 400):
            tr.step(ctx[:, i:i + 400], seq[i:i + 400])
    assert m.log_chances(ctx, seq).mean() > old + 1


def test_chunk_boundaries_are_local_maxima_and_resist_shifts():
    rng = np.random.default_rng(2)
    for _ in range(100):
        x = rng.integers(0, 5, rng.integers(0, 150)).astype(np.uint8)
        h, n = D.gear(x).astype(np.int64), len(x)
        want = [i + 1 for i in range(24, n) if all(h[i] > h[max(0, i - 24):i]) and all(h[i] >= h[i + 1:i + 25])]
        assert D.boundaries(x).tolist() == (want if want and want[-1] == n else [*want, n] if n else [])
    x = rng.integers(97, 123, 5000).astype(np.uint8)
    a, b = D.boundaries(x), D.boundaries(np.concatenate([x[:100], [65, 66, 67], x[100:]]).astype(np.uint8))
    assert set(a[a > 200] + 3) <= set(b)


def test_documents_with_repeats(spark, docs, none):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    passage = text(55)
    t = spark.createDataFrame([(1, text(80) + " " + passage + " " + text(80)), (2, text(31) + " " + passage), (3, text(200)), (4, "short line"), (5, None), (6, "short line")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in D.documents_with_repeats(t).collect()}
    assert set(got) == {1, 2} and got[1]["copied_bytes"] == 0 and got[2]["copied_bytes"] > 150
    assert {r["doc_id"] for r in D.documents_with_repeats(docs).collect()} == {5, 6}
    assert D.documents_with_repeats(none).count() == 0


def test_quality(spark, docs, none):
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice("the of and river walked slowly towards evening light".split(), 60)) + "."
    bad = lambda: " | ".join(rng.choice("x y z q w".split(), 60)) + " ###"
    rows = [(i, good() if i % 4 else bad(), 1 if i % 4 else 0) for i in range(400)]
    d = spark.createDataFrame([(i, t, "c") for i, t, _ in rows], "doc_id long, text string, score string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2 == 0 or i % 4 == 1] + [(None, 1), (9999, 0), (4, None)], "doc_id long, quality int")
    model = Q.fit_quality(d, lab)
    got = Q.score_quality(d, model).toPandas()
    assert (got.predicted == [y for _, _, y in rows]).mean() > 0.98 and got.score.between(0, 1).all()
    assert (got.held_out == [binascii.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert Q.score_quality(docs, model).count() == len(ROWS) and Q.score_quality(none, model).count() == 0
    assert Q.keep_good(docs, model).columns == docs.columns
    blank = Q.fit_quality(docs, lab.limit(0))
    assert {r["score"] for r in Q.score_quality(docs, blank).collect()} == {1.0}


def brute_fingerprint(t):
    w = words(t)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs, none):
    found = S.near_documents(docs).select("doc_id", S.hex16(F.col("fp")).alias("f"), "component_id").toPandas()
    assert sorted(found.f) == sorted(f"{brute_fingerprint(t):016x}" for _, t, _ in ROWS)
    comp = {None if pd.isna(r.doc_id) else int(r.doc_id): r.component_id for r in found.itertuples()}
    assert comp[2] == 1 and comp[4] == 3
    kept = S.drop_near_documents(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(10) == 1 and 2 not in ids and 4 not in ids and 1 in ids
    assert S.near_documents(none).count() == 0 and S.drop_near_documents(none).count() == 0


def test_linked_fingerprints_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:20].tolist():
        for _ in range(60):
            fps.add(b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)))
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in components(S.linked_fingerprints(df), "fp", "to").collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    root = brute_components(len(fps), [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    signed = fps.view(np.int64).tolist()
    group = collections.defaultdict(list)
    for i, r in enumerate(root):
        group[r].append(signed[i])
    want = {x: min(g) for g in group.values() if len(g) > 1 for x in g}
    assert got == want


def test_personal_data(spark, docs, none):
    got = {r["doc_id"]: r["spans"] for r in P.find_personal_data(docs).collect()}
    text = ROWS[6][1]
    assert [(s["kind"], text[s["start"]:s["end"]], s["base"]) for s in got[7]] == [("email", "me@x.example.com", True), ("phone", "+1 (202) 555-0147", True)]
    assert got[3] == [] and got[5] == [] and P.find_personal_data(none).count() == 0


def test_base_patterns_and_field():
    rng = np.random.default_rng(6)
    pats = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def plain(x):
        out = []
        for k, p in enumerate(pats):
            for m in re.finditer(p, x):
                n = re.sub("[^0-9]", "", m[0])
                good = (k == 0 or k == 1 and all(int(q) <= 255 for q in m[0].split(".")) or k == 3 and 9 <= len(n) <= 15
                        or k == 2 and 12 <= len(n) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(n[::-1])) % 10 == 0)
                if good:
                    out.append((m.start(), k, m.end()))
        return sorted(out)
    for _ in range(3000):
        x = "".join(rng.choice(list("a1.@+- (5)09"), rng.integers(0, 45)))
        assert P.base_spans(x) == plain(x), x
    field = P.default_field()
    assert field.splits
    test = P.labelled_table(150, seed=77)
    paths = field.viterbi([P.design(w) @ field.emit for w, _ in test])
    assert np.mean(np.concatenate([p == t for p, (_, t) in zip(paths, test, strict=True)])) > 0.98
    whole = P.Field(field.emit, field.move)
    whole.splits = False
    texts = [" ".join(w) for w, _ in test] + ["a b c " * 50 + "(202) 555-0147 " + "d e f " * 50]
    assert P.field_spans(whole, texts) == P.field_spans(field, texts)


def test_field_gradient():
    table = P.labelled_table(6, seed=1)
    n = np.array([len(t) for _, t in table])
    x, y = np.zeros((n.max(), len(table), 3 * P.N_TESTS)), np.zeros((n.max(), len(table)), int)
    for i, (w, t) in enumerate(table):
        x[:n[i], i], y[:n[i], i] = P.design(w), t
    rng = np.random.default_rng(0)
    emit, move = rng.normal(0, 0.3, (3 * P.N_TESTS, 5)), rng.normal(0, 0.3, (5, 5))
    _, ge, gm = P.Field(emit, move).log_likelihood(x, y, n)
    for (i, j) in [(0, 0), (0, 3), (2, 1), (4, 4)]:
        up, down = move.copy(), move.copy()
        up[i, j] += 1e-5
        down[i, j] -= 1e-5
        num = (P.Field(emit, up).log_likelihood(x, y, n)[0] - P.Field(emit, down).log_likelihood(x, y, n)[0]) / 2e-5
        assert abs(num - gm[i, j]) < 1e-4
    i = P.N_TESTS - 1
    up, down = emit.copy(), emit.copy()
    up[i, 2] += 1e-5
    down[i, 2] -= 1e-5
    num = (P.Field(up, move).log_likelihood(x, y, n)[0] - P.Field(down, move).log_likelihood(x, y, n)[0]) / 2e-5
    assert abs(num - ge[i, 2]) < 1e-4


@pytest.mark.parametrize("most", [100_000, 0])
def test_exact_copies(docs, none, most):
    got = {r["doc_id"]: r for r in X.exact_copies(docs, max_survivors=most).collect()}
    assert (got[1]["keep_id"], got[1]["group_size"], got[1]["kept"]) == (2, 2, False)
    assert got[3]["keep_id"] == 4 and got[5]["kept"] and got[None]["kept"] and got[10]["group_size"] == 2
    assert got[9]["text_sha256"] == hashlib.sha256(ROWS[9][1].encode()).hexdigest()
    assert X.exact_copies(none, max_survivors=most).count() == 0
    kept = X.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 4, 5, 6, 7, 8, 9, 10]


def test_best_boundaries_are_optimal():
    from itertools import combinations
    rng = np.random.default_rng(8)
    for _ in range(60):
        lens = sorted(set(rng.integers(1, 60, rng.integers(1, 9)).tolist()))
        n = rng.integers(1, 20, len(lens)).tolist()
        cost = lambda b: sum(c * min(x for x in b if x >= ln) for ln, c in zip(lens, n, strict=True))
        k = int(rng.integers(1, 5))
        best = min(cost((*c, lens[-1])) for r in range(min(k, len(lens))) for c in combinations(lens[:-1], r))
        got = K.best_boundaries(lens, n, k)
        assert len(got) <= k and got[-1] == lens[-1] and cost(got) == best


def test_packing(docs, none):
    got = K.packed(docs, max_len=1000, buckets=3, budget=2000).toPandas()
    per = got.groupby("doc_id").length.sum()
    assert per[5] == 6000 and per[6] == 6001 and per[3] == 0 and got[got.length == 0].batch.isna().all()
    full = got[got.length > 0]
    assert (full.length <= full.boundary).all()
    use = full.groupby(["bucket", "batch"]).agg(n=("length", "size"), b=("boundary", "max"))
    assert (use.n * use.b <= 2000).all() and not full.duplicated(["bucket", "batch", "slot"]).any()
    assert K.packed(none).count() == 0


def test_mixing(spark, docs, none):
    rows = [(i, "w " * (1 + i % 7), None if i % 3 == 0 else "a" if i % 3 == 1 else "bé") for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = MX.plan_mix(d).toPandas()
    size = {i: 1 + i % 7 for i, _, _ in rows}
    total, per = sum(size.values()), got.groupby("src")["size"].sum()
    w = dict(zip(sorted(per.index), (5.0, 2.0, 1.0), strict=True))
    target, free, left = {}, set(per.index), 1.5 * total
    while free:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * per[s]}
        if not over:
            target |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
            break
        target |= {s: 2.0 * per[s] for s in over}
        left -= sum(2 * per[s] for s in over)
        free -= over
    for s, g in got.groupby("src"):
        assert abs(g.target.iloc[0] - target[s]) < 1e-6 and abs(g.taken.sum() - target[s]) <= 4
    assert (got.taken <= 2 * got["size"]).all() and got.src.max() == "t"
    assert all(0 <= t <= 1 for ts in got.times for t in ts)
    out = MX.mixed_documents(docs)
    assert out.columns == docs.columns
    plan = MX.plan_mix(docs)
    assert out.count() == plan.agg(F.sum("copies")).first()[0] and plan.count() == len(ROWS)
    assert MX.plan_mix(none).count() == 0 and MX.mixed_documents(none).count() == 0


def test_pipeline_stages_and_run(spark, sf):
    sf_dir = sf
    import corpus_pipeline as C
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = {}
    docs = d
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == d.columns
            rows = out.toPandas()
            sizes[name] = len(rows)
            docs = spark.createDataFrame(rows, d.schema)
            if name == "exact_dedup":
                assert not rows.text.duplicated().any()
            if name == "near_dedup":
                f = np.array([brute_fingerprint(t) for t in rows.text], np.uint64)
                assert (np.bitwise_count(f[:, None] ^ f[None]) <= 2).sum() == len(f)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").count()
    assert sizes["quality"] >= good * 0.9
    assert C.run(spark, sf_dir).select("doc_id").distinct().count() <= sizes["near_dedup"]
