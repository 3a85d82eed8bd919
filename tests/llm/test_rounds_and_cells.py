"""Training in rounds, cells of all unlabelled text, digests made once, and the pipeline on bare tables."""

import re

import numpy as np
import pytest

from scorewise.llm import exact_dedup as X
from scorewise.llm import lm_score as M
from scorewise.llm import quality_pu as Q


def chain_text(rng, n):
    """Each word is followed by one of two words, so that a context says much."""
    w, out = rng.integers(0, 40), []
    for _ in range(n):
        out.append(f"w{w}")
        w = (3 * w + 1 + rng.integers(0, 2)) % 40
    return " ".join(out)


@pytest.fixture(scope="module")
def chains(spark):
    rng = np.random.default_rng(5)
    rows = [(i, chain_text(rng, int(rng.integers(20, 120)))) for i in range(700)] + [(700, chain_text(rng, 9000)), (701, None), (None, "w1 w2")]
    rows += [(800 + i, "one text many times over") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def by_text(df):
    return df.toPandas().sort_values(["doc_id", "n_tokens"]).reset_index(drop=True)


def test_training_is_the_same_at_any_partitioning_and_beats_the_start(spark, chains, monkeypatch):
    weights = []
    for n in (1, 32):
        learn = chains.filter(~M.held_out(chains.doc_id)).selectExpr("cast(coalesce(text, '') as binary) as text").repartition(n)
        weights.append(M.train(learn, M.gather_corpus(learn), 5000).weights())
    assert np.array_equal(*weights)
    one, many = (by_text(M.lm_scores(chains.repartition(n), unit_tokens=5000)) for n in (1, 32))
    # scoring multiplies 32-bit blocks whose rows depend on the partition: equal weights, sums equal to 32-bit rounding
    assert np.allclose(one.score, many.score, rtol=1e-6, atol=0) and (one.n_known == many.n_known).all()
    monkeypatch.setattr(M, "train", lambda learn, corpus, *a: M.Model(corpus.noise))
    start = by_text(M.lm_scores(chains))
    held = one.held_out.to_numpy(bool)
    per_token = lambda t: t.score[held].sum() / t.n_tokens[held].sum()
    assert per_token(one) > per_token(start) + 0.3 and (one.base_score == start.base_score).all()


def test_scores_equal_a_plain_sum_of_chances(spark, chains):
    rows = [(r["doc_id"], (r["text"] or "").lower().encode()) for r in chains.collect()]
    learn = chains.filter(~M.held_out(chains.doc_id)).selectExpr("cast(coalesce(text, '') as binary) as text")
    corpus = M.gather_corpus(learn)
    model = M.train(learn, corpus)
    counts = {bytes(r["token"]): r["c"] for r in corpus.counts.collect()}
    outs = [b""] + [t for t in corpus.known if t != b""][:M.WORDS]
    number = {t: i for i, t in enumerate(outs)}

    def plain(text):
        past, total = [len(corpus.noise)] * M.ORDER, 0.0
        for w in [*text.split(), b""]:
            o = number.get(w, len(outs) + M.word_class(w))
            r = sum(model.ctx[j][past[j]].astype(float) for j in range(M.ORDER))
            s = model.vec.astype(float) @ r + model.bias
            total += s[o] - np.log(np.exp(s).sum())
            if w not in number:
                k = M.word_class(w)
                total += np.log((1 - corpus.unseen[k]) * counts[w] / corpus.class_total[k] if w in counts else corpus.unseen[k])
            past = [o, *past[:-1]]
        return total / np.log(10)
    got = M.lm_scores(chains).toPandas()
    want = sorted((-1 if i is None else i, plain(t)) for i, t in rows)
    have = sorted((-1 if np.isnan(r.doc_id) else int(r.doc_id), r.score) for r in got.itertuples())
    assert [h[0] for h in have] == [w[0] for w in want]
    assert np.allclose([h[1] for h in have], [w[1] for w in want], rtol=1e-4)


def test_the_end_stays_in_the_dictionary(spark, chains):
    learn = chains.selectExpr("cast(coalesce(text, '') as binary) as text")
    assert b"" in M.gather_corpus(learn, dictionary=3).known


def test_equal_pieces_count_as_often_as_they_occur():
    noise = np.log(np.full(5, 0.2))
    x, y = (np.array([[1, 2], [0, 1], [5, 0]]), np.array([2, 3])), np.array([3.0, 1.0], np.float32)
    a, b = M.Trainer(M.Model(noise)), M.Trainer(M.Model(noise))
    a.step(*x, y)
    b.step(np.repeat(x[0], [3, 1], axis=1), np.repeat(x[1], [3, 1]))
    assert np.allclose(a.state(), b.state(), atol=1e-6)
    assert np.array_equal(M.Trainer(M.Model(noise)).with_state(a.state()).state(), a.state())


def test_cells_hold_every_document(spark, chains):
    texts = chains.selectExpr("cast(coalesce(text, '') as binary) as text")
    x = np.array([Q.features(bytes(r["text"])) for r in texts.collect()])
    cells = Q.Cells(x[:200], bits=6)
    means, n = Q.cell_means(texts.repartition(7), cells)
    again, m = Q.cell_means(texts.coalesce(1), cells)
    assert np.array_equal(means, again) and np.array_equal(n, m) and n.sum() == len(x)
    code = cells(x)
    want = {c: x[code == c].mean(axis=0) for c in sorted(set(code.tolist()))}
    assert np.allclose(means, list(want.values()), atol=1e-6) and n.tolist() == [(code == c).sum() for c in want]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_hashed_once_and_not_shuffled(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i % 50}", "s") for i in range(200)], "doc_id long, text string, g_id string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    plan = plan_of(X.exact_copies(docs))
    assert "sha2(" not in plan and "FileScan" not in plan
    kept = X.drop_copies(docs)
    assert not re.search(r"Exchange hashpartitioning", plan_of(kept)) and kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(150, 200))


def test_drop_list_beyond_the_broadcast_bound(spark, monkeypatch):
    from scorewise.llm import common
    monkeypatch.setattr(common, "MAX_DROPPED", 0)
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (4, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in X.drop_copies(docs).collect()) == [2, 4]


@pytest.mark.parametrize("quality, count", [(0, 30), (1, 0)])
def test_pipeline_on_empty_and_refused_tables(spark, sf, tmp_path, quality, count):
    import corpus_pipeline as C
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(count)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = docs.select("doc_id").selectExpr("doc_id", f"{quality} as quality")
    ids.write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
