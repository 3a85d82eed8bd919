"""op3: the dictionary is a store of counts; its cut drops no word and moves no score."""

from functools import partial

import numpy as np

from scorewise.llm import lm_score as ls

# many words that occur equally often: the first bin of the histogram alone is above the cut
TEXTS = [" ".join(f"w{i}x{j}" for j in range(6)) for i in range(12)] + ["", "w0x0 w1x1 never seen"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_words_of_the_model_do_not_depend_on_the_cut(spark):
    learn = spark.createDataFrame([(t.encode(),) for t in TEXTS], "text binary")
    wide, narrow = (ls.gather_corpus(learn, dictionary=n, words=5) for n in (1000, 3))
    assert len(narrow.known) < len(wide.known) == wide.vocab
    words = lambda c: [t for t, i in c.known.items() if 0 < c.out[i] <= 5]
    assert words(narrow) == words(wide) and len(words(wide)) == 5
    for a, b in ((narrow.noise, wide.noise), (narrow.class_total, wide.class_total), (narrow.unseen, wide.unseen)):
        assert np.allclose(a, b)


def test_scores_do_not_depend_on_the_cut(spark, monkeypatch):
    plain = ls.gather_corpus
    got = {}
    for n in (1000, 3):
        monkeypatch.setattr(ls, "gather_corpus", partial(plain, dictionary=n))
        got[n] = {r["doc_id"]: r for r in ls.lm_scores(docs(spark)).collect()}
    assert len(got[3]) == len(TEXTS)
    for i, r in got[1000].items():
        assert got[3][i]["n_known"] == r["n_known"] and got[3][i]["n_tokens"] == r["n_tokens"]
        assert abs(got[3][i]["base_score"] - r["base_score"]) < 1e-9 and abs(got[3][i]["score"] - r["score"]) < 1e-6
