"""Repeated passages of 51 short words are found wherever they stand."""

import numpy as np

from scorewise.llm import substring_dedup as D


def test_passages_of_51_short_words_are_found(spark):
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    text = lambda n, a, b: " ".join("".join(rng.choice(letters, rng.integers(a, b + 1))) for _ in range(n))
    rows, at = [], {}
    for k in range(120):
        passage = text(51, 3, 4)
        for side in (0, 1):
            before = text(10 + (k + 7 * side) % 30, 2, 9) + " "
            rows.append((2 * k + side, before + passage + " " + text(20, 2, 9)))
            at[2 * k + side] = (len(before), len(before) + len(passage))
    got = {r["doc_id"]: r for r in D.documents_with_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(at)
    for i, r in got.items():
        spans = [tuple(map(int, x.split(":"))) for x in r["spans"].split(",")]
        assert all(at[i][0] <= s and e <= at[i][1] + 1 for s, e in spans) and (r["copied_bytes"] > 0) == (i % 2 == 1)
