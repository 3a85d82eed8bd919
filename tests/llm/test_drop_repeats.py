"""Copied spans are told apart from original ones and leave the texts."""

import hashlib

import numpy as np

from scorewise.llm import substring_dedup as D


def test_copied_spans_leave_the_texts(spark):
    rng = np.random.default_rng(12)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijé"), 5)) for _ in range(n))
    p, q = text(80), text(80)
    rows = [(1, text(40) + " " + p, 1), (2, text(40) + " " + p + " " + q, 2), (3, text(40) + " " + q + " " + text(40), 3), (4, text(60), 4), (5, None, 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = {r["doc_id"]: r for r in D.documents_with_repeats(d).collect()}
    assert set(got) == {1, 2, 3} and got[1]["copied_spans"] == ""
    left = {r["doc_id"]: r for r in D.drop_repeats(d).collect()}
    assert len(left) == 5 and list(left[1].asDict()) == d.columns
    for i in (1, 4, 5):
        assert left[i]["text"] == rows[i - 1][1]
    whole = rows[1][1].encode()
    cut = [tuple(map(int, x.split(":"))) for x in got[2]["copied_spans"].split(",")]
    assert len(cut) == 1 and whole.find(p.encode()) <= cut[0][0] and cut[0][1] <= whole.find(q.encode()) + 60   # q is original here
    assert q[40:-40] in left[2]["text"] and p[60:-60] not in left[2]["text"] and q[60:-60] not in left[3]["text"]
    assert left[3]["text"].startswith(rows[2][1][:200]) and left[3]["text"].endswith(rows[2][1][-200:])
    for i in (1, 2, 3):
        assert got[i]["left_bytes"] == len(left[i]["text"].encode()) and got[i]["left_sha256"] == hashlib.sha256(left[i]["text"].encode()).hexdigest()


def test_characters_stay_whole():
    assert D.without("aébc".encode(), [2], [4]) == "aéc".encode()
    assert D.without("aébc".encode(), [0], [2]) == "ébc".encode()
    assert D.without(b"abcdef", [1, 4], [2, 6]) == b"acd"
