"""Null and repeated ids of vectors; very long texts full of anchors and digits."""

from scorewise.llm import embedding_dedup as E
from scorewise.llm import license_scan as L
from scorewise.llm import pii_crf as P


def test_vectors_with_null_and_repeated_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = [1.0, 0.01, 0.0]
    rows = [(5, a), (5, near), (None, a), (5, b), (None, c), (None, None), (7, None), (7, c)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in E.near_vectors(d).select("vec_id", "n_links", "component_id", "kept").collect()]
    want = [(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (5, 0, 5, True), (None, 1, 7, False), (None, 0, None, True), (7, 0, 7, True), (7, 1, 7, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    lone = spark.createDataFrame([(None, a), (None, near)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in E.near_vectors(lone).collect()] == [(None, 1, None, True)] * 2


def test_long_texts_full_of_anchors(spark):
    n = 40_000
    text = "license the MIT License version gpl " * n + "under the MIT license"
    r = L.scan_licenses(spark.createDataFrame([(1, text), (2, "gpl")], "doc_id long, text string")).orderBy("doc_id").first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["base_labels"]) == (6 * n + 4, 1, 6 * n, "mit") and r["labels"].split(",") == ["gpl", "mit"]
    assert r["n_detections"] == 2 * n + 1


def test_long_texts_full_of_items_and_digits(spark):
    n = 4_000
    unit = "call 212-555-0187 or write a.b@mail.example.com now "
    texts = [unit * n, "7" * 200_000, "1." * 100_000, "@" * 100_000, "+1 " * 50_000]
    got = P.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    kinds = [s["kind"] for s in got[0]["spans"]]
    assert kinds.count("email") == n and kinds.count("phone") == n
    assert [(s["start"], s["end"]) for s in got[0]["spans"]][-1] == ((n - 1) * len(unit) + unit.index("a.b"), (n - 1) * len(unit) + unit.index(" now"))
    assert all(not s["base"] or s["kind"] != "email" for g in got[1:] for s in g["spans"])
