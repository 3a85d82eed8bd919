"""Checks inside the pass that reads, alignment of separate runs, the evidence document."""

import pytest
from pyspark.sql import functions as F

from scorewise.operators import clean as cl
from scorewise.operators import metrics as me
from scorewise.operators import report as rp
from scorewise.session import cut_lineage
from scorewise.sources import fixtures as fx


def test_reading_checks_in_one_pass(spark, sf):
    plans = []

    def write(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)
    raw = cut_lineage(fx.survey(spark, sf))
    table, seen = cl.read_checked(raw, write)
    assert len(plans) == 1 and plans[0].count("FileScan") == 1 and "CollectMetrics" in plans[0]
    assert seen["rows"] == table.count() == seen["class_0"] + seen["class_1"] + seen["class_2"] and seen["unknown_labels"] == 0
    assert seen["null_country"] == table.filter("country IS NULL").count()
    assert table.exceptAll(cl.read_scored_table(raw)).count() == 0
    bad = raw.withColumn("target", F.when(F.col("id") % 5 == 0, F.concat(F.lit("odd"), F.col("id") % 3)).otherwise(F.col("target")))
    with pytest.raises(ValueError, match=r"in \d+ rows: \['odd0', 'odd1', 'odd2'\]$"):
        cl.read_checked(bad, cut_lineage)
    assert cl.read_checked(raw.limit(0), cut_lineage)[1]["rows"] == 0


def test_text_is_stripped_of_every_space(spark):
    df = spark.createDataFrame([("  Yes\x1f\n",), ("\xa0 12.5 　",), (" a b ",), ("​no",), ("-1E3\t",), (None,)], "v string")
    assert [r[0] for r in cl.clean_frame(df).collect()] == [1.0, 12.5, 0.0, 0.0, -1000.0, 0.0]


def test_runs_that_do_not_align_fail(spark):
    rows = [(i, m, 0.2, 0.3, 0.5) for i in (1, 2, None) for m in ("cb", "lg")]
    df = lambda r: spark.createDataFrame(r, "id long, model string, p0 double, p1 double, p2 double")
    whole = rp.aligned_scores(df(rows), ("cb", "lg"), cut_lineage)
    assert whole.columns == ["id", *[f"{m}{c}" for m in ("cb", "lg") for c in range(3)]]
    assert {r["id"] for r in whole.collect()} == {1, 2, None}
    with pytest.raises(ValueError, match="'missing': 1, 'repeated': 1, 'of other models': 1"):
        rp.aligned_scores(df([*rows[1:], rows[2], (2, None, 1.0, 0.0, 0.0)]), ("cb", "lg"), cut_lineage)
    assert rp.aligned_scores(df([]), ("cb",), cut_lineage).count() == 0


def test_evidence_is_one_nested_row(spark, sf):
    long = me.scores_long(fx.oof(spark, sf), {"cb": [F.col(f"cb{c}") for c in range(3)]})
    doc = rp.evidence_document({"model_comparison": me.model_comparison(long.withColumn("fold", F.lit(0))),
                                "seed_stability": spark.createDataFrame([(0.5, 3)], "wf1_mean double, n_seeds long")})
    assert doc.count() == 1 and doc.columns == ["model_comparison", "seed_stability"]
    rows = {(r["section"], r["item"], r["key"]): r["number"] for r in rp.evidence_rows(doc).collect()}
    assert rows["seed_stability", "", "n_seeds"] == 3.0 and ("model_comparison", "cb", "wf1") in rows
