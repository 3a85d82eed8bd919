"""No row is lost, and dirty values are cleaned, on input the fixtures lack."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewise.operators import clean as cl
from scorewise.operators import encode as en
from scorewise.operators import folds as fo
from scorewise.sources import io


def test_folds_keep_rows_of_unknown_class(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 != 0, (F.col("id") % 3).cast("int")).alias("y"))
    out = fo.assign_folds(df).toPandas()
    assert len(out) == 100 and out.fold.between(0, 4).all()
    assert (out[out.y.isna()].groupby("fold").size() == 2).all()


def test_stored_folds_fit_or_fail(spark, tmp_path):
    df = spark.range(90).select("id", (F.col("id") % 3).cast("int").alias("y"))
    more = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("y"))
    path = str(tmp_path / "folds")
    first = io.get_or_create_folds(spark, df, path).toPandas().sort_values("id").fold.tolist()
    assert first == io.get_or_create_folds(spark, df, path).toPandas().sort_values("id").fold.tolist()
    with pytest.raises(ValueError, match="10 ids without a fold"):
        io.get_or_create_folds(spark, more, path)
    with pytest.raises(ValueError, match="50 folds without an id"):
        io.get_or_create_folds(spark, df.filter("id < 40"), path)
    (tmp_path / "broken").mkdir()
    with pytest.raises(ValueError, match="unfinished"):
        io.get_or_create_folds(spark, df, str(tmp_path / "broken"))


def test_cleaning_of_nan_and_white_space(spark):
    df = spark.createDataFrame([(1, float("nan"), "Yes\t"), (2, None, "Yes "), (3, 2.0, "\n2.5"), (4, 1.0, "  7 　"), (5, 0.5, None)],
                               "id long, x double, t string")
    got = cl.clean_frame(df).orderBy("id").toPandas()
    assert got.x.tolist() == [0.0, 0.0, 2.0, 1.0, 0.5] and got.t.tolist() == [1.0, 1.0, 2.5, 7.0, 0.0]


def test_null_key_gets_global_shares(spark):
    df = spark.range(60).select("id", (F.col("id") % 3).cast("int").alias("y"), F.when(F.col("id") % 2 == 0, F.lit("a")).alias("key"))
    got = en.oof_target_encoding(df, "key").toPandas()
    assert len(got) == 60 and got[["te0", "te1", "te2"]].notna().all().all()


def test_inner_folds_follow_the_seed(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 7).alias("key"))
    a, b = (en.oof_target_encoding(df, "key", seed=s).orderBy("id").toPandas() for s in (49, 130))
    assert (a.te0 != b.te0).any()


def test_overlap_check_counts(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)] + [(0, 1)], "id long, fold int")
    got = fo.fold_overlap_check(df).orderBy("fold").toPandas()
    assert got.n_val.tolist() == [10, 11, 10, 10, 10] and got.n_train.tolist() == [41, 40, 41, 41, 41] and got.n_overlap.tolist() == [1, 1, 0, 0, 0]


def test_csv_predictions_follow_the_template(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("ID,x,Target\na1,Yes,Low\na2, 2.5 ,High\n")
    raw = io.read_csv(spark, str(tmp_path / "raw.csv"))
    assert {t for _, t in raw.dtypes} == {"string"}
    (tmp_path / "ids.csv").write_text("ID\na2\na9\n")
    template = io.read_template(spark, str(tmp_path / "ids.csv"))
    assert io.read_template(spark, str(tmp_path / "none.csv")) is None
    labels = raw.select(F.col("ID").alias("id"), "Target", F.lit("cb").alias("model"))
    io.write_predictions(labels, str(tmp_path / "out"), template, ["cb", "lg"])
    back = io.read_csv(spark, str(tmp_path / "out")).select("id", "Target", "model").collect()
    assert sorted((r[0], r[1] or "", r[2]) for r in back) == [("a2", "", "lg"), ("a2", "High", "cb"), ("a9", "", "cb"), ("a9", "", "lg")]
    io.write_predictions(labels, str(tmp_path / "all"))
    assert io.read_csv(spark, str(tmp_path / "all")).count() == 2


def test_scores_and_evidence_round_trip(spark, tmp_path):
    long = spark.createDataFrame([(1, "cb", 0.5, 0.25, 0.25), (1, "lg", 0.0, 0.0, 1.0)], "id long, model string, p0 double, p1 double, p2 double")
    io.write_scores(long, str(tmp_path / "scores"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "scores")).select(*long.columns).collect())) == sorted(map(tuple, long.collect()))
    doc = spark.createDataFrame([('{"a":1}',)], "evidence string")
    io.write_evidence(doc, str(tmp_path / "evidence"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "evidence")).collect()] == ['{"a":1}']


def test_centres_of_any_number_are_taken_in_blocks(spark):
    from scorewise.operators import kmeans as km
    rnd = np.random.default_rng(1)
    centres = rnd.standard_normal((70, 3))
    table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "label long, centre array<double>")
    points = [(i, [float(x) for x in p]) for i, p in enumerate(rnd.standard_normal((200, 3)))] + [(200, None), (201, [1.0]), (202, [float(x) for x in centres[9]])]
    df = spark.createDataFrame(points, "id long, v array<double>")
    one, many = ({r["id"]: (r["cluster_id"], r["dist"]) for r in km.nearest_of(df, "v", table, "label", "centre", ["id"], pass_cells=c).collect()}
                 for c in (10_000, 12))
    assert one == many and one[200] == one[201] == (None, None) and one[202] == (9, 0.0)
    for i, p in points[:200]:
        far = ((np.array(p) - centres) ** 2).sum(1)
        assert one[i][0] == far.argmin() and abs(one[i][1] - far.min() ** 0.5) < 1e-9
