"""The decision applied to a score stream equals the batch result."""

import tempfile

from pyspark.sql import functions as F

from scorewise.operators import metrics as me
from scorewise.sources import fixtures as fx
from scorewise.streaming import scoring as st


def test_stream_confusion_equals_batch(spark, sf):
    oof = fx.oof(spark, sf)
    src = tempfile.mkdtemp(prefix="scorewise-stream-")
    oof.repartition(3).write.mode("overwrite").parquet(src)
    schema = spark.read.parquet(src).schema
    q = st.start_confusion_stream(spark, src, schema, "confusion_test", alpha=1.08)
    q.awaitTermination(120)
    got = {(r["y"], r["pred"]): r["n"] for r in spark.table("confusion_test").collect()}
    batch = st.running_confusion(st.score_rows(oof, alpha=1.08, keep=("id", "y")))
    want = {(r["y"], r["pred"]): r["n"] for r in batch.collect()}
    assert got == want and sum(got.values()) == oof.count()
