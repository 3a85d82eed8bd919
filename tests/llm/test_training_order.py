"""The curriculum of the mix reaches the registered rows and the batches."""

import uuid

import corpus_pipeline as C

from scorewise.llm import mixing as MX
from scorewise.llm import packing as K
from scorewise.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string"


def test_packing_keeps_the_mixed_order(spark, tmp_path):
    d = spark.createDataFrame([(i, "w " * (1 + i % 5), "abc"[i % 3]) for i in range(3000)], SCHEMA)
    folder = str(tmp_path / uuid.uuid4().hex)
    mixed = MX.mixed_documents(d)
    mixed.write.parquet(folder)
    got = C.pack(spark, spark.read.parquet(folder), "").toPandas()
    want = [r["doc_id"] for r in mixed.collect()]
    assert got.sort_values(["position", "piece"]).doc_id.tolist() == want
    full = got.sort_values(["bucket", "batch", "slot"])
    assert all(g.position.is_monotonic_increasing for _, g in full.groupby("bucket"))
    flat = MX.mixed_documents(d, ramps=(0.0, 0.0, 0.0))
    flat.write.parquet(folder + "f")
    other = C.pack(spark, spark.read.parquet(folder + "f"), "").toPandas()
    key = ["doc_id", "bucket", "batch", "slot"]
    assert sorted(map(tuple, got[key].to_numpy())) != sorted(map(tuple, other[key].to_numpy()))


def test_files_are_ordered_by_task_number(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a b", "s") for i in range(60)], SCHEMA)
    rows.repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "d"))
    got = K.packed(spark.read.parquet(str(tmp_path / "d")), in_order=True, budget=8, max_len=8).toPandas().sort_values("position")
    assert got.position.tolist() == list(range(60)) == got.doc_id.tolist()
    assert (got.batch * 4 + got.slot).tolist() == list(range(60))


def test_training_order_depends_on_the_ramps(spark, sf):
    d = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(900)], SCHEMA)
    got = MX.training_order(d).toPandas().sort_values("position")
    assert got.position.tolist() == list(range(len(got))) and got.time.is_monotonic_increasing
    assert got.doc_id.tolist() == [r["doc_id"] for r in MX.mixed_documents(d).collect()]
    flat = MX.training_order(d, ramps=(0.0, 0.0, 0.0)).toPandas().sort_values("position")
    assert flat.doc_id.tolist() != got.doc_id.tolist()
    assert MX.training_order(d.limit(0)).count() == 0
    assert QUERIES["op10_mixing_times"](spark, sf).columns == ["doc_id", "copy", "time", "position"]


def test_mixing_rows_carry_the_curriculum(spark, sf):
    """The rows follow the ramps, and equal their SQL."""
    from scorewise.llm import mixing
    from scorewise.llm.common import table
    from scorewise.llm.queries import ORACLES, QUERIES
    from tests.oracle_util import _rows, duck_connection
    got = QUERIES["op10_mixing"](spark, sf)
    cur = duck_connection(sf).execute(ORACLES["op10_mixing"])
    cols = [d[0] for d in cur.description]
    rows = _rows(got.columns, [tuple(r) for r in got.collect()])
    assert rows == _rows(cols, cur.fetchall()) and sorted(cols) == sorted(got.columns)
    flat = mixing.plan_mix(table(spark, sf, "documents"), ramps=(0.0,)).selectExpr("doc_id", "round(get(times, 0), 6) AS t").filter("t IS NOT NULL")
    moved = got.join(flat, "doc_id").filter("first_time <> t").count()
    assert moved > got.count() // 4
