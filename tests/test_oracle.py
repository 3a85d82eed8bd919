"""Every query that SQL can express equals its DuckDB oracle (same fixture
text, same parquet files)."""

import pytest

from scorewise.plans.catalog import REGISTRY
from tests.oracle_util import compare

WITH_ORACLE = sorted(n for n, (_, sql) in REGISTRY.items() if sql)


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_query_matches_oracle(spark, sf, duck, name):
    r = compare(spark, name, sf, duck)
    assert r["status"] == "ok", r


def test_registry_contract():
    import __spark_entry__ as entry
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
    for name in REGISTRY:                 # these names belong to the training-data operators
        assert "pipeline" not in name and not name.startswith("op")


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and set(df.columns) == {"model", "wf1", "hrec", "hf1", "phc", "med_f1"}
