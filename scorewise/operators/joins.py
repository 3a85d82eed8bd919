"""Join helpers: broadcast only what has a proven size bound.

Two kinds of small tables appear:

* bounded by a parameter (class count, k, grid size, bucket count): broadcast
  directly, the bound is stated where the hint is given;
* bounded only by the data (for example one row per distinct country): the
  table is checkpointed, its rows counted and its bytes summed, and it is
  broadcast only where both are below the limits; above them the join stays a
  shuffle join (AQE may still pick a broadcast at run time from real sizes).

Tables with a row per input row are joined by ``row_join``: the planner judges a
Parquet table by its compressed files, scaled down to the columns read, and
would broadcast a million rows through the driver as "less than 10 MB".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.config import RunConfig
from scorewise.session import cut_lineage

FIXED_WIDTH = 16                       # upper bound for a number, date or flag in a row


def checked_broadcast(small: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    cfg = RunConfig()
    small = cut_lineage(small)
    texts = [f.name for f in small.schema.fields if f.dataType.typeName() in ("string", "binary")]
    width = F.lit(FIXED_WIDTH * len(small.columns))
    for c in texts:
        width = width + F.coalesce(F.octet_length(c), F.lit(0))
    n, size = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()
    fits = n <= (max_rows or cfg.broadcast_max_rows) and size <= (max_bytes or cfg.broadcast_max_bytes)
    return F.broadcast(small) if fits else small


def bounded_broadcast(small: DataFrame) -> DataFrame:
    """Broadcast a table whose row count is bounded by parameters, not data."""
    return F.broadcast(small)


def row_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two tables that grow with the input: always sort-merge, whatever the
    size of their files, so no rows pass through the driver."""
    return left.hint("merge").join(right.hint("merge"), on, how)
