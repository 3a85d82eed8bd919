"""Structured Streaming use of the fitted decision.

Once the blend weights and the decision (alpha or gate) are chosen, scoring
a row is stateless: blend, apply the decision, take the argmax, map to the
label.  The same column expressions as the batch operators run on a
``readStream`` source.  ``running_confusion`` keeps the confusion counts per
(true class, prediction) as streaming state, from which every metric of
``operators.metrics`` follows; it is bounded (at most 9 keys).

Checkpoint locations live under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.config import GATE_HIGH_FLOOR
from scorewise.functions.columns import argmax3, dlit
from scorewise.operators.clean import decode_label
from scorewise.session import ensure_checkpoint_dir


def score_rows(df: DataFrame, weights=(1 / 3, 1 / 3, 1 / 3), alpha: float | None = None,
               gate: tuple | None = None, first: str = "cb", keep=("id",)) -> DataFrame:
    """Blend -> decision -> argmax -> label (works on batch and streaming frames)."""
    w = [F.lit(float(x)) for x in weights]
    p = [w[0] * F.col(f"cb{c}") + w[1] * F.col(f"lg{c}") + w[2] * F.col(f"xg{c}") for c in range(3)]
    p2 = p[2]
    if alpha is not None:
        p2 = F.lit(float(alpha)) * p2
    if gate is not None:
        t_first, t_blend = gate
        on = (F.col(f"{first}2") > F.lit(float(t_first))) & (p[2] > F.lit(float(t_blend)))
        p2 = F.when(on, F.greatest(p2, dlit(GATE_HIGH_FLOOR))).otherwise(p2)
    s = p[0] + p[1] + p2
    pred = argmax3(p[0] / s, p[1] / s, p2 / s)
    return df.select(*keep, pred.alias("pred"), decode_label(pred).alias("Target"))


def running_confusion(scored: DataFrame, y: str = "y") -> DataFrame:
    return scored.groupBy(y, "pred").agg(F.count(F.lit(1)).alias("n"))


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def start_confusion_stream(spark: SparkSession, source_dir: str, schema, name: str,
                           weights=(1 / 3, 1 / 3, 1 / 3), alpha=None, gate=None, sink: str = "memory"):
    """Score parquet files as they arrive and keep the confusion counts."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    scored = score_rows(stream, weights, alpha, gate, keep=("id", "y"))
    return (running_confusion(scored).writeStream.outputMode("complete").format(sink)
            .queryName(name).option("checkpointLocation", checkpoint_location(spark, name))
            .trigger(availableNow=True).start())
