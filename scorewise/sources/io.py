"""Sources and sinks: labelled/unlabelled tables, the frozen fold table,
prediction files, the long score table and the evidence document.

Paths are whatever the cluster names (object store or HDFS); nothing here
assumes a machine-local folder.  Existence checks use the Hadoop FileSystem of
the path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorewise.operators.folds import assign_folds


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with header.  Without a schema every column is text, which the cleaning
    parses by the same rules for every file: types never depend on the rows, and
    no extra pass over the data infers them."""
    reader = spark.read.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_template(spark: SparkSession, path: str, id_col: str = "ID") -> DataFrame | None:
    """Optional id template; None when absent (then predictions are written as is)."""
    if not path_exists(spark, path):
        return None
    return read_csv(spark, path).select(F.col(id_col).alias("id"))


def get_or_create_folds(spark: SparkSession, df: DataFrame, path: str, **kw) -> DataFrame:
    """Frozen split: read ``(id, y, fold)`` if stored, else compute once and
    write it (``errorifexists``: a concurrent writer fails instead of
    overwriting a split others already use).  A folder without ``_SUCCESS`` is
    a failed write and is refused, and so is a split whose ids are not those of
    ``df``: both sides are counted and no row is dropped."""
    if path_exists(spark, path) and not path_exists(spark, f"{path}/_SUCCESS"):
        raise ValueError(f"{path} holds an unfinished fold table; remove it first")
    if not path_exists(spark, path):
        assign_folds(df.select("id", "y"), **kw).write.mode("errorifexists").parquet(path)
    folds = spark.read.parquet(path)
    seen = (df.select("id", F.lit(1).alias("_d")).join(folds.select(F.col("id").alias("_id"), F.lit(1).alias("_f")),
                                                       F.col("id").eqNullSafe(F.col("_id")), "full")
            .agg(F.sum(F.col("_f").isNull().cast("long")), F.sum(F.col("_d").isNull().cast("long"))).first())
    if any(seen):
        raise ValueError(f"stored folds do not fit: {seen[0] or 0} ids without a fold, {seen[1] or 0} folds without an id")
    return folds


def write_predictions(labels: DataFrame, path: str, template: DataFrame | None = None, models=()) -> None:
    """One CSV folder per score source (``model=...``), header ``id,Target``.
    With a ``template`` of ids, every source named in ``models`` gets exactly the
    template's ids: those without a prediction keep an empty label, predictions
    outside it are left out.  Ids are compared as text, as the template is."""
    if template is not None:
        wanted = template.select(F.col("id").cast("string").alias("id"), F.explode(F.array(*map(F.lit, models))).alias("model"))
        labels = wanted.join(labels.withColumn("id", F.col("id").cast("string")), ["id", "model"], "left")
    labels.select("id", "Target", "model").write.mode("overwrite").partitionBy("model").option("header", "true").csv(path)


def write_scores(long_scores: DataFrame, path: str) -> None:
    """Long score table partitioned by source: a filter on ``model`` prunes."""
    long_scores.write.mode("overwrite").partitionBy("model").parquet(path)


def write_evidence(evidence: DataFrame, path: str) -> None:
    evidence.coalesce(1).write.mode("overwrite").text(path)
