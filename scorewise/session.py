"""Spark session helpers.

The library never assumes a machine-local folder on a cluster: lineage is cut
with Parquet tables written into the shared folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent (local tests) do
we point it at a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "scorewise") -> SparkSession:
    """Session for tests and the bench (local mode, UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SCOREWISE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the local test tables are files of one row group, hence one split
        .config("spark.scorewise.inputPartitions", str(shuffle_partitions))
        # call-site capture for error messages costs several JVM round trips per
        # Column call while plans are built; off for tests and the bench
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; where it is unset, set a scratch one
    in local mode and fail on a cluster."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="scorewise-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/scorewise-{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared checkpoint folder and read
    it back: the plan is computed once (a checkpoint computes it twice), later
    reads are columnar and pruned, and a lost executor costs a re-read."""
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every table ``cut_lineage`` wrote in this application; frames read
    from them can't be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread_input(df: DataFrame) -> DataFrame:
    """Before a row-multiplying step (a candidate grid expanded per row): spread
    the input over the number of partitions that the session states in
    ``spark.scorewise.inputPartitions``.  Unset (the rule on a cluster, where
    a scan has thousands of splits): the input as it is, no shuffle."""
    want = df.sparkSession.conf.get("spark.scorewise.inputPartitions", None)
    return df.repartition(int(want)) if want else df
