"""Parquet table access.

Tables are read lazily; Catalyst prunes columns and pushes filters into the
parquet scan, so callers simply select what they need.  The schema of each
path is inferred once per process and then passed to the reader, as a catalog
table would keep it (inference otherwise runs a footer-reading job per read).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


_SCHEMAS: dict[str, StructType] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = table_path(sf_dir, name)
    known = _SCHEMAS.get(path)
    if known is not None:
        return spark.read.schema(known).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[path] = df.schema
    return df
