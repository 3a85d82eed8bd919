"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters that separate words (space, tab, line feed, vertical tab, form feed, return).
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of ``spark.checkpoint.dir``: the
    plan above it is not run again, also not when an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of scratch tables that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of ids that may be sent to every task to filter a table; beyond, the filter is a shuffle join.
MAX_DROPPED = 500_000


def without_rows(docs: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """``docs`` less the rows that match the narrow table ``gone`` (written
    already).  Up to ``MAX_DROPPED`` rows, counted first, are broadcast, so that
    no text is shuffled."""
    n = gone.count()
    if not n:
        return docs
    return docs.join(F.broadcast(gone) if n <= MAX_DROPPED else gone, on, "left_anti")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters (native, no arrays)."""
    one = F.trim(F.regexp_replace(text, SPACES, " "))
    return (F.octet_length(one) - F.octet_length(F.replace(one, F.lit(" "), F.lit("")))
            + F.when(one == "", 0).otherwise(1)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names not used by ``df`` (whose columns may clash with ours)."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def same(a: list[Column], b: list[Column]) -> Column:
    """Null-safe equality of two keys."""
    cond = a[0].eqNullSafe(b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        cond = cond & x.eqNullSafe(y)
    return cond


def one_row_per_key(docs: DataFrame, key: list[str], repeated: DataFrame) -> DataFrame:
    """``docs`` with rows that repeat a key reduced to one; ``repeated`` lists
    (under the same names) the keys that several rows have.  Only those rows
    are shuffled, and nothing is when there are none."""
    if repeated.isEmpty():
        return docs
    r = repeated.select(*[F.col(c).alias(f"{c}__r") for c in key])
    cond = same([F.col(c) for c in key], [F.col(f"{c}__r") for c in key])
    return (docs.join(r, cond, "left_anti")
            .unionByName(docs.join(r, cond, "left_semi").dropDuplicates(key)))


# ---------------------------------------------------------------------------
# comparison inside cells (groups of rows that share a key), hot cells split
# ---------------------------------------------------------------------------
def cells(rows: DataFrame, key: list[str], by: str, block: int = 1024) -> DataFrame:
    """Rows of every key that has two rows or more, dealt to comparison cells.

    A key with more than ``block`` rows is split into blocks by a hash of the
    column ``by``; a cell then holds one pair of blocks (``pa`` <= ``pb``), so
    that no task gets a whole hot key.  Adds ``pa``, ``pb`` and the row's own
    block ``blk``.  Every pair of rows of a key meets in exactly one cell.
    """
    sizes = (rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
             .withColumn("_nb", F.ceil(F.col("_n") / block).cast("int")).drop("_n"))
    dealt = (rows.join(sizes, key)
             .withColumn("blk", F.pmod(F.xxhash64(by), F.col("_nb")).cast("int"))
             .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
             .withColumn("pa", F.least("blk", "_j")).withColumn("pb", F.greatest("blk", "_j"))
             .drop("_j", "_nb"))
    return dealt


def gathered(dealt: DataFrame, key: list[str]) -> DataFrame:
    """The rows of each cell in one partition, one after the other."""
    return dealt.repartition(*key, "pa", "pb").sortWithinPartitions(*key, "pa", "pb")


def whole_cells(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Regroup sorted batches into tables that hold whole cells, about ``rows`` rows each."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.concat_tables(held).combine_chunks()
        cut_at = cell_starts(t, key)[-1]
        if cut_at:
            yield t.slice(0, cut_at)
        held, n = [t.slice(cut_at)], t.num_rows - cut_at
    if n:
        yield pa.concat_tables(held).combine_chunks()


def cell_starts(t: pa.Table, key: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in key:
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def small_pairs(starts: np.ndarray, n: int, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (left < right) inside each cell, in chunks of about ``most`` pairs."""
    ends = np.append(starts[1:], n)
    last = np.repeat(ends, ends - starts)
    counts = last - np.arange(n) - 1
    total = np.cumsum(counts)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        c = counts[at:to]
        if c.sum():
            left = np.repeat(np.arange(at, to), c)
            first = np.repeat(np.cumsum(c) - c, c)
            yield left, left + 1 + np.arange(len(left)) - first
        at = to


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` rows over the given links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
