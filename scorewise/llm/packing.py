"""Operator 9, packing by optimal length buckets.

Documents longer than ``max_len`` words become pieces of ``max_len`` words (the
last one shorter), so every word is packed and a histogram of piece lengths has
``max_len`` cells at most, at any corpus size.  Dynamic programming over that
global histogram chooses the ``buckets`` boundaries with the least padding (the
cost of a bucket is its pieces times its boundary, less their words).  Inside a
bucket, pieces stand in the order of an md5 of their document, or in the order
of the input rows (``in_order``), and every ``budget // boundary`` of them form
a batch, which then holds at most ``budget`` words with padding.

The order of the input rows is that of its Parquet files (by task number, then
path) and of the rows in them, which is the order in which a sorted table was
written; ``position`` counts it from 0 over the whole table, so batches of
different buckets can be put into one training order too.  An input that is no
file scan has the order of its partitions, and positions with gaps.

Ranks inside a bucket are in two steps (inside (bucket, md5 prefix) or (bucket,
run of positions), then offsets of those), so no task gets a whole bucket.  A null text counts
as empty.  A document without words has one row with length 0 and null bucket,
boundary, batch and slot: there is nothing to pack.  Rows that repeat a doc_id
are packed each.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewise.llm.common import cut, text_of, word_count

MAX_LEN, BUCKETS, BUDGET, SEED, DIGITS = 8192, 16, 65_536, 42, 3
RUN = 16_384                                   # positions ranked in one group


def best_boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Boundaries (each a length that occurs, ascending, the largest last) that
    minimise padding with at most ``buckets`` buckets.

    ``best[j]`` is the least padded size of the first j lengths; one more bucket
    ending at j costs ``pieces(i..j) * length[j]``.  That cost grows with the
    boundary no slower for more pieces, so the best split point never moves
    left as j grows and each round is solved by halving (rows x log rows).
    """
    n = len(lengths)
    if not n:
        return []
    x = np.asarray(lengths, np.float64)
    cum = np.concatenate([[0.0], np.cumsum(np.asarray(counts, np.float64))])
    best = np.concatenate([[0.0], cum[1:] * x])          # one bucket
    splits = []
    for _ in range(min(buckets, n) - 1):
        new, frm = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        new[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + (cum[j] - cum[i]) * x[j - 1]
            k = int(cost.argmin())
            new[j], frm[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, i[k]), (j + 1, hi, i[k], b)]
        splits.append(frm)
        best = new
    out, j = [], n
    for frm in reversed(splits):
        out.append(lengths[j - 1])
        j = frm[j]
        if not j:
            break
    if j:
        out.append(lengths[j - 1])
    return out[::-1]


def row_order(docs: DataFrame) -> tuple:
    """Columns ``file, at`` that give the order of the rows of ``docs``."""
    path, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    file = F.concat(F.lpad(F.regexp_extract(name, r"^part-([0-9]+)", 1), 10, "0"), path)   # part-100000 comes after part-99999
    try:
        docs.select(file, "_metadata.row_index").schema
    except AnalysisException:
        return F.lit(""), F.monotonically_increasing_id()
    return file, F.col("_metadata.row_index")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, in_order: bool = False) -> DataFrame:
    """``doc_id, n_words, piece, length``: one row per piece; ``in_order`` adds ``file, at``."""
    file, at = row_order(docs) if in_order else (None, None)
    d = docs.select(F.col(id_col).alias("doc_id"), word_count(text_of(text_col)).alias("n_words"),
                    *([file.alias("file"), at.alias("at")] if in_order else []))
    last = F.greatest(F.ceil(F.col("n_words") / max_len) - 1, F.lit(0)).cast("int")
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    return d.withColumn("length", F.least(F.lit(max_len), F.col("n_words") - F.col("piece") * max_len).cast("int"))


def with_positions(p: DataFrame) -> DataFrame:
    """``file, at`` -> ``position``, by the offsets of the files (one row per file)."""
    files = p.groupBy("file").agg((F.max("at") + 1).alias("rows"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before"))
    return p.join(F.broadcast(files), "file").withColumn("position", F.col("before") + F.col("at")).drop("file", "at", "before")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS,
           budget: int = BUDGET, seed: int = SEED, in_order: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, n_words, length, bucket, boundary,
    batch, slot``; batch counts from 0 inside its bucket, slot inside its batch.
    ``in_order`` keeps the order of the rows of ``docs`` and adds ``position``."""
    if max_len > budget:
        raise ValueError("a piece must fit a batch")
    p = cut(pieces(docs, id_col, text_col, max_len, in_order))
    p = with_positions(p) if in_order else p
    hist = p.filter("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    bounds = best_boundaries([r["length"] for r in hist], [r["n"] for r in hist], buckets)
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<int>")
    p = p.withColumn("bucket", F.when(F.col("length") > 0, F.size(F.filter(edges, lambda b: b < F.col("length")))))
    p = p.withColumn("boundary", F.when(F.col("length") > 0, F.get(edges, F.col("bucket"))) if bounds else F.lit(None).cast("int"))
    p = p.withColumn("place", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"),
                                             F.col("piece").cast("string"), F.lit(f"-{seed}"))))
    p = p.withColumn("part", F.floor(F.col("position") / RUN) if in_order else F.substring("place", 1, DIGITS))
    some, empty = p.filter("length > 0"), p.filter("length = 0")
    parts = some.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("bucket", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    if not in_order:
        parts = F.broadcast(parts)                       # at most buckets x 16^DIGITS rows
    within = Window.partitionBy("bucket", "part").orderBy(*(["position", "piece"] if in_order else []), "place", "doc_id", "piece")
    some = some.withColumn("rank", F.row_number().over(within)).join(parts, ["bucket", "part"])
    p = some.unionByName(empty, allowMissingColumns=True)
    rank, size = F.col("ahead") + F.col("rank") - 1, F.floor(F.lit(budget) / F.col("boundary"))
    return p.select("doc_id", "piece", "n_words", "length", "bucket", "boundary",
                    F.floor(rank / size).cast("long").alias("batch"), (rank % size).cast("int").alias("slot"),
                    *(["position"] if in_order else []))
