"""Operator 8, exact dedup by progressive refinement (DataFrame functions only).

1. rows are grouped by the byte length of the text;
2. rows whose length occurs twice are grouped by length and the hash of a prefix;
3. rows whose (length, prefix hash) occurs twice are grouped by the full
   SHA-256, and only those groups can hold equal texts.

One scan reads the texts and writes a narrow table of id, length, prefix hash
and SHA-256 (a streaming expression; every text is hashed once).  All steps work
on that table.  The digests of rows that steps 1 and 2 leave are the only ones
that are grouped, and rows they rule out are their own group at once.

Every aggregation has map-side combine, so a text that a third of all rows
share is one partial row per task.  A null text counts as empty.  The largest
doc_id of a group stays (a null one only if there is no other); rows that
repeat that doc_id with the same text count as one document given twice: all
carry ``kept`` in the report, and ``drop_copies`` leaves one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.llm.common import cut, fresh, one_row_per_key, same, text_of, without_rows

PREFIX = 256
#: (length, prefix hash) keys that may be sent to every task; beyond, the same semi join is a shuffle join.
MAX_SURVIVORS = 500_000


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """``doc_id, len, pre, sha`` of every row, written: the only read of the texts."""
    text = text_of(text_col)
    return cut(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).alias("len"),
                           F.xxhash64(F.substring(text, 1, prefix)).alias("pre"), F.unhex(F.sha2(text, 256)).alias("sha")))


def survivors(rows: DataFrame) -> DataFrame:
    """``(len, pre)`` of the keyed rows that may have an equal: steps 1 and 2."""
    narrow = cut(rows.groupBy("len", "pre").agg(F.count(F.lit(1)).alias("n")))     # one row per different (length, prefix)
    lengths = narrow.groupBy("len").agg(F.sum("n").alias("same_len")).filter("same_len > 1").select("len")
    return narrow.join(lengths, "len").filter("n > 1").select("len", "pre")


def copy_groups(rows: DataFrame, max_survivors: int = MAX_SURVIVORS) -> DataFrame:
    """Step 3 over keyed rows, one row per text that occurs twice or more:
    ``sha (binary), keep_id, group_size, n_keep`` (rows that carry keep_id)."""
    left = cut(survivors(rows))
    rows = rows.join(F.broadcast(left) if left.count() <= max_survivors else left, ["len", "pre"], "left_semi")
    per_id = rows.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct("doc_id", "n"))
    return cut(per_id.groupBy("sha").agg(top.alias("top"), F.sum("n").alias("group_size")).filter("group_size > 1")
               .select("sha", F.col("top.doc_id").alias("keep_id"), "group_size", F.col("top.n").alias("n_keep")))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX,
                 max_survivors: int = MAX_SURVIVORS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = keyed(docs, id_col, text_col, prefix)
    groups = copy_groups(rows, max_survivors)                 # a plain join side: Spark can split a hot text
    alone = F.col("group_size").isNull()
    out = rows.join(groups, "sha", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per different text (the largest doc_id), all columns.
    The list of dropped ids is made from narrow rows; texts are only filtered by it."""
    sha, g_id, g_sha = fresh(docs, "sha", "g_id", "g_sha")
    rows = keyed(docs, id_col, text_col)
    groups = copy_groups(rows)
    gone = rows.join(groups, "sha").filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    gone = cut(gone.select(F.col("doc_id").alias(g_id), F.col("sha").alias(g_sha)).distinct())
    texts = docs.withColumn(sha, F.unhex(F.sha2(text_of(text_col), 256)))
    left = without_rows(texts, gone, same([F.col(id_col), F.col(sha)], [F.col(g_id), F.col(g_sha)]))
    repeated = groups.filter("n_keep > 1").select(F.col("keep_id").alias(id_col), F.col("sha").alias(sha))
    return one_row_per_key(left, [id_col, sha], repeated).select(*docs.columns)
