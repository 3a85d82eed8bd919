"""Operator 6, SimHash near-dedup by segment popcounts.

A document's fingerprint is the bitwise majority of the XXH64 values of its
word shingles.  Candidate search maps a fingerprint to the number of set bits
in each of its segments.  The Manhattan distance of two such count vectors is a
lower bound of the Hamming distance, so fingerprints that differ in at most
2r bits lie within 2r of each other in the count grid and share a grid point
within r of both.  For the distance of 2, every fingerprint is entered at its
own grid point and the points one step away along each axis (33 points with 16
segments of 4 bits); fingerprints at one point are compared exactly.

The search works on different fingerprints only, so exact and fingerprint-equal
copies cost one entry.  A grid point with many fingerprints is split into pairs
of blocks, and a cell passes on one link per fingerprint instead of all pairs.

A null text counts as empty; a document without words has fingerprint zero and
is linked like any other.  Rows that repeat a doc_id stay separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewise.llm.common import (
    cell_starts,
    cells,
    cut,
    fresh,
    gathered,
    local_roots,
    one_row_per_key,
    same,
    small_pairs,
    text_of,
    whole_cells,
    without_rows,
)
from scorewise.llm.components import components

SHINGLE, DISTANCE, SEGMENT_BITS, SEED = 3, 2, 4, 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, SEED) for g in grams], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 16_384):
        bits = np.unpackbits(h[i:i + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs(doc_id, h, text binary)`` -> ``doc_id, h, fp`` (fp as signed long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fp.view(np.int64))],
                                             ["doc_id", "h", "fp"])
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, h long, fp long")


def grid_points(fp: Column, bits: int = SEGMENT_BITS) -> Column:
    """Packed segment counts of ``fp`` and of its neighbours one step away."""
    radix, segments = bits + 3, -(-64 // bits)      # counts -1 .. bits + 1
    mask = (1 << bits) - 1
    base = sum(((F.bit_count(F.shiftrightunsigned(fp, bits * i).bitwiseAND(F.lit(mask))) + 1).cast("long")
                * F.lit(radix ** i)) for i in range(segments))
    steps = [0] + [s * radix ** i for i in range(segments) for s in (1, -1)]
    return F.transform(F.array(*[F.lit(s).cast("long") for s in steps]), lambda s: base + s)


def _close(distance: int):
    key = ["p", "pa", "pb"]

    def links(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        fp = t.column("fp").to_numpy().view(np.uint64)
        blk = t.column("blk").to_numpy()
        cross = t.column("pa").to_numpy() != t.column("pb").to_numpy()
        out = []
        for left, right in small_pairs(cell_starts(t, key), t.num_rows, 1_000_000):
            ok = np.bitwise_count(fp[left] ^ fp[right]) <= distance
            ok &= ~(cross[left] & (blk[left] == blk[right]))
            out.append((left[ok], right[ok]))
        return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0, int) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches, key):
            left, right = links(t)
            fp = t.column("fp").to_numpy()
            root = local_roots(t.num_rows, left, right)
            pairs = np.unique(np.stack([fp, fp[root]], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["fp", "to"])
    return run


def linked_fingerprints(fps: DataFrame, distance: int = DISTANCE, bits: int = SEGMENT_BITS) -> DataFrame:
    """``fps(fp)``, distinct -> links ``(fp, to)`` that join every two
    fingerprints within ``distance`` (at most 2) directly or over others.  The
    fingerprints are written once, spread over all shuffle partitions: they are
    few bytes, but every one becomes some 33 grid points."""
    if not 0 < distance <= 2:
        raise ValueError("grid points one step away cover a distance of 1 or 2")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = cut(fps.repartition(tasks, "fp")).select("fp", F.explode(grid_points(F.col("fp"), bits)).alias("p"))
    return gathered(cells(points, ["p"], "fp"), ["p"]).mapInArrow(_close(distance), "fp long, to long")


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   distance: int = DISTANCE) -> DataFrame:
    """One row per document: ``doc_id, h, fp, component_id``; ``h`` is the
    XXH64 of the text and ``component_id`` the smallest doc_id reachable."""
    text = text_of(text_col)
    rows = cut(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"),
                                            text.cast("binary").alias("text")), shingle))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comp = components(linked_fingerprints(fps.select("fp"), distance), "fp", "to")
    fps = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = fps.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(fps.join(low, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "h", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                        distance: int = DISTANCE) -> DataFrame:
    """``docs`` with the document of smallest id of each group, all columns.
    Rows that repeat that doc_id with the same text are one document."""
    found = cut(near_documents(docs, id_col, text_col, shingle, distance))
    h, g_id, g_h = fresh(docs, "h", "g_id", "g_h")
    keyed = docs.withColumn(h, F.xxhash64(text_of(text_col)))
    kept = (F.col("doc_id").eqNullSafe(F.col("component_id")))
    # the smallest doc_id may name several texts of one group: the smallest h stays
    best = found.filter(kept).groupBy("fp", "component_id").agg(F.min("h").alias("h0")).groupBy("component_id").agg(
        F.min("h0").alias("h0"))
    found = found.join(best.withColumnRenamed("component_id", "c"), same([F.col("component_id")], [F.col("c")]), "left")
    gone = found.filter(~(kept & (F.col("h") == F.col("h0")))).select(F.col("doc_id").alias(g_id), F.col("h").alias(g_h))
    many = (found.filter(kept).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select(F.col("doc_id").alias(id_col), F.col("h").alias(h)))
    left = without_rows(keyed, cut(gone.distinct()), same([F.col(id_col), F.col(h)], [F.col(g_id), F.col(g_h)]))
    return one_row_per_key(left, [id_col, h], many).drop(h)
