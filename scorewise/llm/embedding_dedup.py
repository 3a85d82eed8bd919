"""Operator 1, embedding near-dedup: Euclidean p-stable hashing.

Vectors are normalised; each of ``tables`` hash tables quantises ``hashes``
random projections with bucket width ``width``.  Vectors that share a bucket
are compared by exact cosine in double precision.

* The number of projections follows the number of different vectors (so that
  ``fill`` unrelated vectors are expected in a bucket), and the number of
  tables follows from the wished chance to miss a pair exactly at the threshold
  (``miss``); pairs above it are missed far less often.
* Identical vectors are one representative with a multiplicity; they are not
  compared with each other.
* A bucket with many vectors is split into pairs of blocks (see ``cells``).
  No pair leaves its task: a cell gives each vector its number of new links and
  one link to the smallest vector it is connected with there.  A pair that
  meets in several tables counts in the first of them.

Rows whose vector is null, empty, zero or has null or non-finite components,
and vectors of different length, link with nothing.  Rows that share a
``vec_id`` stay separate rows, linked like rows of different ids.  A row whose
``vec_id`` is null links and is counted; its component is named by the smallest
id that is not null, and is null (and the row kept) where there is none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.llm.common import cell_starts, cells, cut, gathered, local_roots, small_pairs, whole_cells
from scorewise.llm.components import components


def collision(dist: float, width: float) -> float:
    """Chance that one quantised projection agrees for two points at ``dist``."""
    t = width / dist
    cdf = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * cdf - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def lsh_shape(n: int, cosine: float, width: float = 2.0, fill: float = 0.25, miss: float = 0.005) -> tuple[int, int]:
    """(projections per table, tables) for ``n`` different vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    hashes = max(1, math.ceil(math.log(max(n, 2) / fill) / -math.log(far)))
    return hashes, math.ceil(math.log(miss) / math.log1p(-near ** hashes))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def signatures(x: np.ndarray, hashes: int, tables: int, width: float, seed: int) -> np.ndarray:
    """One 32-bit bucket number per row and table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    proj = rng.standard_normal((x.shape[1], tables * hashes))
    shift = rng.uniform(0, width, tables * hashes)
    mix = rng.integers(1, 2**63, size=hashes, dtype=np.uint64) | np.uint64(1)
    out = np.empty((len(x), tables), np.int32)
    for i in range(0, len(x), 1000):
        q = np.floor((x[i:i + 1000] @ proj + shift) / width).astype(np.int64).view(np.uint64)
        h = (q.reshape(-1, tables, hashes) * mix).sum(axis=2, dtype=np.uint64)
        h ^= h >> np.uint64(29)
        out[i:i + 1000] = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _matrix(col) -> tuple[np.ndarray, np.ndarray]:
    """(rows padded with zeros to the longest, row lengths) of a list column without nulls."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    offs = arr.offsets.to_numpy()
    n = np.diff(offs)
    flat = arr.values.to_numpy(zero_copy_only=False).astype(np.float64)[offs[0]:offs[-1]]
    if len(n) and (n == n[0]).all():
        return flat.reshape(len(n), n[0]), n
    x = np.zeros((len(n), n.max() if len(n) else 0))
    x[np.arange(x.shape[1]) < n[:, None]] = flat
    return x, n


def _sign(hashes: int, tables: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = _matrix(b.column("vec"))
            sig = np.zeros((len(n), tables), np.int32)
            for d in np.unique(n):
                sig[n == d] = signatures(unit(x[n == d][:, :d]), hashes, tables, width, seed + int(d))
            sigs = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * tables, sig.ravel())
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("vec"), b.column("m"), sigs],
                                             ["rep", "vec", "m", "sig"])
    return run


def _compare(cosine: float):
    key = ["t", "h", "pa", "pb"]

    def links(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x, dim = _matrix(t.column("vec"))
        x = unit(x)
        sig = _matrix(t.column("sig"))[0]
        tab, blk = t.column("t").to_numpy(), t.column("blk").to_numpy()
        cross = t.column("pa").to_numpy() != t.column("pb").to_numpy()
        starts = cell_starts(t, key)
        ends = np.append(starts[1:], t.num_rows)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def keep(left, right):
            ok = (dim[left] == dim[right]) & ~(cross[left] & (blk[left] == blk[right]))
            left, right = left[ok], right[ok]
            new = (sig[left] == sig[right]).argmax(axis=1) == tab[left]
            found.append((left[new], right[new]))

        big = ends - starts > 64
        for s, e in zip(starts[big], ends[big], strict=True):
            for i in range(s, e, 512):
                left, right = np.nonzero(x[i:min(i + 512, e)] @ x[s:e].T >= cosine)
                left, right = left + i, right + s
                for j in range(0, len(left), 100_000):
                    a, b = left[j:j + 100_000], right[j:j + 100_000]
                    up = a < b
                    keep(a[up], b[up])
        rest = np.repeat(~big, ends - starts)
        idx = np.flatnonzero(rest)
        if len(idx):
            size = (ends - starts)[~big]
            for left, right in small_pairs(np.cumsum(size) - size, len(idx)):
                left, right = idx[left], idx[right]
                ok = np.einsum("ij,ij->i", x[left], x[right]) >= cosine
                keep(left[ok], right[ok])
        if not found:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches, key):
            left, right = links(t)
            if not len(left):
                continue
            n = t.num_rows
            rep, m = t.column("rep").to_numpy(), t.column("m").to_numpy()
            got = np.bincount(left, m[right], n) + np.bincount(right, m[left], n)
            root, at = local_roots(n, left, right), np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[at]), pa.array(got[at].astype(np.int64)), pa.array(rep[root[at]])],
                ["rep", "n", "to"])
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95,
                 width: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = (F.col("vec").isNotNull()
            & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists("vec", lambda v: v != 0))
    rows = rows.withColumn("rep", F.when(good, F.xxhash64("vec")))
    reps = cut(rows.filter("rep is not null").groupBy("rep")
               .agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("m")))
    hashes, tables = lsh_shape(reps.count(), cosine, width)
    signed = cut(reps.mapInArrow(_sign(hashes, tables, width, seed),
                                 "rep long, vec array<double>, m long, sig array<int>"))
    buckets = signed.select("rep", F.posexplode("sig").alias("t", "h"))
    met = gathered(cells(buckets, ["t", "h"], "rep").join(signed, "rep"), ["t", "h"])
    hits = cut(met.mapInArrow(_compare(cosine), "rep long, n long, to long"))
    n_links = hits.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(hits, "rep", "to")
    per_rep = (reps.select("rep", "m").join(n_links, "rep", "left")
               .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
               .select("rep", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                       F.coalesce("root", "rep").alias("root")))
    # smallest vec_id of each component, by way of the smallest of each representative
    narrow = cut(rows.select("vec_id", "rep"))
    least = narrow.filter("rep is not null").groupBy("rep").agg(F.min("vec_id").alias("low")).join(per_rep, "rep")
    low = least.groupBy("root").agg(F.min("low").alias("component_id"))
    per_rep = least.select("rep", "n_links", "root").join(low, "root").drop("root")
    out = narrow.join(per_rep, "rep", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
