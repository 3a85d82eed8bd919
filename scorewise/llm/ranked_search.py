"""Ranked lexical search: accumulator-limited term-at-a-time over a document-partitioned index.

1. *Postings.*  One pass over the texts keeps, of every document that has a
   term, its number of terms and the query terms it holds with their counts,
   written once to the shared folder.  Counts of documents, terms and holders of
   each query term come from that table by aggregation.
2. *Term at a time.*  A task inverts its documents in shards of bounded size and
   takes each item's terms rarest first.  A term adds its exact integer share to
   the accumulators of its documents and makes new ones, until the largest
   possible sum of all terms still to come (the largest share each of them has
   in the shard) is below the k-th partial score: then no document without an
   accumulator can reach the k best any more, no accumulator is made from there
   on, and the rest of the terms only updates those that exist, exactly.  Scores
   of earlier shards of the task count in that k-th score too.
3. *Merge.*  Every task returns at most k documents an item; two ranked windows
   (item and document bucket, then item) take the k best of all.

Items are taken in blocks of bounded text, so only one block's terms are held by
the driver and sent to the tasks, however many items there are.  Nothing is
shuffled by term: a term that every document holds costs no more than its postings.

Defined results: texts that are null or hold no term count nowhere; rows that
repeat a doc_id are documents of their own; a null doc_id comes last among equal
scores; items equal in id and text count once, items that share only their id
are ranked apart; items without a term that some document holds have no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewise.llm.common import LOWER, UPPER, text_of
from scorewise.session import cut_lineage

TOP = 20
#: Bytes of item text in a block: bounds what the driver holds and every task gets.
BLOCK_BYTES = 4 << 20
#: Documents and postings of a shard.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 22
#: Document buckets of the first ranked window.
BUCKETS = 64

_APART = bytes(b for b in range(128) if not chr(b).isalnum())
_TERMS = bytes.maketrans(UPPER.encode() + _APART, LOWER.encode() + b" " * len(_APART))


def terms_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) terms: maximal runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Block:
    """Items of one pass: the id of each, and its terms with their counts as numbers into ``vocabulary``."""
    ids: list
    terms: list[list[tuple[int, int]]]
    vocabulary: dict[bytes, int]                 # numbers from 1 on


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Block]:
    rows = items.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    for b in range(n):
        held = (rows.filter(F.col("block") == b) if n > 1 else rows).orderBy("id", "text").collect()
        vocabulary: dict[bytes, int] = {}
        terms = [[(vocabulary.setdefault(t, len(vocabulary) + 1), c) for t, c in Counter(terms_of(r["text"].encode())).items()] for r in held]
        yield Block([r["id"] for r in held], terms, vocabulary)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``docs(doc_id, text binary)`` -> ``doc_id, n, terms, counts`` of documents with a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for b in batches:
            lengths, terms, counts, sizes = [], [], [], []
            for x in b.column("text"):
                words = terms_of(x.as_py())
                t, c = np.unique(np.fromiter(filter(None, map(number, words)), np.int32), return_counts=True)
                lengths.append(len(words))
                sizes.append(len(t))
                terms.append(t)
                counts.append(c)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = [np.concatenate(x) if x else np.empty(0) for x in (terms, counts)]
            out = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lengths, pa.int64()),
                 *[pa.ListArray.from_arrays(offsets, pa.array(f.astype(np.int32))) for f in flat]], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(np.array(lengths, np.int64) > 0, pa.bool_()))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


@dataclass(frozen=True)
class Collection:
    """What the tasks need: numbers of documents and terms, the items with their
    terms from the rarest to the commonest, and each term's weight."""
    n_docs: int
    n_terms: int
    ids: list
    terms: list[tuple[np.ndarray, np.ndarray]]   # per item: term numbers, rarest first; counts in the item
    weights: np.ndarray


def collection_of(found: DataFrame, block: Block) -> Collection:
    """``found`` is the table of postings; one row per query term comes to the driver, bounded by the block."""
    n_docs, n_terms = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(block.vocabulary) + 1, np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["t"]] = r["df"]
    terms = []
    for item in block.terms:
        held = sorted(((df[t], t, c) for t, c in item if df[t]))
        terms.append((np.array([t for _, t, _ in held], np.int64), np.array([c for _, _, c in held], np.int64)))
    return Collection(n_docs, n_terms or 0, block.ids, terms, np.array([weight(n_docs, d) if d else 0 for d in df.tolist()], np.int64))


class Shard:
    """Inverted lists of some documents, with every document's share of every term."""

    def __init__(self, c: Collection, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        m = 75 + (25 * lengths * c.n_docs) // c.n_terms
        doc = np.repeat(np.arange(len(lengths)), sizes)
        tf = counts.astype(np.int64)
        share = c.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.argsort(terms, kind="stable")
        self.docs, self.share, terms = doc[order], share[order], terms[order]
        self.from_ = np.searchsorted(terms, np.arange(len(c.weights) + 1))
        self.most = np.zeros(len(c.weights), np.int64)
        np.maximum.at(self.most, terms, self.share)
        self.n = len(lengths)

    def scores(self, terms: np.ndarray, times: np.ndarray, k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents with an accumulator, their scores (exact), and how many terms could
        still make one.  ``best``: scores already reached elsewhere, at most k."""
        score, has = np.zeros(self.n, np.int64), np.zeros(self.n, bool)
        bound = np.cumsum((self.most[terms] * times)[::-1])[::-1]
        making, made = True, 0
        kth = best.min() if len(best) >= k else -1
        for t, c, rest in zip(terms.tolist(), times.tolist(), bound.tolist(), strict=True):
            at, share = self.docs[self.from_[t]:self.from_[t + 1]], self.share[self.from_[t]:self.from_[t + 1]]
            if making:
                if rest >= kth and made:                    # the k-th score may have risen since
                    known = np.concatenate([best, score[has]])
                    if len(known) >= k:
                        kth = np.partition(known, len(known) - k)[len(known) - k]
                making = rest >= kth
                made += making
            if not making:
                live = has[at]
                at, share = at[live], share[live]
            else:
                has[at] = True
            score[at] += share * c
        docs = np.flatnonzero(has)
        return docs, score[docs], made


def top_documents(found: DataFrame, c: Collection, k: int) -> DataFrame:
    """``item, doc_id, score``: at most k an item and task, the best of the task."""
    sent = found.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        none = np.empty((3, 0), np.int64)                   # score, null id, id
        best = [none] * len(c.ids)
        for ids, lengths, sizes, terms, counts in _shards(batches):
            shard = Shard(c, lengths, sizes, terms, counts)
            for i, (item, times) in enumerate(c.terms):
                here = shard.from_[item] < shard.from_[item + 1]
                if not here.any():
                    continue
                docs, score, _ = shard.scores(item[here], times[here], k, best[i][0])
                docs, score = docs[score > 0], score[score > 0]
                if len(docs) > k:                           # all that reach the k-th score
                    docs, score = (x[score >= np.partition(score, len(score) - k)[len(score) - k]] for x in (docs, score))
                both = np.concatenate([best[i], np.stack([score, ids[0][docs], ids[1][docs]])], axis=1)
                best[i] = both[:, np.lexsort((both[2], both[1], -both[0]))[:k]]
        item = np.repeat(np.arange(len(best)), [x.shape[1] for x in best])
        score, null, doc = np.concatenate([none, *best], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=null.astype(bool)), pa.array(score)], ["item", "doc_id", "score"])

    return found.mapInArrow(run, "item long, doc_id long, score long")


def _shards(batches: Iterator[pa.RecordBatch]):
    """Null flags and ids, lengths, number of terms, terms and counts of the documents of one shard after the other."""
    held, n, size = [], 0, 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        size += len(b.column("terms").flatten())
        if n >= SHARD_DOCS or size >= SHARD_POSTINGS:
            yield _shard(held)
            held, n, size = [], 0, 0
    if n:
        yield _shard(held)


def _shard(held: list[pa.RecordBatch]):
    t = pa.Table.from_batches(held)
    number = lambda x: x.to_numpy().astype(np.int64)
    doc = t.column("doc_id")
    ids = np.stack([number(doc.is_null().cast(pa.int8())), number(doc.fill_null(0))])
    flat = [np.concatenate([number(b.column(c).flatten()) for b in held]) for c in ("terms", "counts")]
    sizes = np.concatenate([np.diff(b.column("terms").offsets.to_numpy()) for b in held])
    return ids, number(t.column("n")), sizes, *flat


def best_of(tops: DataFrame, k: int) -> DataFrame:
    """The k best documents of every item, ranked."""
    def ranked(df: DataFrame, *part) -> DataFrame:
        order = Window.partitionBy(*part).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    parts = ranked(tops.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "score"), F.lit(BUCKETS))), "item", "bucket")
    return ranked(parts.drop("rank", "bucket"), "item")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k best documents of every item (ids are integers)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    out = None
    for block in item_blocks(items, item_id_col, item_text_col, block_bytes):
        found = cut_lineage(postings(rows, block.vocabulary))
        c = collection_of(found, block)
        names = spark.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
        part = best_of(top_documents(found, c, k), k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out
