"""Operator 3, language-model scores: a log-bilinear model trained with
noise-contrastive estimation.

Everything the model knows comes from all learning documents (crc32 of the id
mod ``FOLDS`` is not ``HELD``):

1. Token counts over the whole corpus (tasks pre-aggregate; nothing is
   collected).  The commonest tokens, at most ``DICTIONARY`` by a cut on a
   histogram of counts, and the model's own words form a dictionary that every
   task gets.  It only saves joins: words outside it take their counts from the
   count table, and no score depends on where the cut lies.
2. Outputs of the neural model: the end, the ``WORDS`` commonest words, and
   ``CLASSES`` classes of all other words by their last letters.  The vector
   predicted from the three outputs before, ``sum_j R_j[context_j]``, is
   multiplied with the output vectors: ``score = r . Q_w + b_w``.  The learning
   texts, as output numbers, are cut into pieces of ``PIECE`` tokens and dealt by
   a hash of the piece to units of about ``UNIT`` tokens, so units hold the same
   pieces in the same order however the table is partitioned.  Units train in
   rounds: those of a round start from the same weights and run side by side in
   minibatches (noise words shared by a minibatch); then weights and step sizes
   are averaged and the next round goes on from there.  With U units there are
   sqrt(U) rounds (at least ``ROUNDS``, at most U) of U / rounds units, so both
   the steps in a row and the width grow with the corpus, and every piece is
   used once.  Equal pieces are one piece whose gradient counts as often as it
   occurs: a text that many rows share makes no unit larger.
3. A word that occurs in the learning documents has the chance
   ``(1 - u) * count / class count`` inside its class; u, the class's share of
   words seen once (Good-Turing), is the chance of the one symbol that stands
   for all words never seen.  So the events are the known words and an unknown
   word of each class, as the base score has one unknown word.
4. Scoring normalises over all outputs, so that their chances add up to one.
   ``exp(sum_j R_j[context_j] . Q_w + b_w)`` is a product of one factor for each
   distance: a task makes the factors of every context and output once, and a
   token costs products only.  Words outside the dictionary join the count table
   by word; each is rarer than any dictionary word, so no key is hot.

Tasks split and look up words by Arrow, a bounded number of bytes of text at a time.
Whole texts are read.  A null text counts as empty: its only token is the end.
A null doc_id is held out.  Rows that repeat a doc_id are scored each.
Without learning documents, all counts are 0 and the model is untrained.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.llm.common import cut, remove_folder, text_of
from scorewise.session import scratch_folder

FOLDS, HELD = 7, 2
DICTIONARY, WORDS, CLASSES, ORDER, DIM = 200_000, 191, 64, 3, 16
NOISE, BATCH, RATE, SEED = 32, 1024, 0.15, 3
PIECE, UNIT, ROUNDS, ADDERS = 2048, 1 << 18, 8, 32
COUNTED, READ = 8_000_000, 2_000_000       # bytes of text that a task counts, reads at a time
END, MARKS = b"", ".,;:!?\"')*#$%&|"


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))


def word_class(word: bytes) -> int:
    return zlib.crc32(word.rstrip(MARKS.encode())[-2:] or word[-1:]) % CLASSES


@cache
def _endings() -> tuple[np.ndarray, np.ndarray]:
    """Classes of all last bytes and of all pairs of last bytes."""
    one = [zlib.crc32(bytes([a])) % CLASSES for a in range(256)]
    two = [zlib.crc32(bytes([a, b])) % CLASSES for a in range(256) for b in range(256)]
    return np.array(one), np.array(two)


def _ends(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary array, the end and the length of each value."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at[1:], np.diff(at)


def word_classes(words: pa.Array) -> np.ndarray:
    """``word_class`` of each word of a binary array."""
    out = np.full(len(words), word_class(END))
    if not len(words):
        return out
    one, two = _endings()
    data, end, size = _ends(words)
    out[size > 0] = one[data[end[size > 0] - 1]]
    data, end, size = _ends(pc.ascii_rtrim(words.view(pa.string()), characters=MARKS))
    out[size == 1] = one[data[end[size == 1] - 1]]
    end = end[size > 1]
    out[size > 1] = two[data[end - 2].astype(np.int64) * 256 + data[end - 1]]
    return out


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts (binary), each text's followed by its end, and how many tokens each text has."""
    low = pc.ascii_lower(texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()))
    low = low.view(pa.large_binary()).cast(pa.binary()).view(pa.string()) if pa.types.is_large_string(low.type) else low
    parts = pc.ascii_split_whitespace(pc.binary_join_element_wise(low, " ", ""))       # the space leaves an empty word behind: the end
    words, at = parts.flatten().view(pa.binary()), parts.offsets.to_numpy()
    keep = pc.binary_length(words).to_numpy() > 0
    keep[at[1:] - 1] = True
    if keep.all():
        return words, np.diff(at).astype(np.int64)
    return words.filter(pa.array(keep)), np.add.reduceat(keep, at[:-1], dtype=np.int64)


def portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end with the row that reaches ``size`` bytes of text."""
    held, n = [], 0
    for b in batches:
        total, at = np.cumsum(pc.binary_length(b.column("text")).to_numpy().astype(np.int64) + 100), 0
        while at < b.num_rows:
            before = total[at - 1] if at else 0
            to = min(int(np.searchsorted(total, before + size - n)) + 1, b.num_rows)
            held.append(b.slice(at, to - at))
            n += int(total[to - 1] - before)
            at = to
            if n >= size:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


# ---------------------------------------------------------------------------
# corpus counts
# ---------------------------------------------------------------------------
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches, COUNTED):
        found = tokens_of(b.column("text"))[0].value_counts()
        words, c = found.field("values"), found.field("counts")
        yield pa.RecordBatch.from_arrays([words, pa.array(word_classes(words), pa.int32()), c.cast(pa.int64())], ["token", "cls", "c"])


def token_counts(texts: DataFrame) -> DataFrame:
    """``texts(text binary)`` -> ``token, cls, c``, one row per different token."""
    return texts.mapInArrow(_count, "token binary, cls int, c long").groupBy("token").agg(
        F.first("cls").alias("cls"), F.sum("c").alias("c"))


@dataclass
class Corpus:
    """What scoring needs of the corpus; bounded by the parameters."""

    counts: DataFrame
    total: int
    vocab: int
    known: dict                 # dictionary: token -> number
    freq: np.ndarray            # its count
    out: np.ndarray             # its output
    inside: np.ndarray          # log of its chance inside its output (0 for words of the model)
    class_total: np.ndarray     # tokens of each class outside the model's words
    unseen: np.ndarray          # u of each class
    noise: np.ndarray           # log share of each output


def gather_corpus(learn: DataFrame, dictionary: int = DICTIONARY, words: int = WORDS) -> Corpus:
    """``learn(text binary)``: the learning documents."""
    counts = cut(token_counts(learn))
    bin_ = F.floor(F.log2("c") * 16).cast("int")
    hist = counts.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()   # some hundred rows
    total, vocab = sum(r["n"] for r in hist), sum(r["v"] for r in hist)
    floor_bin, held = None, 0
    for r in sorted(hist, key=lambda r: -r["bin"]):
        held += r["v"]
        if held > dictionary:
            break
        floor_bin = r["bin"]
    top = counts.filter((bin_ >= floor_bin) | (F.col("token") == END) if floor_bin is not None else F.col("token") == END)
    # the model's own words are the commonest ones, also where the cut on the histogram leaves them out of the dictionary
    best = counts.filter(F.col("token") != END).orderBy(F.desc("c"), "token").select("token", "c").limit(words).collect()
    held = {bytes(r["token"]): r["c"] for r in [*best, *top.select("token", "c").collect()]}            # at most ``dictionary`` + ``words`` rows and the end
    tokens = sorted(held, key=lambda t: (-held[t], t))
    freq = np.array([held[t] for t in tokens], np.int64)
    model = [bytes(r["token"]) for r in best]
    number = {END: 0} | {t: i + 1 for i, t in enumerate(model)}
    by_class = counts.groupBy("cls").agg(F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()
    class_total, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        class_total[r["cls"]], once[r["cls"]] = r["n"], r["once"]
    for t, c in zip(tokens, freq, strict=True):
        if t in number:
            class_total[word_class(t)] -= c
            once[word_class(t)] -= c == 1
    unseen = (once + 1) / (class_total + 2)
    kinds = 1 + len(model) + CLASSES
    out = np.array([number.get(t, 1 + len(model) + word_class(t)) for t in tokens], np.int64)
    share = np.full(kinds, 1.0)
    share[1 + len(model):] += class_total
    in_model = out <= len(model)
    share[out[in_model]] += freq[in_model]
    c = Corpus(counts, total, vocab, {t: i for i, t in enumerate(tokens)}, freq, out, np.zeros(len(tokens)), class_total, unseen,
               np.log(share / share.sum()))
    rest = np.flatnonzero(~in_model)
    if len(rest):
        k = out[rest] - 1 - len(model)
        c.inside[rest] = np.log((1 - unseen[k]) * freq[rest] / np.maximum(class_total[k], 1))
    return c


# ---------------------------------------------------------------------------
# the neural model
# ---------------------------------------------------------------------------
class Model:
    """``ctx[j, v]``: vector of output v at distance j + 1 (the last row: before
    the text); ``vec``, ``bias``: of each output."""

    def __init__(self, noise: np.ndarray, dim: int = DIM, seed: int = SEED):
        rng = np.random.default_rng(seed)
        v = len(noise)
        self.ctx = rng.normal(0, 0.1, (ORDER, v + 1, dim)).astype(np.float32)
        self.vec = rng.normal(0, 0.1, (v, dim)).astype(np.float32)
        self.bias = noise.astype(np.float32)
        self.noise = noise.astype(np.float32)

    def weights(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.ctx, self.vec, self.bias)]).astype(np.float64)

    def with_weights(self, w: np.ndarray) -> Model:
        for p in (self.ctx, self.vec, self.bias):
            p[...] = w[:p.size].reshape(p.shape)
            w = w[p.size:]
        return self

    def predicted(self, before: np.ndarray) -> np.ndarray:
        r = self.ctx[0].take(before[0], 0)
        for j in range(1, ORDER):
            r += self.ctx[j].take(before[j], 0)
        return r

    def log_chances(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the normalised chance of each target."""
        return Chances(self).logs(before, target)


class Chances:
    """Chances of all outputs as products: ``score[j][v, w]`` is what output v at
    distance j + 1 adds to the score of w (the bias is in the first),
    ``factor[j]`` its exponential, at most 1 by the shift ``top[j][v]``."""

    def __init__(self, model: Model):
        vec = model.vec.astype(np.float64).T
        self.score = [c.astype(np.float64) @ vec for c in model.ctx]
        self.score[0] += model.bias
        self.top = [s.max(axis=1) for s in self.score]
        self.factor = [np.exp(s - t[:, None]).astype(np.float32) for s, t in zip(self.score, self.top, strict=True)]

    def logs(self, before: np.ndarray, target: np.ndarray, block: int = 1024) -> np.ndarray:
        """Natural log of the normalised chance of each target."""
        v = self.factor[0].shape[1]
        ones, total = np.ones(v, np.float32), np.empty(len(target))
        row, by = np.empty((2, min(block, len(target)), v), np.float32)
        for i in range(0, len(target), block):
            here = before[:, i:i + block]
            p, q = row[:here.shape[1]], by[:here.shape[1]]
            self.factor[0].take(here[0], 0, p, "clip")
            for j in range(1, ORDER):
                p *= self.factor[j].take(here[j], 0, q, "clip")
            total[i:i + block] = p @ ones
        weak = np.flatnonzero(~(total > 1e-20))          # products near the smallest numbers: shift the sums instead
        with np.errstate(divide="ignore"):
            out = -np.log(total)
        for i in range(0, len(weak), block):
            w = weak[i:i + block]
            s = sum(self.score[j][before[j, w]] - self.top[j][before[j, w], None] for j in range(ORDER))
            high = s.max(axis=1)
            out[w] = -high - np.log(np.exp(s - high[:, None]).sum(axis=1))
        for j in range(ORDER):
            out += self.score[j][before[j], target] - self.top[j][before[j]]
        return out


class Trainer:
    """Noise-contrastive estimation with Adagrad."""

    def __init__(self, model: Model, noise_words: int = NOISE, rate: float = RATE, seed: int = SEED):
        self.m, self.k, self.rate, self.rng = model, noise_words, rate, np.random.default_rng(seed)
        self.cum = np.cumsum(np.exp(model.noise.astype(np.float64)))
        self.seen = [np.full(p.shape, 1e-3, np.float32) for p in (model.ctx, model.vec, model.bias)]

    def state(self) -> np.ndarray:
        """Weights, then the sums of squared gradients that set the step sizes."""
        return np.concatenate([self.m.weights(), *[x.ravel() for x in self.seen]])

    def with_state(self, w: np.ndarray) -> Trainer:
        n = len(w) // 2
        self.m.with_weights(w[:n])
        at = n
        for x in self.seen:
            x[...] = w[at:at + x.size].reshape(x.shape)
            at += x.size
        return self

    def _scatter(self, rows: np.ndarray, g: np.ndarray, shape) -> np.ndarray:
        at = (rows[:, None] * shape[1] + np.arange(shape[1])).ravel()
        return np.bincount(at, g.ravel(), shape[0] * shape[1]).reshape(shape)

    def step(self, before: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None) -> None:
        """One minibatch; ``weight``: how often each token counts."""
        m = self.m
        weight = np.ones(len(target), np.float32) if weight is None else weight
        other = np.minimum(np.searchsorted(self.cum, self.rng.random(self.k) * self.cum[-1]), len(self.cum) - 1)
        r = m.predicted(before)
        own = m.vec.take(target, 0)
        offset = m.noise + np.float32(np.log(self.k))
        up = np.einsum("ij,ij->i", r, own) + m.bias[target] - offset[target]
        down = r @ m.vec[other].T + (m.bias - offset)[other]
        g = -weight / (1 + np.exp(np.clip(up, -30, 30)))
        h = weight[:, None] / (1 + np.exp(-np.clip(down, -30, 30)))
        back = g[:, None] * own + h @ m.vec[other]
        d_vec = self._scatter(target, g[:, None] * r, m.vec.shape)
        np.add.at(d_vec, other, h.T @ r)
        d_bias = np.bincount(target, g, len(m.bias))
        np.add.at(d_bias, other, h.sum(axis=0))
        d_ctx = np.stack([self._scatter(before[j], back, m.ctx.shape[1:]) for j in range(ORDER)])
        for p, d, s in zip((m.ctx, m.vec, m.bias), (d_ctx, d_vec, d_bias), self.seen, strict=True):
            d = (d / weight.sum()).astype(np.float32)
            s += d * d
            p -= self.rate * d / np.sqrt(s)


class Reader:
    """Texts to outputs and contexts."""

    def __init__(self, corpus: Corpus):
        self.known, self.out, self.n_model = pa.array(list(corpus.known), pa.binary()), corpus.out, len(corpus.noise) - CLASSES
        self.start = len(corpus.noise)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Tokens of each text; of every token its output and its number in the dictionary (-1: not in it);
        the words not in it, in their order."""
        words, n = tokens_of(texts)
        num = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        out = self.out[num] if len(self.out) else np.zeros(len(num), np.int64)
        rare = words.take(pa.array(np.flatnonzero(num < 0)))
        out[num < 0] = np.where(pc.binary_length(rare).to_numpy() > 0, self.n_model + word_classes(rare), 0)
        return n, out, num, rare

    def contexts(self, n: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Outputs at distance 1 .. ORDER before each token of several texts."""
        place = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        before = np.full((ORDER, len(out)), self.start)
        for j in range(1, ORDER + 1):
            at = np.flatnonzero(place >= j)
            before[j - 1, at] = out[at - j]
        return before


def _slim(corpus: Corpus) -> Corpus:
    return Corpus(None, **{k: v for k, v in corpus.__dict__.items() if k != "counts"})


def _pieces(corpus: Corpus, units: int, limit: int = 16_000_000):
    """Texts to ``unit, seq, n``: a piece is ``ORDER`` outputs of context and up
    to ``PIECE`` targets as 16-bit numbers.  Equal pieces are added up first, a
    bounded number of bytes at a time."""
    corpus = _slim(corpus)

    def flush(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([zlib.crc32(x) % units for x in c], pa.int64()), pa.array(list(c), pa.binary()),
                                           pa.array(list(c.values()), pa.int64())], ["unit", "seq", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, size = Reader(corpus), Counter(), 0
        for b in portions(batches, READ):
            n, outs, _, _ = reader.read(b.column("text"))
            for out in np.split(outs, np.cumsum(n)[:-1]):
                out = np.concatenate([np.full(ORDER, reader.start), out]).astype("<u2")
                for i in range(0, len(out) - ORDER, PIECE):
                    held[out[i:i + ORDER + PIECE].tobytes()] += 1
                size += 2 * len(out) + 100
                if size >= limit:
                    yield flush(held)
                    held, size = Counter(), 0
        if held:
            yield flush(held)
    return run


def _train_unit(noise: np.ndarray, state: np.ndarray):
    def run(t: pa.Table) -> pa.Table:
        unit = t.column("unit")[0].as_py()
        trainer = Trainer(Model(noise), seed=SEED + unit).with_state(state)
        rows = sorted(zip(t.column("seq").to_pylist(), t.column("n").to_pylist(), strict=True))
        order = np.random.default_rng([SEED, unit]).permutation(len(rows))
        seqs = [np.frombuffer(rows[i][0], "<u2").astype(np.int64) for i in order]
        target = np.concatenate([s[ORDER:] for s in seqs])
        before = np.stack([np.concatenate([s[ORDER - j:len(s) - j] for s in seqs]) for j in range(1, ORDER + 1)])
        weight = np.repeat([np.float32(rows[i][1]) for i in order], [len(s) - ORDER for s in seqs])
        for i in range(0, len(target), BATCH):
            trainer.step(before[:, i:i + BATCH], target[i:i + BATCH], weight[i:i + BATCH])
        return pa.table({"unit": [unit], "n": [len(target)], "w": pa.array([trainer.state().tolist()], pa.list_(pa.float64()))})
    return run


def _add(t: pa.Table) -> pa.Table:
    """Sum of the states of some units, each by its number of tokens, in the order of the units."""
    t = t.sort_by("unit")
    n = t.column("n").to_numpy()
    w = sum(k * x.values.to_numpy() for k, x in zip(n, t.column("w"), strict=True))
    return pa.table({"unit": [t.column("unit")[0].as_py()], "n": [int(n.sum())], "w": pa.array([w.tolist()], pa.list_(pa.float64()))})


def train(learn: DataFrame, corpus: Corpus, unit_tokens: int = UNIT, min_rounds: int = ROUNDS) -> Model:
    """All learning tokens once, in rounds of units; at most ``ADDERS`` rows of a round reach the driver."""
    trainer = Trainer(Model(corpus.noise))
    if not corpus.total:
        return trainer.m
    units = math.ceil(corpus.total / unit_tokens)
    rounds = min(units, max(min_rounds, math.ceil(math.sqrt(units))))
    spark = learn.sparkSession
    folder = f"{scratch_folder(spark)}/units-{uuid.uuid4().hex}"
    pieces = learn.mapInArrow(_pieces(corpus, units), "unit long, seq binary, n long").repartition("unit")
    pieces = pieces.groupBy("unit", "seq").agg(F.sum("n").alias("n"))        # already together by unit: no second shuffle
    pieces.withColumn("round", (F.col("unit") % rounds).cast("int")).write.partitionBy("round").parquet(folder)
    kept = spark.read.schema("unit long, seq binary, n long, round int").parquet(folder)
    kind = "unit long, n long, w array<double>"
    for r in range(rounds):
        rows = kept.filter(F.col("round") == r).drop("round").repartition(3 * math.ceil(units / rounds), "unit")
        done = rows.groupBy("unit").applyInArrow(_train_unit(corpus.noise, trainer.state()), kind)
        sums = done.groupBy(F.expr(f"floor(unit / {rounds}) % {ADDERS}")).applyInArrow(_add, kind).collect()
        if sums:
            sums.sort(key=lambda x: x["unit"])
            trainer.with_state(sum(np.asarray(x["w"]) for x in sums) / sum(x["n"] for x in sums))
    remove_folder(spark, folder)
    return trainer.m


# ---------------------------------------------------------------------------
# scores
# ---------------------------------------------------------------------------
_SCORED = "row long, doc_id {id}, held_out boolean, n_tokens long, n_known long, base double, lm double, token binary, n long, scale double, rest double"


def _score(corpus: Corpus, model: Model):
    corpus = _slim(corpus)
    log_all = np.log10(corpus.total + corpus.vocab + 1)
    log_base = np.log10(corpus.freq + 1.0)
    ln10 = np.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, chances, row = Reader(corpus), Chances(model), TaskContext.get().partitionId() << 40
        for b in portions(batches, READ):
            n, out, num, words = reader.read(b.column("text"))
            lm = chances.logs(reader.contexts(n, out), out) / ln10
            inside = num >= 0
            if len(corpus.freq):
                lm += np.where(inside, corpus.inside[num], 0) / ln10
                base = np.where(inside, log_base[num] - log_all, 0)
            else:
                base = np.zeros(len(num))
            k = len(n)
            doc = np.repeat(np.arange(k), n)
            rare = words.dictionary_encode()                                 # one row for each document and word outside the dictionary
            kinds = max(1, len(rare.dictionary))
            pair, often = np.unique(doc[~inside] * kinds + rare.indices.to_numpy(), return_counts=True)
            r_tok, r_doc, m = rare.dictionary.take(pa.array(pair % kinds)), pair // kinds, len(pair)
            cls = word_classes(r_tok)
            unknown = np.where(pc.binary_length(r_tok).to_numpy() > 0, corpus.unseen[cls], 1.0)
            scale = (1 - corpus.unseen[cls]) / np.maximum(corpus.class_total[cls], 1)
            keys = pa.array([b" %d" % (row + i) for i in range(k)], pa.binary())                    # no word begins with a space
            head = lambda a: pa.concat_arrays([a, pa.nulls(m, a.type)])  # noqa: E731, B023
            tail = lambda a: pa.concat_arrays([pa.nulls(k, a.type), a])  # noqa: E731, B023
            sums = lambda a: pa.array(np.bincount(doc, a, k))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.concatenate([np.arange(k), r_doc])), head(b.column("doc_id")), head(b.column("held_out")),
                head(pa.array(n)), head(sums(inside).cast(pa.int64())), head(sums(base)), head(sums(lm)),
                pa.concat_arrays([keys, r_tok]), tail(pa.array(often.astype(np.int64))), tail(pa.array(scale)), tail(pa.array(unknown))],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "token", "n", "scale", "rest"])
            row += k
    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_tokens: int = UNIT) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score`` (log10 chances of the whole text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text_of(text_col).cast("binary").alias("text"))
    learn = rows.filter(~F.col("held_out")).select("text")
    corpus = gather_corpus(learn)
    model = train(learn, corpus, unit_tokens)
    schema = _SCORED.format(id=dict(rows.dtypes)["doc_id"])
    scored = rows.mapInArrow(_score(corpus, model), schema)
    joined = scored.join(corpus.counts.select("token", "c"), "token", "left")
    c = F.coalesce("c", F.lit(0))
    joined = joined.select(
        "row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm", (F.col("n") * (c > 0).cast("long")).alias("k"),
        (F.col("n") * F.log10((c + 1) / F.lit(float(corpus.total + corpus.vocab + 1)))).alias("b"),
        (F.col("n") * F.log10(F.when(c > 0, c * F.col("scale")).otherwise(F.col("rest")))).alias("s"))
    head = lambda x: F.max(x).alias(x)
    add = lambda x, y, zero: (F.max(x) + F.coalesce(F.sum(y), F.lit(zero)))
    return joined.groupBy("row").agg(
        head("doc_id"), head("held_out"), head("n_tokens"), add("n_known", "k", 0).alias("n_known"),
        add("base", "b", 0.0).alias("base_score"), add("lm", "s", 0.0).alias("score")).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.total).cast("long").alias("train_tokens"), "base_score", "score")
