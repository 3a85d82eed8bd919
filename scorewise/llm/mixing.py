"""Operator 10, mixing sources to target weights by a time-varying curriculum
(DataFrame functions only).

Each source has a target number of words and a demand that changes over the
training run: at time t in [0, 1] it is ``target * (1 + ramp * (2t - 1))``, so
a positive ramp makes a source commoner towards the end.  The demand integrates
to ``target * (t + ramp * (t^2 - t))``.  A source's documents stand in the
order of an md5 of their id, gone through again as often as the target needs; a
copy that begins ``c`` words into that stream gets the time at which the
cumulative demand reaches the middle of the copy, and is taken if that is
within the run.  Taken copies are whole documents, so a source misses its
target by half a document at most.  Copies sorted by time are the mix.

Targets: a budget of ``share`` times all words is dealt by weight; a source's
target stops at ``most`` times its words and the excess is dealt again by
weight, which is water filling: with sources ordered by cap per weight, the
level is the first at which the uncapped ones stay below their caps.

Running totals are in two steps (inside (source, md5 prefix), then offsets of
the prefixes), so no task gets a whole source.  A null text has size 0, and a
null source is a source of its own, sorted last.  Rows alike in id and text
are ties; each takes its own place in the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewise.llm.common import fresh, one_row_per_key, same, text_of, word_count
from scorewise.llm.common import cut as cut_plan

WEIGHTS, RAMPS, SHARE, MOST, SEED, DIGITS = (5.0, 2.0, 1.0), (0.5, 0.0, -0.5), 1.5, 2, 42, 3
SLICES = 4096


def source_key(source: Column) -> Column:
    """Sorts like the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def _cycle(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes(src, source_size)``, one row per source -> ``src, source_size,
    target, ramp``.  The windows run over one row per source."""
    by_name = Window.partitionBy(F.lit(0)).orderBy("src")
    all_rows = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    s = s.withColumn("w", _cycle(weights, F.col("i"))).withColumn("ramp", _cycle(ramps, F.col("i")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
    rising = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "i")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    s = s.withColumn("level", F.first(fits, ignorenulls=True).over(rising.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)))
    full = F.col("level").isNull()           # the budget reaches every cap
    target = F.when(full, F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return s.select("src", "source_size", target.alias("target"), "ramp")


def time_of(words: Column, target: Column, ramp: Column) -> Column:
    """Inverse of the cumulative demand ``target * (t + ramp * (t^2 - t))``."""
    q = words / target
    return F.when(ramp == 0, q).otherwise(
        (ramp - 1 + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * q)) / (2 * ramp))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, ramps=RAMPS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, h, src, size, source_size, target,
    copies, taken, times`` (array of times, one per copy)."""
    if not all(abs(r) < 1 for r in ramps):
        raise ValueError("a ramp lies between -1 and 1")
    text = text_of(text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), source_key(F.col(source_col)).alias("src"),
                    word_count(text).alias("size"))
    d = d.withColumn("place", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"-{seed}"))))
    d = cut_plan(d.withColumn("slot", F.substring("place", 1, DIGITS)))
    slots = d.groupBy("src", "slot").agg(F.sum("size").alias("words"))
    sizes = slots.groupBy("src").agg(F.sum("words").alias("source_size"))
    ahead = Window.partitionBy("src").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    slots = slots.join(source_targets(sizes, weights, ramps, share, most), "src").drop("words")
    within = Window.partitionBy("src", "slot").orderBy("place", "doc_id", "h")
    d = d.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.join(slots, ["src", "slot"]).withColumn("start", F.col("ahead") + F.col("upto") - F.col("size"))
    middle = lambda e: F.col("start") + e * F.col("source_size") + F.col("size") / 2
    rounds = F.array(*[F.lit(e) for e in range(int(most))])
    taken = F.filter(rounds, lambda e: (F.col("size") > 0) & (middle(e) <= F.col("target")))
    times = F.transform(taken, lambda e: time_of(middle(e), F.col("target"), F.col("ramp")))
    return d.select("doc_id", "h", "src", "size", "source_size", "target", times.alias("times")).select(
        "*", F.size("times").alias("copies"), (F.size("times") * F.col("size")).alias("taken"))


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per copy taken: ``doc_id, copy, time, position``; position counts
    from 0 along (time, doc_id).  Ranks are in two steps (inside a slice of the
    run, then offsets of the slices), so no task gets the whole mix."""
    plan = plan_mix(docs, id_col, text_col, source_col, **how)
    c = cut_plan(plan.select("doc_id", "h", F.posexplode("times").alias("copy", "time")))
    c = c.withColumn("slice", F.least(F.floor(F.col("time") * SLICES), F.lit(SLICES - 1)))
    slices = c.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))   # at most SLICES rows
    within = Window.partitionBy("slice").orderBy("time", "doc_id", "h", "copy")
    c = c.withColumn("rank", F.row_number().over(within)).join(F.broadcast(slices), "slice")
    return c.select("doc_id", "copy", "time", (F.col("ahead") + F.col("rank") - 1).alias("position"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: ``docs`` rows, one per copy taken, range-sorted by time.
    Rows alike in id, source and text count as often as they occur."""
    h, src, at, when = fresh(docs, "h", "src", "at", "when")
    plan = plan_mix(docs, id_col, text_col, source_col, **how)
    plan = cut_plan(plan.groupBy("doc_id", "h", "src").agg(F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("times")).alias("times")))
    keyed = docs.withColumn(h, F.xxhash64(text_of(text_col))).withColumn(src, source_key(F.col(source_col)))
    key = [id_col, h, src]
    many = plan.filter("n > 1").select(F.col("doc_id").alias(id_col), F.col("h").alias(h), F.col("src").alias(src))
    keyed = one_row_per_key(keyed, key, many)
    p = plan.filter(F.size("times") > 0).select(F.col("doc_id").alias("p_id"), F.col("h").alias("p_h"),
                                                F.col("src").alias("p_src"), F.col("times").alias(at))
    p = p.toDF(*fresh(keyed, *p.columns))
    out = keyed.join(p, same([F.col(c) for c in key], [F.col(c) for c in p.columns[:3]]))
    out = out.select(*docs.columns, F.explode(F.col(p.columns[3])).alias(when))
    return out.orderBy(when, id_col).select(*docs.columns)
