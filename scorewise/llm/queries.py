"""Registered queries of the training-data operators: ``QUERIES`` and ``ORACLES``."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.llm import bpe, embedding_dedup, exact_dedup, license_scan, lm_score, mixing, packing, periodic_runs, pii_crf, quality_pu, ranked_search, simhash, substring_dedup
from scorewise.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


@register("op1_embedding_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (
  SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
SELECT v.vec_id, COALESCE((SELECT COUNT(*) FROM pairs p WHERE p.x = v.vec_id), 0) AS n_links,
  LEAST(v.vec_id, COALESCE((SELECT MIN(y) FROM reach r WHERE r.x = v.vec_id), v.vec_id)) AS component_id,
  v.vec_id <= COALESCE((SELECT MIN(y) FROM reach r WHERE r.x = v.vec_id), v.vec_id) AS kept
FROM v""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@register("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@register("op3_lm_score")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


@register("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.documents_with_repeats(table(spark, sf_dir, "documents"))


@register("op5_quality_pu")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_pu.score_quality(docs, quality_pu.fit_quality(docs, table(spark, sf_dir, "labels")))


@register("op6_simhash_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@register("op7_pii_crf")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    n = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in pii_crf.KINDS], F.sha2(digest(base), 256).alias("base_sha256"),
                        digest(F.col("spans")).alias("spans"))


@register("op8_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(COALESCE(text, '')) AS text_sha256, COALESCE(text, '') AS t FROM documents)
SELECT doc_id, MAX(doc_id) OVER (PARTITION BY t) AS keep_id, COUNT(*) OVER (PARTITION BY t) AS group_size,
       doc_id = MAX(doc_id) OVER (PARTITION BY t) AS kept, text_sha256
FROM d""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


@register("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


_WORDS = "len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+'))"


def _time_sql(words: str) -> str:
    """Time at which the demand of a source reaches so many words."""
    q = f"({words}) / target"
    return f"CASE WHEN ramp = 0 THEN {q} ELSE (ramp - 1 + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * {q})) / (2 * ramp) END"


@register("op10_mixing", f"""
WITH d AS (
  SELECT doc_id, COALESCE('s' || source, 't') AS src, CAST({_WORDS} AS BIGINT) AS size,
         md5(COALESCE(CAST(doc_id AS VARCHAR), '') || '-42') AS place FROM documents),
s AS (
  SELECT src, CAST(SUM(size) AS BIGINT) AS source_size,
         CASE (ROW_NUMBER() OVER (ORDER BY encode(src)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w,
         CASE (ROW_NUMBER() OVER (ORDER BY encode(src)) - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0 ELSE -0.5 END AS ramp
  FROM d GROUP BY src),
c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * SUM(source_size) OVER () AS budget FROM s),
f AS (
  SELECT a.*, COALESCE((SELECT SUM(b.cap) FROM c b WHERE b.cap / b.w < a.cap / a.w), 0) AS taken_caps,
         (SELECT SUM(b.w) FROM c b WHERE b.cap / b.w >= a.cap / a.w) AS open_w FROM c a),
l AS (SELECT ARG_MIN((budget - taken_caps) / open_w, cap / w) FILTER (WHERE (budget - taken_caps) / open_w <= cap / w) AS level FROM f),
t AS (SELECT src, source_size, ramp, CASE WHEN level IS NULL THEN cap ELSE LEAST(cap, level * w) END AS target FROM f, l),
p AS (
  SELECT d.*, source_size, target, ramp,
         SUM(size) OVER (PARTITION BY d.src ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN t ON d.src = t.src),
m AS (SELECT *, start + size / 2.0 AS one, start + source_size + size / 2.0 AS two FROM p)
SELECT doc_id, size, source_size, ROUND(target, 4) AS target,
  ROUND(CASE WHEN size > 0 AND one <= target THEN {_time_sql('one')} END, 6) AS first_time,
  ROUND(CASE WHEN size > 0 AND two <= target THEN {_time_sql('two')} WHEN size > 0 AND one <= target THEN {_time_sql('one')} END, 6) AS last_time,
  CAST(CASE WHEN size = 0 THEN 0 ELSE size * ((CASE WHEN start + size / 2.0 <= target THEN 1 ELSE 0 END)
    + (CASE WHEN start + source_size + size / 2.0 <= target THEN 1 ELSE 0 END)) END AS BIGINT) AS taken
FROM m""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    ends = [F.round(F.get("times", i), 6).alias(n) for i, n in ((F.lit(0), "first_time"), (F.col("copies") - 1, "last_time"))]
    return plan.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), *ends, "taken")


@register("op10_mixing_times")
def op10_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = mixing.training_order(table(spark, sf_dir, "documents"))
    return order.select("doc_id", "copy", F.round("time", 9).alias("time"), "position")


_TERMS = ("regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")


@register("op11_ranked_search", f"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT CAST(COUNT(*) AS BIGINT) AS n_docs, CAST(SUM(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
q AS (SELECT item_id, term, COUNT(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, COUNT(*) AS tf FROM (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
c AS (SELECT q.item_id, p.r, p.doc_id, CAST(SUM(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.n_docs) // s.n_terms)))) AS BIGINT) AS score
      FROM q JOIN p ON q.term = p.term JOIN w ON w.term = p.term, s GROUP BY q.item_id, p.r, p.doc_id),
t AS (SELECT item_id, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT * FROM t WHERE rank <= 20""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Name of the tokenizer file of op12 in the folder of public tokenizers.
TOKENIZER = "byte_bpe_50k.json"


@register("op12_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        return bpe.round_trip(table(spark, sf_dir, "documents"), f.read())


@register("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"))


register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
