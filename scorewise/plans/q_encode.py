"""Registered fold and encoding queries (J7, A2, A3, A12, M10, M3, M5, M6,
M7, M8, J2)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from scorewise.config import (CAT_FEATURES, CLUSTER_FEATURES, CLUSTER_TE_FOLDS, FIXED_CLASS_WEIGHTS, INNER_FOLD_SEED_OFFSET,
                              MISSING_TOKEN, N_SPLITS, SEED, TE_SMOOTH_ALPHA)
from scorewise.operators import clean as cl
from scorewise.operators import encode as en
from scorewise.operators import features as fe
from scorewise.operators import folds as fo
from scorewise.operators import kmeans as km
from scorewise.operators.metrics import rounded
from scorewise.plans import sql as S
from scorewise.plans.q_features import CLEAN_CTES, DERIVED_RAW, STATS, clean_survey_y
from scorewise.plans.queries import R, oracle, register
from scorewise.session import cut_lineage
from scorewise.sources import fixtures as fx
from scorewise.sources.tables import load

dbl = S.dbl
FOLDED = ("fc", fx.folds_sql("SELECT * FROM clean"))


def folded(spark, d):
    return fo.assign_folds(clean_survey_y(spark, d))


@register("fold_overlap_check", oracle(*CLEAN_CTES, FOLDED, body="""
SELECT CAST(k.range AS INTEGER) AS fold,
  CAST(SUM(CASE WHEN fc.fold <> k.range THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
  CAST(SUM(CASE WHEN fc.fold = k.range THEN 1 ELSE 0 END) AS BIGINT) AS n_val,
  (SELECT COUNT(DISTINCT a.id) FROM fc a JOIN fc b ON a.id = b.id WHERE a.fold = k.range AND b.fold <> k.range)
    AS n_overlap
FROM range(0, 5) k CROSS JOIN fc GROUP BY k.range"""))
def q_fold_overlap_check(spark, d):
    return fo.fold_overlap_check(folded(spark, d).select("id", "fold"))


@register("class_shares", oracle(*CLEAN_CTES, body="""
SELECT y, COUNT(*) AS n, ROUND(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (), 6) AS share FROM clean GROUP BY y"""))
def q_class_shares(spark, d):
    return rounded(en.class_shares(clean_survey_y(spark, d)))


@register("balanced_weights", oracle(*CLEAN_CTES, body="""
SELECT y, COUNT(*) AS n,
  ROUND(CAST(SUM(COUNT(*)) OVER () AS DOUBLE) / (COUNT(*) OVER () * COUNT(*)), 6) AS weight
FROM clean GROUP BY y"""))
def q_balanced_weights(spark, d):
    return rounded(en.balanced_weights(clean_survey_y(spark, d)))


@register("fixed_weights", oracle(*CLEAN_CTES, body=f"""
SELECT id, y, CASE y WHEN 0 THEN {dbl(FIXED_CLASS_WEIGHTS[0])} WHEN 1 THEN {dbl(FIXED_CLASS_WEIGHTS[1])}
  ELSE {dbl(FIXED_CLASS_WEIGHTS[2])} END AS weight FROM clean"""))
def q_fixed_weights(spark, d):
    return en.with_fixed_weight(clean_survey_y(spark, d).select("id", "y"))


# ---------------------------------------------------------------------------
# target encoding (A3, M6, J2); key = country with NULL as its own token
# ---------------------------------------------------------------------------
KEY_SQL = f"COALESCE(country, '{MISSING_TOKEN}')"


def keyed(df):
    return df.withColumn("key", F.coalesce(F.col("country"), F.lit(MISSING_TOKEN)))


def _te_sql(nc, n, g):
    return f"(({nc}) + {dbl(TE_SMOOTH_ALPHA)} * {g}) / (({n}) + {dbl(TE_SMOOTH_ALPHA)})"


def _te_map_sql(src: str) -> str:
    cnt = ", ".join(f"CAST(SUM(CASE WHEN y = {c} THEN 1 ELSE 0 END) AS BIGINT) AS n{c}" for c in range(3))
    g = ", ".join(f"CAST(SUM(n{c}) OVER () AS DOUBLE) / SUM(n) OVER () AS g{c}" for c in range(3))
    te = ", ".join(f"{_te_sql(f'n{c}', 'n', f'g{c}')} AS te{c}" for c in range(3))
    return (f"SELECT key, n, {te}, g0, g1, g2 FROM (SELECT *, {g} FROM "
            f"(SELECT {KEY_SQL} AS key, COUNT(*) AS n, {cnt} FROM {src} GROUP BY 1) a) b")


@register("target_encoding_map", oracle(*CLEAN_CTES, ("tm", _te_map_sql("clean")), body=f"""
SELECT key, n, {R('~te0, ~te1, ~te2')} FROM tm"""))
def q_target_encoding_map(spark, d):
    m = en.target_encoding_map(keyed(clean_survey_y(spark, d)), "key")
    return rounded(m.select("key", "n", "te0", "te1", "te2"))


def _global_train(k: int) -> tuple[str, str]:
    return (f"gt{k}", "SELECT " + ", ".join(
        f"CAST(SUM(CASE WHEN y = {c} THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS g{c}" for c in range(3))
        + f" FROM fc WHERE fold <> {k}")


_FOLD_LOOKUPS = " UNION ALL ".join(
    f"""SELECT id, {', '.join(f'ROUND(COALESCE(tm{k}.te{c}, gt{k}.g{c}), 6) AS te{c}' for c in range(3))}
FROM (SELECT id, {KEY_SQL} AS key FROM fc WHERE fold = {k}) v LEFT JOIN tm{k} ON v.key = tm{k}.key CROSS JOIN gt{k}"""
    for k in range(N_SPLITS))


@register("target_encode_lookup", oracle(
    *CLEAN_CTES, FOLDED, *[(f"tm{k}", _te_map_sql(f"(SELECT * FROM fc WHERE fold <> {k}) t")) for k in range(N_SPLITS)],
    *[_global_train(k) for k in range(N_SPLITS)], body=_FOLD_LOOKUPS))
def q_target_encode_lookup(spark, d):
    """Every row encoded by the map of the folds it is not in."""
    f = cut_lineage(keyed(folded(spark, d)))
    parts = [en.target_encode_lookup(*fo.split_fold(f, k), "key") for k in range(N_SPLITS)]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))


_INNER_SEED = SEED + INNER_FOLD_SEED_OFFSET
_INNER = ("inr", fx.folds_sql(f"SELECT id, y, {KEY_SQL} AS key FROM clean", seed=_INNER_SEED, k=CLUSTER_TE_FOLDS))
_CELL = ("cell", "SELECT key, fold AS f, COUNT(*) AS nf, " + ", ".join(
    f"CAST(SUM(CASE WHEN y = {c} THEN 1 ELSE 0 END) AS BIGINT) AS n{c}" for c in range(3))
    + " FROM inr GROUP BY key, fold")
_ENC = ("enc", "SELECT key, f, " + ", ".join(
    f"CASE WHEN tn - nf > 0 THEN {_te_sql(f't{c} - n{c}', 'tn - nf', f'g{c}')} ELSE g{c} END AS te{c}"
    for c in range(3)) + " FROM (SELECT *, SUM(nf) OVER (PARTITION BY key) AS tn, "
    + ", ".join(f"SUM(n{c}) OVER (PARTITION BY key) AS t{c}, "
                f"CAST(SUM(n{c}) OVER () AS DOUBLE) / SUM(nf) OVER () AS g{c}" for c in range(3))
    + " FROM cell) x")


@register("oof_target_encoding", oracle(*CLEAN_CTES, _INNER, _CELL, _ENC, body=f"""
SELECT id, {R("~te0, ~te1, ~te2")} FROM inr JOIN enc ON inr.key = enc.key AND inr.fold = enc.f"""))
def q_oof_target_encoding(spark, d):
    return rounded(en.oof_target_encoding(keyed(clean_survey_y(spark, d)), "key"))


# ---------------------------------------------------------------------------
# ordinal codes (M7), frozen categories (M8)
# ---------------------------------------------------------------------------
def _codes_sql(text_missing: bool) -> tuple:
    """Codes of every row under each outer fold k (categories of the rows outside fold k)."""
    ctes, parts = [], []
    for k in range(N_SPLITS):
        joins, cols = [], []
        for c in CAT_FEATURES:
            v = f"COALESCE({c}, 'nan')" if text_missing else c
            ctes.append((f"c{k}_{c}", f"SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM "
                                      f"(SELECT DISTINCT {v} AS v FROM fc WHERE fold <> {k} AND {v} IS NOT NULL) x"))
            joins.append(f"LEFT JOIN c{k}_{c} ON {v.replace(c, 'fc.' + c)} = c{k}_{c}.v")
            cols.append(f"COALESCE(c{k}_{c}.code, -1) AS {c}_code" if text_missing else f"c{k}_{c}.code AS {c}_code")
        parts.append(f"SELECT CAST({k} AS INTEGER) AS k, id, CASE WHEN fold <> {k} THEN 'train' ELSE 'val' END AS role, "
                     f"{', '.join(cols)} FROM fc {' '.join(joins)}")
    return ctes, " UNION ALL ".join(parts)


def fold_codes(spark, d, as_text_missing: bool):
    f = cut_lineage(folded(spark, d).select("id", "fold", *CAT_FEATURES))
    return en.fold_category_codes(fo.explode_folds(f), CAT_FEATURES, as_text_missing, keep=("k", "id", "role"))


ORD_CTES, ORD_BODY = _codes_sql(True)
_FRZ_CTES, _FRZ_BODY = _codes_sql(False)


@register("ordinal_encode", oracle(*CLEAN_CTES, FOLDED, *ORD_CTES, body=ORD_BODY))
def q_ordinal_encode(spark, d):
    """Ordinal codes of every row under each of the five folds."""
    return fold_codes(spark, d, as_text_missing=True)


@register("freeze_categories", oracle(*CLEAN_CTES, FOLDED, *_FRZ_CTES, body=_FRZ_BODY))
def q_freeze_categories(spark, d):
    """Frozen category codes of every row under each of the five folds."""
    return fold_codes(spark, d, as_text_missing=False)


# ---------------------------------------------------------------------------
# scaling (M3), nearest centre (M5)
# ---------------------------------------------------------------------------
def derived(spark, d):
    return fe.derived_features(clean_survey_y(spark, d))


def _scale_sql() -> tuple:
    aggs = ", ".join(f"AVG(COALESCE({c}, {dbl(0.0)})) AS m_{c}, STDDEV_POP(COALESCE({c}, {dbl(0.0)})) AS s_{c}"
                     for c in CLUSTER_FEATURES)
    cols = ", ".join(f"ROUND((COALESCE({c}, {dbl(0.0)}) - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 "
                     f"THEN {dbl(1.0)} ELSE s_{c} END, 6) AS {c}" for c in CLUSTER_FEATURES)
    return ("sc", f"SELECT {aggs} FROM derived"), f"SELECT id, {cols} FROM derived CROSS JOIN sc"


_SC_CTE, _SC_BODY = _scale_sql()


@register("standardize", oracle(*CLEAN_CTES, STATS, DERIVED_RAW, _SC_CTE, body=_SC_BODY))
def q_standardize(spark, d):
    df = derived(spark, d)
    params = en.scaler_values(en.fit_scaler(df, CLUSTER_FEATURES).first())
    return rounded(en.apply_scaler(df, params))


_EMB = ("e", """SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x,
  unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings""")
_CENT = ("cent", "SELECT label AS cid, pos, AVG(x) AS c FROM e GROUP BY label, pos")
_DIST = ("dd", """SELECT e.vec_id, cent.cid, SQRT(SUM((e.x - cent.c) * (e.x - cent.c))) AS dist
  FROM e JOIN cent ON e.pos = cent.pos GROUP BY e.vec_id, cent.cid""")


@register("centroid_distance", oracle(_EMB, _CENT, _DIST, body="""
SELECT vec_id, cid AS cluster_id, ROUND(dist, 6) AS dist FROM dd
QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY dist, cid) = 1"""))
def q_centroid_distance(spark, d):
    emb = load(spark, d, "embeddings")
    centres = cut_lineage(en.label_centres(emb, "embedding", "label"))
    return rounded(km.nearest_of(emb, "embedding", centres, "label", "centre", ["vec_id"]))


@register("kmeans_round", oracle(_EMB, _CENT, _DIST, ("near", """SELECT vec_id, cid, dist FROM dd
QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY dist, cid) = 1"""), ("moved", """
  SELECT near.cid, e.pos, AVG(e.x) AS m FROM near JOIN e USING (vec_id) GROUP BY near.cid, e.pos"""), ("shift", """
  SELECT moved.cid, SQRT(SUM((m - c) * (m - c))) AS shift FROM moved JOIN cent ON moved.cid = cent.cid AND moved.pos = cent.pos
  GROUP BY moved.cid"""), ("lab", "SELECT cid, CAST(ROW_NUMBER() OVER (ORDER BY cid) - 1 AS INTEGER) AS centre FROM (SELECT DISTINCT cid FROM cent) x"),
    body="""
SELECT centre, COUNT(dist) AS n, ROUND(COALESCE(SUM(dist * dist), 0), 6) AS cost, ROUND(COALESCE(MAX(shift), 0), 6) AS shift
FROM lab LEFT JOIN near ON near.cid = lab.cid LEFT JOIN shift ON shift.cid = lab.cid GROUP BY centre"""))
def q_kmeans_round(spark, d):
    """One k-means round over all vectors, from the label means as centres."""
    emb = load(spark, d, "embeddings")
    held = sorted((r[0], r[1]) for r in en.label_centres(emb, "embedding", "label").collect())       # a row per label: the k of the round
    return rounded(km.lloyd_round(emb, "embedding", np.array([c for _, c in held]), "vec_id"))
