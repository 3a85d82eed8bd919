"""Registered queries of the reading checks (S2, P14, P15), the alignment of
separately scored models (J5), the recommendation (D10) and the evidence
document (S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewise.config import MODEL_NAMES, SEED_STABILITY_STD_WARN
from scorewise.operators import clean as cl
from scorewise.operators import decide as de
from scorewise.operators import metrics as me
from scorewise.operators import report as rp
from scorewise.plans import q_decide, q_encode  # noqa: F401  (their queries are sections)
from scorewise.plans import sql as S
from scorewise.plans.q_features import CLEAN_CTES
from scorewise.plans.q_io import _SEED_M, _seed_long
from scorewise.plans.queries import REGISTRY, oracle, register
from scorewise.session import cut_lineage
from scorewise.sources import fixtures as fx

dbl = S.dbl


@register("read_checks", oracle(*CLEAN_CTES, body="""
SELECT CAST(COUNT(*) AS BIGINT) AS rows, CAST(COALESCE(SUM(CASE WHEN y IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS unknown_labels,
  CAST(SUM(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS class_0, CAST(SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS class_1,
  CAST(SUM(CASE WHEN y = 2 THEN 1 ELSE 0 END) AS BIGINT) AS class_2,
  CAST(SUM(CASE WHEN country IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_country,
  CAST(SUM(CASE WHEN owner_sex IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_owner_sex FROM clean"""))
def q_read_checks(spark, d):
    """What the read step observes while it writes the cleaned table (one scan)."""
    _, seen = cl.read_checked(fx.survey(spark, d), cut_lineage)
    return spark.createDataFrame([tuple(seen.values())], ", ".join(f"{c} bigint" for c in seen))


def run_scores(spark, d):
    """Scores of three runs that do not quite fit: ``lg`` lacks ids, ``xg`` has some
    twice, ``cb`` has ids of its own, and some rows name another model."""
    three = me.scores_long(fx.oof(spark, d), {m: [F.col(f"{m}{c}") for c in range(3)] for m in MODEL_NAMES}, keep=("id",))
    kept = three.filter(~((F.col("model") == "lg") & (F.col("id") % 7 == 0)))
    twice = three.filter((F.col("model") == "xg") & (F.col("id") % 11 == 0))
    other = three.filter((F.col("model") == "cb") & (F.col("id") % 13 == 0)).withColumn("model", F.lit("zz"))
    more = three.filter((F.col("model") == "cb") & (F.col("id") % 17 == 0)).withColumn("id", -F.col("id"))
    return kept.unionByName(twice).unionByName(other).unionByName(more)


_RUN_CTES = (S.oof_cte(), ("three", S.long_select()), ("runs", """
  SELECT id, model, p0, p1, p2 FROM three WHERE NOT (model = 'lg' AND id % 7 = 0)
  UNION ALL SELECT id, model, p0, p1, p2 FROM three WHERE model = 'xg' AND id % 11 = 0
  UNION ALL SELECT id, 'zz', p0, p1, p2 FROM three WHERE model = 'cb' AND id % 13 = 0
  UNION ALL SELECT -id, model, p0, p1, p2 FROM three WHERE model = 'cb' AND id % 17 = 0"""))
_PER_MODEL = [(f"of_{m}", f"SELECT id, COUNT(*) AS n, MAX(p0) AS p0, MAX(p1) AS p1, MAX(p2) AS p2 FROM runs WHERE model = '{m}' GROUP BY id")
              for m in MODEL_NAMES]
_JOINED = ("joined", "SELECT ids.id, " + ", ".join(f"COALESCE(of_{m}.n, 0) AS n_{m}" for m in MODEL_NAMES) + ", "
           + ", ".join(f"of_{m}.p{c} AS {m}{c}" for m in MODEL_NAMES for c in range(3))
           + ", (SELECT COUNT(*) FROM runs r WHERE r.id = ids.id AND r.model NOT IN ('cb', 'lg', 'xg')) AS n_other"
           + " FROM (SELECT DISTINCT id FROM runs) ids " + " ".join(f"LEFT JOIN of_{m} ON of_{m}.id = ids.id" for m in MODEL_NAMES))
_STATUS = ("tagged", "SELECT *, CASE WHEN GREATEST(n_cb, n_lg, n_xg) > 1 THEN 'repeated' WHEN LEAST(n_cb, n_lg, n_xg) = 0 THEN 'missing' "
                     "ELSE 'ok' END AS status FROM joined")


@register("align_scores", oracle(*_RUN_CTES, *_PER_MODEL, _JOINED, _STATUS, body="SELECT id, n_cb, n_lg, n_xg, n_other, status, "
          + ", ".join(f"CASE WHEN status = 'ok' THEN ROUND({m}{c}, 6) END AS {m}{c}" for m in MODEL_NAMES for c in range(3)) + " FROM tagged"))
def q_align_scores(spark, d):
    return me.rounded(rp.align_scores(run_scores(spark, d), MODEL_NAMES))


def _of(name: str) -> str:
    return f"({REGISTRY[name][1]})"


#: Limit on the seeds' std above which the recommendation warns: the method's, and one that no run reaches.
CASES = {"method": SEED_STABILITY_STD_WARN, "lenient": 1.0}
_FLAG = ("flags", "SELECT STDDEV_POP(wf1) AS a, STDDEV_POP(hrec) AS b FROM sm")
_CASES = ("cases", " UNION ALL ".join(f"SELECT '{c}' AS \"case\", CAST(CASE WHEN a > {dbl(w)} OR b > {dbl(w)} THEN 1 ELSE 0 END AS INTEGER) AS flag FROM flags"
                                      for c, w in CASES.items()))


@register("recommendation", oracle(("os", fx.OOF_SEEDS_DUCK), _SEED_M, _FLAG, _CASES, ("ds", "SELECT * FROM " + _of("decision_summary")),
          ("als", "SELECT * FROM " + _of("alpha_select")), ("gts", "SELECT * FROM " + _of("gate_select")), body="""
SELECT "case", decision, best_alpha AS alpha, CASE WHEN decision = 'gate' THEN gate_t_cb END AS t_cb,
  CASE WHEN decision = 'gate' THEN gate_t_blend END AS t_blend, CASE WHEN decision = 'alpha' THEN (SELECT best_hrec FROM als) END AS hrec,
  CASE WHEN decision = 'gate' THEN (SELECT best_wf1 FROM gts) END AS wf1, flag AS instability_flag,
  CASE decision WHEN 'alpha' THEN 'submit the alpha sweep' WHEN 'gate' THEN 'submit the gated rescue' ELSE 'submit the searched blend' END
    || CASE WHEN flag = 1 THEN '; seed instability: verify the results' ELSE '' END AS note
FROM ds CROSS JOIN cases"""))
def q_recommendation(spark, d):
    """The recommendation with the method's stability limit and with a lenient one."""
    return recommended(de.decide_once(de.decision_input(fx.oof(spark, d))), cut_lineage(rp.seed_metrics(_seed_long(spark, d))))


def recommended(steps: dict, per_seed):
    out = None
    for case, warn in CASES.items():
        r = de.recommendation(steps["summary"], steps["alpha"], steps["gate"], rp.seed_stability(per_seed, warn))
        r = me.rounded(r).select(F.lit(case).alias("case"), "*")
        out = r if out is None else out.unionByName(r)
    return out


#: Section of the evidence document -> registered query that states it in SQL.
SECTIONS = {"model_comparison": "model_comparison", "blend": "select_blend", "medium_baseline": "medium_baseline",
            "calibration": "calibration_summary", "recoverable_high": "recoverable_high", "alpha": "alpha_select", "gate": "gate_select",
            "decision": "decision_summary", "recommendation": "recommendation", "seed_metrics": "seed_metrics", "seed_stability": "seed_stability",
            "fold_winner": "fold_winner", "classes": "class_distribution", "class_weights": "balanced_weights"}


def _section_sql(name: str) -> str:
    by, numbers, texts = rp.EVIDENCE[name]
    item = "concat_ws('/', " + ", ".join(f'CAST("{c}" AS VARCHAR)' for c in by) + ")" if by else "''"
    cells = [f"struct_pack(key := '{c}', number := " + (f'CAST("{c}" AS DOUBLE)' if c in numbers else "CAST(NULL AS DOUBLE)")
             + ", text := " + (f'CAST("{c}" AS VARCHAR)' if c in texts else "CAST(NULL AS VARCHAR)") + ")" for c in (*numbers, *texts)]
    return f"SELECT '{name}' AS section, {item} AS item, unnest([{', '.join(cells)}], recursive := true) FROM {_of(SECTIONS[name])} s"


@register("evidence_rows", " UNION ALL ".join(_section_sql(n) for n in SECTIONS))
def q_evidence_rows(spark, d):
    """Every section of the evidence document, built as one nested row and flattened."""
    sections = {name: REGISTRY[query][0](spark, d) for name, query in SECTIONS.items()}
    return rp.evidence_rows(cut_lineage(rp.evidence_document(sections)))
