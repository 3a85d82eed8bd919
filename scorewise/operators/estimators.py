"""``pyspark.ml`` Estimator / Model pairs for the two fitted feature stages of
an outer fold (SURVEY 2.9, entry point E3).

* ``DerivedFeatures``: fit = per-country statistics (one grouped aggregate);
  transform = the 18 derived columns (projections + one left join).
* ``ClusterFeatures``: fit = scaler parameters, best-of-n k-means per k, the
  full target-encoding map per k and the out-of-fold encodings of the training
  rows; transform = nearest centre per k, then joins.  A row whose ``id`` was
  in the fitted training part gets its stored out-of-fold encoding; any other
  row gets the full map (unseen cluster -> the training part's class shares).
  Being joins on ``id``, this works on any frame, in any row order.

Fitted tables are cut from their lineage with reliable checkpoints; the
driver holds only parameters (scaler values, k x d centres, three shares).
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.config import CLUSTER_FEATURES, INNER_FOLD_SEED_OFFSET, SEED, RunConfig
from scorewise.functions.columns import dlit
from scorewise.operators import encode as en
from scorewise.operators import features as fe
from scorewise.operators.joins import bounded_broadcast
from scorewise.operators import kmeans as km
from scorewise.session import cut_lineage

CLASSES = en.CLASSES


class DerivedFeatures(Estimator):
    def _fit(self, df: DataFrame) -> "DerivedFeaturesModel":
        return DerivedFeaturesModel(cut_lineage(fe.country_stats(df)))


class DerivedFeaturesModel(Model):
    def __init__(self, stats: DataFrame):
        super().__init__()
        self.stats = stats

    def _transform(self, df: DataFrame) -> DataFrame:
        return fe.derived_features(df, self.stats)


def scaled_array(params: dict):
    """The standardised cluster inputs as one array column (NULL -> 0)."""
    return F.array(*[((F.coalesce(F.col(c).cast("double"), dlit(0.0)) - dlit(p["mean"])) / dlit(p["std"]))
                     for c, p in params.items()])


def _id_col(k: int) -> str:
    return f"cluster_id_k{k}"


def _te_col(k: int, c: int) -> str:
    return f"cluster_te_k{k}_{c}"


class ClusterFeatures(Estimator):
    def __init__(self, cfg: RunConfig = RunConfig(), seed: int = SEED):
        super().__init__()
        self.cfg = cfg
        self.seed = seed

    def _fit(self, train: DataFrame) -> "ClusterFeaturesModel":
        cfg = self.cfg
        params = en.scaler_values(en.fit_scaler(train, CLUSTER_FEATURES).first())
        tr = cut_lineage(km.with_hash(train.select(F.lit(0).alias("k"), "id", "y", scaled_array(params).alias("_cz"))))
        fitted = km.fit_batched(tr, cfg.k_values, [self.seed], cfg.kmeans_starts, cfg.kmeans_max_iter)
        centres = {k: fitted[0, k, self.seed].centres.tolist() for k in cfg.k_values}
        tr = tr.drop("_h", "k")
        assigned = tr
        for k in cfg.k_values:
            assigned = en.nearest_centre(assigned, "_cz", centres[k], keep=assigned.columns,
                                         id_out=_id_col(k), dist_out=f"cluster_dist_k{k}")
        assigned = cut_lineage(assigned.drop("_cz"))
        maps, oof = {}, assigned.select("id")
        for k in cfg.k_values:
            key = _id_col(k)
            maps[k] = cut_lineage(en.target_encoding_map(assigned, key)
                                  .select(key, *[F.col(f"te{c}").alias(f"_m{c}") for c in CLASSES]))
            enc = en.oof_target_encoding(assigned.select("id", "y", key), key, seed=self.seed + INNER_FOLD_SEED_OFFSET,
                                         prefix=f"cluster_te_k{k}_")
            oof = oof.join(enc, "id")                    # one row per training id on both sides
        return ClusterFeaturesModel(params, centres, maps, cut_lineage(oof), en.global_shares(train))


class ClusterFeaturesModel(Model):
    def __init__(self, scaler: dict, centres: dict, maps: dict, train_oof: DataFrame, shares: list):
        super().__init__()
        self.scaler, self.centres, self.maps = scaler, centres, maps
        self.train_oof, self.shares = train_oof, shares

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_cz", scaled_array(self.scaler))
        for k, cen in self.centres.items():
            out = en.nearest_centre(out, "_cz", cen, keep=out.columns, id_out=_id_col(k),
                                    dist_out=f"cluster_dist_k{k}")
        out = out.drop("_cz").join(self.train_oof, "id", "left")        # training rows only
        for k, m in self.maps.items():
            key = _id_col(k)
            out = out.join(bounded_broadcast(m), key, "left")          # <= k rows
            out = out.withColumns({_te_col(k, c): F.coalesce(F.col(_te_col(k, c)), F.col(f"_m{c}"),
                                                             dlit(self.shares[c])) for c in CLASSES})
            out = out.drop(*[f"_m{c}" for c in CLASSES])
        return out
