"""Percentile ranks, quantile thresholds and the weighted rank ensemble (M4, M7-M9).

Scores are kept long: (row_id, model_key, score). Ranks and thresholds come
from a per-model score distribution (one row per distinct score, counted
map-side), so a score shared by a third of the rows is one row, and no step
sorts all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .order import known_scores, prefix_sum, select_quantiles


def grouped_distribution(scores: DataFrame, group: str = "model_key", score: str = "score") -> DataFrame:
    """(group, score, cnt, before, n): ``before`` rows of the group have a smaller score; missing scores are left out."""
    counts = known_scores(scores, score).groupBy(group, score).agg(F.count(F.lit(1)).alias("cnt"))
    cum = prefix_sum(counts, [group, score], "cnt", "_before_all")
    start = cum.groupBy(group).agg(F.min("_before_all").alias("_start"), F.sum("cnt").alias("n"))
    return (cum.join(F.broadcast(start), group)  # one row per group
            .select(group, score, "cnt", (F.col("_before_all") - F.col("_start")).alias("before"), "n"))


def grouped_quantile(dist: DataFrame, p: float, group: str = "model_key", score: str = "score",
                     out: str = "threshold") -> DataFrame:
    """Exact numpy-style (linear) quantile per group, from the distribution alone."""
    h = (F.col("n") - 1) * F.lit(p)
    lo = F.floor(h)
    hi = F.least(lo + 1, F.col("n") - 1)
    d = dist.withColumn("_h", h).withColumn("_lo", lo).withColumn("_hi", hi)
    holds_lo = (F.col("before") <= F.col("_lo")) & (F.col("before") + F.col("cnt") > F.col("_lo"))
    holds_hi = (F.col("before") <= F.col("_hi")) & (F.col("before") + F.col("cnt") > F.col("_hi"))
    picked = d.filter(holds_lo | holds_hi).groupBy(group).agg(
        F.max(F.when(holds_lo, F.col(score))).alias("_xlo"),
        F.max(F.when(holds_hi, F.col(score))).alias("_xhi"),
        F.first("_h").alias("_h"), F.first("_lo").alias("_lo"))
    return picked.select(group, (F.col("_xlo") + (F.col("_h") - F.col("_lo")) * (F.col("_xhi") - F.col("_xlo")))
                         .alias(out))


def percentile_ranks(scores: DataFrame, group: str = "model_key", score: str = "score",
                     row_id: str = "row_id", dist: DataFrame | None = None) -> DataFrame:
    """M7 per group: (row_id, group, score, pct) with pct = average rank / n; null for a missing score."""
    dist = dist if dist is not None else grouped_distribution(scores, group, score)
    pct = dist.select(group, score, ((F.col("before") + (F.col("cnt") + 1) / 2.0) / F.col("n")).alias("pct"))
    return scores.join(pct, [group, score], "left")


def ensemble(scores: DataFrame, contamination: float = 0.05, weights: dict | None = None,
             row_id: str = "row_id") -> DataFrame:
    """M8 + M9: (row_id, ensemble_score, any_top, pct_<model>, top_<model>).

    ``scores`` holds only successful models. ensemble = sum(w * pct) / sum(w);
    any_top = the row is at or above the (1 - c) quantile of at least one model.
    """
    spark = scores.sparkSession
    dist = grouped_distribution(scores)  # built on a checkpoint
    thr = grouped_quantile(dist, 1.0 - contamination)
    wt = spark.createDataFrame([(k, float(v)) for k, v in (weights or {}).items()] or [("", 1.0)],
                               "model_key string, weight double")
    ranked = (percentile_ranks(scores, dist=dist)
              .join(F.broadcast(thr), "model_key", "left")  # one row per model
              .join(F.broadcast(wt), "model_key", "left")
              .withColumn("weight", F.coalesce("weight", F.lit(1.0)))
              .withColumn("top", F.coalesce((F.col("score") >= F.col("threshold")) & ~F.isnan("score"), F.lit(False))))
    models = [r[0] for r in scores.select("model_key").distinct().collect()]  # at most a few keys
    models = sorted(models, key=lambda m: (K.MODEL_KEYS.index(m) if m in K.MODEL_KEYS else 99, m))
    # a row that a model gives no score has no ensemble score, as a sum with a missing rank has none
    agg = [F.when(F.count("pct") == F.count(F.lit(1)), F.sum(F.col("weight") * F.col("pct")) / F.sum("weight"))
           .alias("ensemble_score"),
           F.bool_or("top").alias("any_top")]
    for m in models:
        agg.append(F.max(F.when(F.col("model_key") == m, F.col("pct"))).alias(f"pct_{m}"))
        agg.append(F.bool_or(F.when(F.col("model_key") == m, F.col("top"))).alias(f"top_{m}"))
    return ranked.groupBy(row_id).agg(*agg)


def model_thresholds(scores: DataFrame, contamination: float) -> DataFrame:
    """M4 per model: (model_key, threshold)."""
    found = select_quantiles(scores, 1.0 - contamination, "model_key", "score")  # a value for each model
    return scores.sparkSession.createDataFrame(list(found.items()), "model_key string, threshold double")


def quantile_label_frame(scores: DataFrame, contamination: float, row_id: str = "row_id") -> DataFrame:
    """M4 per model: (row_id, model_key, score, label)."""
    thr = model_thresholds(scores, contamination)
    return (scores.join(F.broadcast(thr), "model_key", "left")
            .withColumn("label", F.coalesce((F.col("score") >= F.col("threshold")) & ~F.isnan("score"), F.lit(False))
                        .cast("int")).drop("threshold"))
