"""Reviewer feedback (B2-B6) over an append-only feedback table.

Table layout: signature string, preset string, row_id long, label int,
scores map<string,double>, note string, ts timestamp. Model statistics are a
derived aggregate of the stored table, so saving the same batch twice does not
change them (the stored rows are de-duplicated on (signature, row_id, label)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K

FEEDBACK_SCHEMA = ("signature string, preset string, row_id long, label int, "
                   "scores map<string,double>, note string, ts timestamp")


def signature_expr(filename: Column, n_rows: Column, columns: list[str]) -> Column:
    """First 16 hex digits of SHA-1 over filename, row count, then '|'+column for sorted columns."""
    tail = "".join("|" + c for c in sorted(columns))
    return F.substring(F.sha1(F.concat(filename.cast("string"), n_rows.cast("string"), F.lit(tail))), 1, 16)


def dataset_signature(spark, filename: str, n_rows: int, columns: list[str]) -> str:
    return spark.range(1).select(signature_expr(F.lit(filename), F.lit(n_rows), columns)).first()[0]


def insert(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """B2: the batch rows whose (signature, row_id, label) is not stored yet.

    Duplicates inside one batch are kept, as in the reference.
    """
    keys = ["signature", "row_id", "label"]
    return batch.join(existing.select(*keys).distinct(), keys, "left_anti")


def model_stats(feedback: DataFrame) -> DataFrame:
    """Per (preset, model): TP / FP / TN / FN with flagged = percentile score >= 0.7."""
    ex = (feedback.select("preset", "label", F.explode("scores").alias("model_key", "score"))
          .filter(F.col("model_key") != "ensemble"))
    flagged = F.col("score") >= K.FEEDBACK_FLAG_THRESHOLD
    pos = F.col("label") == 1
    return ex.groupBy("preset", "model_key").agg(
        F.count_if(pos & flagged).alias("true_positive"),
        F.count_if(~pos & flagged).alias("false_positive"),
        F.count_if(~pos & ~flagged).alias("true_negative"),
        F.count_if(pos & ~flagged).alias("false_negative"),
        F.coalesce(F.sum(F.when(pos & flagged, F.col("score"))), F.lit(0.0)).alias("score_sum_tp"),
        F.coalesce(F.sum(F.when(~pos & flagged, F.col("score"))), F.lit(0.0)).alias("score_sum_fp"))


def derived_weights(stats: DataFrame, preset: str, base_weights: dict | None = None,
                    min_observations: int = 10) -> DataFrame:
    """Weight x (0.5 + TP / (TP + FP)), 3 dp half-even, when TP + FP >= min_observations."""
    spark = stats.sparkSession
    base = base_weights if base_weights is not None else K.PRESETS[preset]["model_weights"]
    bw = spark.createDataFrame([(k, float(v)) for k, v in base.items()] or [("", 1.0)],
                               "model_key string, base_weight double").filter(F.col("model_key") != "")
    st = stats.filter(F.col("preset") == preset).select("model_key", "true_positive", "false_positive")
    obs = F.col("true_positive") + F.col("false_positive")
    adjusted = F.bround(F.coalesce(F.col("base_weight"), F.lit(1.0))
                        * (F.lit(0.5) + F.col("true_positive") / obs), 3)
    return (bw.join(st, "model_key", "full")
            .select("model_key", F.when(obs >= min_observations, adjusted)
                    .otherwise(F.col("base_weight")).alias("weight"))
            .filter(F.col("weight").isNotNull()))


def latest_labels(feedback: DataFrame, signature: str | None = None) -> DataFrame:
    """The last label stored for each row (by timestamp; of equal ones the larger label)."""
    fb = feedback if signature is None else feedback.filter(F.col("signature") == signature)
    return fb.groupBy("signature", "row_id").agg(F.max_by("label", F.struct("ts", "label")).alias("label"))


def totals(labels: DataFrame) -> DataFrame:
    """Total labelled rows, marked anomaly, marked normal."""
    return labels.agg(F.count(F.lit(1)).alias("total"),
                      F.count_if(F.col("label") == 1).alias("anomalies"),
                      F.count_if(F.col("label") == 0).alias("normals"))
