"""Ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import row_number_global


def ranked(df: DataFrame, score: str = "score", row_id: str = "row_id", out: str = "rank") -> DataFrame:
    """Rank 1..n by score descending; ties broken by row id. Distributed (no single-task window)."""
    return row_number_global(df, [F.desc(score), F.asc(row_id)], out)


def top_n(df: DataFrame, n: int = 20, score: str = "score", row_id: str = "row_id") -> DataFrame:
    """R2: the first n rows by rank (a distributed TakeOrderedAndProject)."""
    return df.orderBy(F.desc(score), F.asc(row_id)).limit(n)


def result_metrics(df: DataFrame, threshold: float, score: str = "score",
                   any_top: str | None = None) -> DataFrame:
    """Total, suspicious (score >= threshold), share in %, any-of-top count."""
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(F.col(score) >= F.lit(threshold)).alias("suspicious")]
    if any_top:
        aggs.append(F.count_if(F.col(any_top)).alias("any_top_count"))
    out = df.agg(*aggs)
    return out.withColumn("suspicious_share", F.col("suspicious") / F.col("total") * 100)


def score_histogram(df: DataFrame, bins: int = 50, score: str = "score") -> DataFrame:
    """Equal-width bins between min and max; the maximum falls in the last bin."""
    bounds = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()  # two scalars
    b = df.withColumn("lo", F.lit(bounds["lo"]).cast("double")).withColumn("hi", F.lit(bounds["hi"]).cast("double"))
    pos = F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1
    b = b.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(pos, F.lit(bins)))
                     .otherwise(F.lit(1)).cast("long"))
    return (b.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
            .select("bin",
                    (F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_lo"),
                    (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_hi"),
                    "count"))


def id_first(df: DataFrame, id_cols: list[str], score: str = "score", rank: str = "rank") -> DataFrame:
    """ID columns, score, rank, then every other column."""
    rest = [c for c in df.columns if c not in id_cols and c not in (score, rank)]
    return df.select(*id_cols, score, rank, *rest)


def rescore_delta(old: DataFrame, new: DataFrame, old_threshold: float, new_threshold: float,
                  score: str = "score") -> DataFrame:
    """Suspicious count after re-scoring minus before (two one-row aggregates)."""
    a = old.agg(F.count_if(F.col(score) >= F.lit(old_threshold))).first()[0]
    b = new.agg(F.count_if(F.col(score) >= F.lit(new_threshold)).alias("new_suspicious"))
    return (b.withColumn("old_suspicious", F.lit(a).cast("long"))
            .select("old_suspicious", "new_suspicious",
                    (F.col("new_suspicious") - F.col("old_suspicious")).alias("delta")))
