"""Rolling-band time-series anomalies.

A centred row window over the whole series would run in one task. Instead each
row gets its global position (distributed row number), positions are cut into
buckets of ``bucket_rows``, and each bucket also receives the few rows of its
neighbours that its edge windows need (a halo of w//2 rows before and (w-1)//2
after). The window then runs per bucket, and the halo copies are dropped.
The result is exact for any bucket size larger than the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expressions import nan_to_null
from .order import row_number_global


def rolling_band(df: DataFrame, date_col: str, value_col: str, window: int = 14,
                 k: float = K.BAND_K, min_periods: int = K.ROLLING_MIN_PERIODS,
                 bucket_rows: int = 1_000_000, row_id: str = "row_id") -> DataFrame:
    """(row_id, date, value, rolling_mean, rolling_std, upper, lower, is_anomaly), sorted by date.

    Centred window of ``window`` rows (w//2 before, (w-1)//2 after); mean and
    sample std need ``min_periods`` non-null values; a missing std falls back to
    the global sample std; rows without a mean are not flagged.
    """
    before, after = window // 2, (window - 1) // 2
    ts = nan_to_null(df.select(row_id, F.col(date_col).cast("timestamp").alias(date_col),
                               F.col(value_col).cast("double").alias(value_col)))
    ranked = row_number_global(ts, [F.asc_nulls_last(date_col), F.asc(row_id)], "_pos")
    ranked = ranked.withColumn("_pos", F.col("_pos") - 1)
    bucket = F.floor(F.col("_pos") / bucket_rows).cast("long")
    offset = F.col("_pos") - bucket * bucket_rows
    home = ranked.withColumn("_bucket", bucket).withColumn("_home", F.lit(True))
    # halo: the first `after` rows of a bucket are needed by the previous bucket,
    # the last `before` rows by the next one
    to_prev = ranked.filter(offset < after).withColumn("_bucket", bucket - 1).withColumn("_home", F.lit(False))
    to_next = ranked.filter(offset >= bucket_rows - before).withColumn("_bucket", bucket + 1) \
        .withColumn("_home", F.lit(False))
    allrows = home.unionByName(to_prev).unionByName(to_next)
    w = Window.partitionBy("_bucket").orderBy("_pos").rowsBetween(-before, after)
    v = F.col(value_col)
    cnt = F.count(v).over(w)
    mean = F.when(cnt >= min_periods, F.avg(v).over(w))
    std = F.when(cnt >= min_periods, F.stddev_samp(v).over(w))
    global_std = ts.agg(F.stddev_samp(value_col)).first()[0]  # one scalar
    out = (allrows.withColumn("rolling_mean", mean).withColumn("_rstd", std)
           .filter("_home")
           .withColumn("rolling_std", F.coalesce(F.col("_rstd"), F.lit(global_std).cast("double"))))
    upper = F.col("rolling_mean") + F.lit(k) * F.col("rolling_std")
    lower = F.col("rolling_mean") - F.lit(k) * F.col("rolling_std")
    flag = F.coalesce((v > upper) | (v < lower), F.lit(False))
    return out.select(row_id, "_pos", date_col, value_col, "rolling_mean", "rolling_std",
                      upper.alias("upper"), lower.alias("lower"), flag.alias("is_anomaly")) \
        .withColumnRenamed("_pos", "position")


def band_points(band: DataFrame, date_col: str, value_col: str, row_id: str = "row_id") -> DataFrame:
    """The flagged points with value and expected (rolling mean) value."""
    return band.filter("is_anomaly").select(row_id, date_col, value_col,
                                            F.col("rolling_mean").alias("expected"))
