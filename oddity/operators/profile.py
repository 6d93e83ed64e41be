"""Column catalog, value frequencies and column profiling.

Per-column statistics come from one long ``value_freq`` frame, (column, value, n),
built with a single unpivot + ``groupBy``; the count is combined map-side, so a
value held by a third of the rows is one row per task before the shuffle. This
replaces one ``count_distinct`` per column, which would expand rows x columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.expressions import nan_to_null, word_count
from .ensemble import grouped_distribution, grouped_quantile

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType, T.BooleanType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def data_columns(df: DataFrame, row_id: str = "row_id") -> list[str]:
    return [c for c in df.columns if c != row_id]


def is_numeric_type(dt) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_datetime_type(dt) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def catalog_rows(df: DataFrame, columns: list[str] | None = None, row_id: str = "row_id") -> list[dict]:
    """Schema metadata per column (driver side; one entry per column, not per row)."""
    cols = columns or data_columns(df, row_id)
    types = {f.name: f.dataType for f in df.schema.fields}
    return [{"position": i, "column": c, "is_numeric": is_numeric_type(types[c]),
             "is_datetime": is_datetime_type(types[c]),
             "dtype": types[c].simpleString()} for i, c in enumerate(cols)]


def catalog_frame(df: DataFrame, columns: list[str] | None = None, row_id: str = "row_id") -> DataFrame:
    rows = catalog_rows(df, columns, row_id)
    schema = "position int, column string, is_numeric boolean, is_datetime boolean, dtype string"
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], schema)


def long_values(df: DataFrame, columns: list[str], row_id: str = "row_id",
                keep_row_id: bool = True) -> DataFrame:
    """Unpivot to (row_id, column, value) with every value as text."""
    ids = [row_id] if keep_row_id else []
    base = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns])
    if not ids:
        base = base.withColumn("_rid", F.lit(0))
        ids = ["_rid"]
    out = base.unpivot(ids, columns, "column", "value")
    return out if keep_row_id else out.drop("_rid")


def value_freq(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """(column, value, n): value counts per column; null is a value of its own."""
    return (long_values(df, columns, row_id, keep_row_id=False)
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def digests(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with 128-bit digests in place of texts, so that counting distinct values moves no text."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    two = lambda c: F.concat_ws(":", F.xxhash64(c), F.xxhash64(F.lit(1), c))
    return df.select(*[F.when(F.col(c).isNotNull(), two(F.col(c))).alias(c) if c in text else F.col(c) for c in columns])


def column_stats(df: DataFrame, columns: list[str] | None = None, row_id: str = "row_id",
                 freq: DataFrame | None = None) -> DataFrame:
    """Per column: rows, non-null, missing, distinct non-null values."""
    df = nan_to_null(df)
    cols = columns or data_columns(df, row_id)
    freq = freq if freq is not None else value_freq(digests(df, cols), cols, row_id)
    return (freq.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("n_distinct")))


def leading_rows(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    """The rows up to the ``n``-th in row order, with all that share its place; the whole frame if it has fewer.

    The place comes to the driver, so that of the other rows only the row id is read.
    """
    place = df.select(row_id).orderBy(row_id).limit(n).agg(F.count(F.lit(1)).alias("n"), F.max(row_id).alias("last")).first()
    if place["n"] < n:
        return df
    before = F.col(row_id).isNull()  # nulls come first
    return df.filter(before if place["last"] is None else before | (F.col(row_id) <= F.lit(place["last"])))


def first_non_null(df: DataFrame, columns: list[str], n: int, row_id: str = "row_id") -> DataFrame:
    """The first ``n`` non-null values of each column in row order: (row_id, column, value, rn).

    Most columns have them in the leading rows. Each of the others is one top-n over all rows, in
    which a task holds n values and sorts none of the rest.
    """
    head = leading_rows(df, 2 * n, row_id)
    held = head.agg(*[F.count(c).alias(c) for c in columns]).first().asDict() if head is not df else {}
    sparse = [c for c in columns if held.get(c, n) < n]
    dense = [c for c in columns if c not in sparse]
    parts = [long_values(head, dense, row_id).filter(F.col("value").isNotNull())] if dense else []
    for c in sparse:
        values = df.select(row_id, F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        # ordered by null or not: a filter before the limit would compute each value twice
        parts.append(values.orderBy(F.col("value").isNull(), row_id).limit(n).filter(F.col("value").isNotNull()))
    w = Window.partitionBy("column").orderBy(row_id)
    return (reduce(DataFrame.unionByName, parts)
            .withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") <= n))


def dataset_metrics(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Row count, column count, missing cells (one aggregate pass)."""
    cols = data_columns(df, row_id)
    missing = sum((F.sum(F.col(c).isNull().cast("long")) for c in cols), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(cols)).alias("n_columns"),
                  missing.cast("long").alias("missing_cells"))


def preview(df: DataFrame, n: int = 100, row_id: str = "row_id") -> DataFrame:
    """The first ``n`` rows in row order (a top-n, planned as TakeOrderedAndProject)."""
    return df.orderBy(row_id).limit(n)


def kind_review(df: DataFrame, kinds: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Kind, first non-null value and missing % (1 dp, half-even) per column."""
    cols = data_columns(df, row_id)
    firsts = (long_values(df, cols, row_id).filter(F.col("value").isNotNull())
              .groupBy("column").agg(F.min_by("value", row_id).alias("first_value")))
    stats = column_stats(df, cols, row_id)
    return (kinds.select("column", "position", "kind")
            .join(stats, "column").join(firsts, "column", "left")
            .select("position", "column", "kind",
                    F.coalesce("first_value", F.lit("")).alias("first_value"),
                    F.bround(F.col("missing") / F.greatest(F.col("n_rows"), F.lit(1)) * 100, 1)
                    .alias("missing_pct")))


def summary_stats(df: DataFrame, columns: list[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """Dtype, missing, distinct and ``describe()`` statistics of numeric columns.

    One aggregate over the typed columns; quartiles are exact with linear
    interpolation, as pandas computes them.
    """
    cols = columns or [c for c in data_columns(df, row_id)
                       if is_numeric_type(df.schema[c].dataType)
                       and not isinstance(df.schema[c].dataType, T.BooleanType)]
    df = nan_to_null(df)
    parts = []
    for c in cols:
        x = F.col(c).cast("double")
        parts.append(F.struct(
            F.lit(c).alias("column"),
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.sum(x.isNull().cast("long")).alias("missing"),
        ).alias(c))
    wide = df.agg(*parts)
    stats = wide.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("s")).select("s.*")
    # quartiles from the counted distinct values of each column, at any size
    long = (df.select(*[F.col(c).cast("double").alias(c) for c in cols]).withColumn("_k", F.lit(0))
            .unpivot(["_k"], cols, "column", "value"))
    dist = grouped_distribution(long, "column", "value")
    for p in (0.25, 0.5, 0.75):
        stats = stats.join(grouped_quantile(dist, p, "column", "value", f"q{int(p * 100)}"), "column", "left")
    stats = stats.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max", "missing")
    distinct = column_stats(df, cols, row_id).select("column", "n_distinct")
    types = catalog_frame(df, cols, row_id).select("column", "dtype")
    return stats.join(distinct, "column").join(types, "column")


def column_quality(df: DataFrame, columns: list[str] | None = None, row_id: str = "row_id",
                   freq: DataFrame | None = None) -> DataFrame:
    """P5: distinct count and ratio, missing, flags, reasons and the recommendation."""
    cols = columns or data_columns(df, row_id)
    cat = catalog_frame(df, cols, row_id)
    stats = column_stats(df, cols, row_id, freq)
    # numbers and times never read as more than three words
    text = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    q = cat.join(stats, "column")
    if text:
        words = (first_non_null(df, text, K.FREE_TEXT_SAMPLE, row_id)
                 .groupBy("column").agg(F.avg(word_count(F.col("value"))).alias("avg_words")))
        q = q.join(words, "column", "left")
    else:
        q = q.withColumn("avg_words", F.lit(None).cast("double"))
    q = (q
         .withColumn("ratio", F.when(F.col("n_rows") > 0, F.col("n_distinct") / F.col("n_rows"))
                     .otherwise(F.lit(0.0))))
    constant = F.col("n_distinct") <= 1
    id_like = F.when(F.col("is_numeric"), F.col("ratio") > K.ID_RATIO_NUMERIC) \
        .otherwise(F.col("ratio") > K.ID_RATIO_OTHER)
    free_text = (~F.col("is_numeric")) & (F.col("n_distinct") > 1) \
        & (F.coalesce(F.col("avg_words"), F.lit(0.0)) > 3)
    high_card = (~F.col("is_numeric")) & (F.col("n_distinct") > 50) & ~id_like
    flags = F.concat_ws(", ", F.when(constant, F.lit("constant")), F.when(id_like, F.lit("id_like")),
                        F.when(free_text, F.lit("free_text")),
                        F.when(high_card, F.lit("high_cardinality")))
    reasons = F.concat_ws(
        " | ",
        F.when(constant, F.lit(K.QUALITY_FLAG_REASONS["constant"])),
        F.when(id_like, F.lit(K.QUALITY_FLAG_REASONS["id_like"])),
        F.when(free_text, F.lit(K.QUALITY_FLAG_REASONS["free_text"])),
        F.when(high_card, F.lit(K.QUALITY_FLAG_REASONS["high_cardinality"])))
    return q.select(
        "position", "column", "dtype", "is_numeric", "is_datetime",
        F.col("n_distinct").alias("unique"),
        F.bround(F.col("ratio"), 3).alias("unique_ratio"),
        F.col("missing"),
        F.when(F.col("n_rows") > 0, F.bround(F.col("missing") / F.col("n_rows") * 100, 1))
        .otherwise(F.lit(0.0)).alias("missing_pct"),
        constant.alias("constant"), id_like.alias("id_like"), free_text.alias("free_text"),
        high_card.alias("high_cardinality"),
        F.when(flags == "", F.lit("-")).otherwise(flags).alias("flags"),
        reasons.alias("flag_reasons"),
        (~id_like & ~constant & ~free_text).alias("recommended"))


def id_columns(quality: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """ID columns = name pattern OR id_like flag (OR kind ID when kinds are given), sorted."""
    by_name = quality.filter(F.col("column").rlike("(?i)" + K.ID_SELECT_NAME_RE) | F.col("id_like")) \
        .select("column")
    if kinds is not None:
        by_name = by_name.unionByName(kinds.filter(F.col("kind") == K.KIND_ID).select("column"))
    return by_name.distinct().orderBy("column")


def safe_columns(quality: DataFrame, first_n: int | None = None) -> DataFrame:
    """Recommended columns in column order (optionally the first n, as the old view did)."""
    out = quality.filter("recommended").select("position", "column").orderBy("position")
    return out.limit(first_n) if first_n else out


def balanced_selection(quality: DataFrame, ids: DataFrame, max_columns: int = K.MAX_SELECTED_COLUMNS,
                       max_high_card_cat: int = K.MAX_MEDIUM_CARD) -> DataFrame:
    """Walk the columns in order and decide include/skip with a reason.

    Running counts over the (small) catalog replace the loop: the medium-card
    count and the selected count are window sums in column order.
    """
    q = quality.join(ids.withColumn("_is_id", F.lit(True)), "column", "left") \
        .withColumn("_is_id", F.coalesce("_is_id", F.lit(False)))
    R = K.SELECTION_REASONS
    skip_reason = (F.when(F.col("_is_id"), F.lit(R["id"]))
                   .when(F.col("constant"), F.lit(R["constant"]))
                   .when(F.col("id_like"), F.lit(R["id_like"]))
                   .when(F.col("free_text"), F.lit(R["free_text"])))
    medium = skip_reason.isNull() & ~F.col("is_numeric") & ~F.col("is_datetime") \
        & (F.col("unique") > K.LOW_CARD_LIMIT) & (F.col("unique") <= K.MEDIUM_CARD_LIMIT)
    w_before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    q = q.withColumn("_medium", medium) \
        .withColumn("_medium_before", F.coalesce(F.sum(F.col("_medium").cast("int")).over(w_before), F.lit(0)))
    reason = (F.when(skip_reason.isNotNull(), skip_reason)
              .when(F.col("is_numeric"), F.lit(R["numeric"]))
              .when(F.col("is_datetime"), F.lit(R["datetime"]))
              .when(F.col("unique") <= K.LOW_CARD_LIMIT, F.lit(R["low_card"]))
              .when(F.col("_medium") & (F.col("_medium_before") < max_high_card_cat), F.lit(R["mid_card_in"]))
              .when(F.col("_medium"), F.lit(R["mid_card_out"]))
              .otherwise(F.replace(F.lit(R["high_card"]), F.lit("{n}"), F.col("unique").cast("string"))))
    included = skip_reason.isNull() & (
        F.col("is_numeric")
        | (~F.col("is_datetime") & (F.col("unique") <= K.LOW_CARD_LIMIT))
        | (F.col("_medium") & (F.col("_medium_before") < max_high_card_cat)))
    # The walk stops only right after a categorical column has been handled with
    # the selection full; numerics and skipped columns never trigger the stop.
    w_through = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    categorical_branch = skip_reason.isNull() & ~F.col("is_numeric") & ~F.col("is_datetime")
    q = q.withColumn("_inc", included).withColumn("_reason", reason)
    q = q.withColumn("_sel_through", F.sum(F.col("_inc").cast("int")).over(w_through))
    q = q.withColumn("_stop_pos", F.min(F.when(categorical_branch & (F.col("_sel_through") >= max_columns),
                                               F.col("position"))).over(Window.partitionBy()))
    over_limit = F.coalesce(F.col("position") > F.col("_stop_pos"), F.lit(False))
    return q.select(
        "position", "column",
        (F.col("_inc") & ~over_limit).alias("included"),
        F.when(over_limit, F.lit(R["limit"].format(max_columns=max_columns)))
        .otherwise(F.col("_reason")).alias("reason"))


def combo_eligible(quality: DataFrame, selected: list[str]) -> DataFrame:
    """P10: selected, non-numeric columns with at most 200 distinct values."""
    return (quality.filter(F.col("column").isin(*selected) & ~F.col("is_numeric")
                           & (F.col("unique") <= K.MEDIUM_CARD_LIMIT))
            .select("position", "column", "unique"))
