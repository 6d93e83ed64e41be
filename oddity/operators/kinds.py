"""Column kinds and type coercion.

Content tests read only the first 500 / 200 / 50 non-null values of each
column, one long frame held in a checkpoint, and one grouped aggregate; kind
inference is a CASE chain over the per-column catalog.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.dates import infer_format, is_date_text, parse_each, parse_with, to_timestamp
from ..functions.expressions import (clean_numeric_text, is_id_kind_name, name_has_hint, parse_cleaned_number,
                                     py_strip, to_number)
from ..session import checkpoint
from .profile import (catalog_frame, column_stats, data_columns, first_non_null,
                      is_datetime_type, is_numeric_type, leading_rows)

#: Parts in which the failing values of a column are sorted.
SAMPLE_PARTS = 64


def date_shares(sample: DataFrame, least_digit_share: float = 0.0) -> DataFrame:
    """(column, n_dates): values of the long sample (column, rn, value) that parse as dates.

    Each column has the format that its first value shows; the values that the formats are taken
    from, one a column, come to the driver. A column without a format is read value by value, one
    with digits in too few of its values not at all.
    """
    dated = F.when(is_date_text(F.col("value")), F.col("rn"))
    rows = sample.groupBy("column").agg(F.min_by("value", dated).alias("first"),
                                        F.avg(F.col("value").rlike(r"\d").cast("double")).alias("digits")).collect()
    firsts = {r["column"]: r["first"] for r in rows if r["first"] is not None and r["digits"] >= least_digit_share}
    by_format: dict = {}
    for c, first in sorted(firsts.items()):
        by_format.setdefault(infer_format(first), []).append(c)
    free = by_format.pop(None, [])
    parts = []
    if by_format:
        parsed = F.coalesce(*[F.when(F.col("column").isin(cs), parse_with(F.col("value"), fmt)) for fmt, cs in by_format.items()])
        parts.append(sample.where(F.col("column").isin([c for cs in by_format.values() for c in cs])).select("column", parsed.alias("t")))
    if free:
        parts.append(sample.where(F.col("column").isin(free)).select("column", parse_each(F.col("value")).alias("t")))
    if not parts:
        return sample.groupBy("column").agg(F.lit(0).cast("long").alias("n_dates"))
    return reduce(DataFrame.union, parts).groupBy("column").agg(F.count("t").alias("n_dates"))


def first_values(df: DataFrame, columns: list[str], row_id: str = "row_id") -> dict:
    """First value of each column that is not missing as date text (one small aggregate; one value per column)."""
    if not columns:
        return {}
    text = lambda c: F.col(c).cast("string")
    read = lambda rows, cs: rows.agg(*[F.min_by(text(c), F.when(is_date_text(text(c)), F.col(row_id))).alias(c)
                                       for c in cs]).first().asDict()
    head = leading_rows(df, K.NUMERIC_CONTENT_SAMPLE, row_id)
    found = read(head, columns)
    late = [c for c in columns if found[c] is None and head is not df]
    return found | read(df, late) if late else found


def coerce_report(df: DataFrame, columns: list[str], converter, already_typed, row_id: str = "row_id"):
    """Shared body of T2 / T3: (converted frame, report frame).

    Whatever the number of columns, the report is one count of the values that are not null and one
    count by failing value, in which each value is converted once. A converter leaves null null. The
    failing values are sorted in many parts a column.
    """
    new = {c: converter(df, c) for c in columns if not already_typed(df.schema[c].dataType)}
    converted = df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])
    schema = "column string, converted long, failed long, non_null_original long, " \
             "failed_samples string, already_typed boolean"
    if not columns:
        return converted, df.sparkSession.createDataFrame([], schema)
    given = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.col(c)).alias("non_null_original"), F.lit(c not in new).alias("already_typed"))
                             for c in columns]).alias("r")).select(F.inline("r"))
    if not new:
        return converted, given.select("column", F.col("non_null_original").alias("converted"), F.lit(0).cast("long").alias("failed"),
                                       "non_null_original", F.lit("").alias("failed_samples"), "already_typed")
    was = {c: F.col(c).cast("string") for c in new}
    bad = [F.when(was[c].isNotNull() & new[c].isNull(), F.struct(F.lit(c).alias("column"), was[c].alias("v"))) for c in new]
    values = (df.select(row_id, F.array(*bad).alias("b")).select(row_id, F.explode(F.filter("b", lambda x: x.isNotNull())).alias("b"))
              .groupBy("b.column", "b.v").agg(F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("n"))
              .withColumn("_part", F.pmod(F.xxhash64("v"), F.lit(SAMPLE_PARTS))))
    # the first five of each part hold the first five of the column
    ranked = values.withColumn("_r", F.row_number().over(Window.partitionBy("column", "_part").orderBy("_first", "v")))
    failed = ranked.groupBy("column").agg(
        F.sum("n").alias("failed"), F.sort_array(F.collect_list(F.when(F.col("_r") <= 5, F.struct("_first", "v")))).alias("_v"))
    lost = F.coalesce("failed", F.lit(0))
    return converted, given.join(failed, "column", "left").select(
        "column", (F.col("non_null_original") - lost).alias("converted"), lost.alias("failed"), "non_null_original",
        F.coalesce(F.array_join(F.transform(F.slice("_v", 1, 5), lambda x: x["v"]), " | "), F.lit("")).alias("failed_samples"),
        "already_typed")


def auto_numeric_columns(df: DataFrame, row_id: str = "row_id",
                         threshold: float = K.NUMERIC_CONTENT_SHARE) -> list[str]:
    """T2 auto-pick: text columns with a numeric name hint, or >= 85 % of the first 500 parse."""
    cols = [c for c in data_columns(df, row_id) if not is_numeric_type(df.schema[c].dataType)]
    picked = [c for c in cols if not is_id_kind_name(c) and name_has_hint(c, K.NUMERIC_NAME_HINTS)]
    rest = [c for c in cols if not is_id_kind_name(c) and c not in picked]
    if rest:
        sample = first_non_null(df, rest, K.NUMERIC_CONTENT_SAMPLE, row_id)
        share = (sample.groupBy("column")
                 .agg((F.count(to_number(F.col("value"))) / F.count(F.lit(1))).alias("share"))
                 .filter(F.col("share") >= threshold).select("column").collect())
        ok = {r["column"] for r in share}
        picked += [c for c in rest if c in ok]
    order = data_columns(df, row_id)
    return sorted(picked, key=order.index)


def coerce_numeric(df: DataFrame, columns: list[str] | None = None, row_id: str = "row_id"):
    """Convert text columns to double with a per-column report."""
    cols = columns if columns is not None else auto_numeric_columns(df, row_id)
    return coerce_report(df, cols, lambda d, c: to_number(F.col(c)), is_numeric_type, row_id)


def coerce_datetime(df: DataFrame, columns: list[str], row_id: str = "row_id"):
    """Convert text columns to timestamps (format from the first value) with a report."""
    text_cols = [c for c in columns if not is_datetime_type(df.schema[c].dataType)]
    firsts = first_values(df, text_cols, row_id)

    def convert(d, c):
        if is_numeric_type(d.schema[c].dataType):  # nanoseconds since 1970
            return F.timestamp_micros(F.floor(F.col(c) / 1000))
        return to_timestamp(F.col(c), firsts.get(c))
    return coerce_report(df, columns, convert, is_datetime_type, row_id)


def content_tests(df: DataFrame, columns: list[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """T4 + T5 per column: looks_numeric (first 500) and looks_datetime (first 200)."""
    cols = columns or data_columns(df, row_id)
    sample = checkpoint(first_non_null(df, cols, K.NUMERIC_CONTENT_SAMPLE, row_id).coalesce(8))  # read three times
    raw = py_strip(F.col("value"))
    in200 = F.col("rn") <= K.DATETIME_CONTENT_SAMPLE
    agg = sample.groupBy("column").agg(
        F.count(F.lit(1)).alias("n500"),
        F.count(parse_cleaned_number(clean_numeric_text(F.col("value")))).alias("n_parse"),
        F.avg(raw.rlike(r"[.,]\d").cast("double")).alias("decimal_share"),
        F.max(raw.startswith("-")).alias("any_negative"),
        F.avg(raw.rlike(r"^0\d").cast("double")).alias("leading_zero_share"),
        F.count_distinct(F.length(raw)).alias("n_lengths"),
        F.min_by(F.length(raw), F.col("rn")).alias("first_length"),
        F.sum(in200.cast("long")).alias("n200"),
        F.sum((in200 & F.col("value").rlike(r"\d")).cast("long")).alias("n200_digit"),
    )
    # second pass over the <=200 rows per column: parse with the column's format
    t = agg.join(date_shares(sample.filter(in200), 0.5), "column", "left")
    parse_share = F.col("n_parse") / F.col("n500")
    looks_numeric = F.when(parse_share < K.NUMERIC_CONTENT_SHARE, F.lit(False)) \
        .when((F.col("decimal_share") > 0.05) | F.col("any_negative"), F.lit(True)) \
        .when((F.col("leading_zero_share") > 0.05)
              | ((F.col("n_lengths") <= 2) & (F.col("first_length") >= 4)), F.lit(False)) \
        .otherwise(F.lit(True))
    looks_datetime = (F.col("n200_digit") / F.col("n200") >= 0.5) & \
        (F.coalesce(F.col("n_dates"), F.lit(0)) / F.col("n200") >= K.DATETIME_CONTENT_SHARE)
    return t.select("column", looks_numeric.alias("looks_numeric"), looks_datetime.alias("looks_datetime"))


def infer_kinds(df: DataFrame, row_id: str = "row_id", preset_hints=()) -> DataFrame:
    """(position, column, kind) with the reference precedence, plus preset hints."""
    cols = data_columns(df, row_id)
    spark = df.sparkSession
    names = spark.createDataFrame(
        [(c, name_has_hint(c, K.NUMERIC_NAME_HINTS), name_has_hint(c, K.DATETIME_NAME_HINTS),
          is_id_kind_name(c), bool(preset_hints) and name_has_hint(c, preset_hints)) for c in cols],
        "column string, hint_num boolean, hint_dt boolean, id_name boolean, hint_preset boolean")
    stats = column_stats(df, cols, row_id)
    text_cols = [c for c in cols if not is_numeric_type(df.schema[c].dataType)
                 and not is_datetime_type(df.schema[c].dataType)]
    cat = catalog_frame(df, cols, row_id).join(names, "column").join(stats, "column")
    if text_cols:
        cat = cat.join(content_tests(df, text_cols, row_id), "column", "left")
    else:
        cat = cat.withColumn("looks_numeric", F.lit(None).cast("boolean")) \
            .withColumn("looks_datetime", F.lit(None).cast("boolean"))
    ratio = F.when(F.col("n_rows") > 0, F.col("n_distinct") / F.col("n_rows")).otherwise(F.lit(0.0))
    kind = (F.when(F.col("n_distinct") <= 1, F.lit(K.KIND_EXCLUDED))
            .when(F.col("is_numeric"), F.lit(K.KIND_NUMERIC))
            .when(F.col("is_datetime"), F.lit(K.KIND_DATETIME))
            .when(F.col("hint_num"), F.lit(K.KIND_NUMERIC))
            .when(F.col("hint_dt"), F.lit(K.KIND_DATETIME))
            .when(F.col("id_name"), F.lit(K.KIND_ID))
            .when(F.coalesce("looks_numeric", F.lit(False)), F.lit(K.KIND_NUMERIC))
            .when(F.coalesce("looks_datetime", F.lit(False)), F.lit(K.KIND_DATETIME))
            .when(ratio > K.ID_RATIO_KIND, F.lit(K.KIND_ID))
            .otherwise(F.lit(K.KIND_CATEGORICAL)))
    kind = F.when((kind == K.KIND_CATEGORICAL) & F.col("hint_preset"), F.lit(K.KIND_NUMERIC)).otherwise(kind)
    return cat.select("position", "column", kind.alias("kind"))


def apply_kinds(df: DataFrame, kinds: dict, row_id: str = "row_id"):
    """Numeric -> T2, datetime -> T3, categorical -> text; ID / excluded untouched.

    Returns (typed frame, report frame); the casts are one projection.
    """
    num = [c for c, k in kinds.items() if k == K.KIND_NUMERIC]
    dt = [c for c, k in kinds.items() if k == K.KIND_DATETIME]
    out, rep_n = coerce_numeric(df, num, row_id)
    out, rep_d = coerce_datetime(out, dt, row_id)
    for c, k in kinds.items():
        if k == K.KIND_CATEGORICAL:
            out = out.withColumn(c, F.col(c).cast("string"))
    report = rep_n.withColumn("kind", F.lit(K.KIND_NUMERIC)).unionByName(
        rep_d.withColumn("kind", F.lit(K.KIND_DATETIME)))
    return out, report


def column_type_split(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Numeric / categorical / datetime by type; a text column whose first 50
    non-null values parse as dates more than 80 % of the time counts as datetime."""
    cols = data_columns(df, row_id)
    cat = catalog_frame(df, cols, row_id)
    text_cols = [c for c in cols if not is_numeric_type(df.schema[c].dataType)
                 and not is_datetime_type(df.schema[c].dataType)]
    if text_cols:
        sample = checkpoint(first_non_null(df, text_cols, K.TYPE_SPLIT_SAMPLE, row_id).coalesce(8))
        counts = sample.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
        share = counts.join(date_shares(sample), "column", "left").select(
            "column", (F.coalesce("n_dates", F.lit(0)) / F.col("n")).alias("dt_share"))
        cat = cat.join(share, "column", "left")
    else:
        cat = cat.withColumn("dt_share", F.lit(None).cast("double"))
    group = (F.when(F.col("is_numeric"), F.lit("numeric"))
             .when(F.col("is_datetime"), F.lit("datetime"))
             .when(F.coalesce(F.col("dt_share"), F.lit(0.0)) > 0.8, F.lit("datetime"))
             .otherwise(F.lit("categorical")))
    return cat.select("position", "column", group.alias("type_group"))
