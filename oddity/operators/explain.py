"""Explanations (E1-E7) for a set of rows at once (typically the top-N).

Statistics (medians, sample std, value shares, combination shares) are
computed once over the whole table; the rows to explain are unpivoted into a
long frame (rows x selected columns) which is joined to those statistics. Any
number of rows may be explained: the planner picks the joins by size. No per-row
driver loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expressions import nan_to_null
from ..session import checkpoint
from .features import medians
from .profile import is_numeric_type

KIND_NUMERIC = "numeric"
KIND_CATEGORICAL = "kategorik"
KIND_COMBO = "kombinasyon"
KIND_RULE = "kural"
REASON_SCHEMA = "row_id long, kind string, column string, message string, score double, seq int"


def _numeric_stats(df: DataFrame, cols: list[str]) -> dict:
    if not cols:
        return {}
    df = nan_to_null(df.select(*cols))
    med = medians(df, cols)
    row = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return {c: (med[c], row[c]) for c in cols}


def _targets(df: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    return df.join(rows.select(row_id).distinct(), row_id)


def top_deviations(df: DataFrame, rows: DataFrame, selected: list[str], top_k: int = 5,
                   row_id: str = "row_id") -> DataFrame:
    """Per row, numeric columns by |x - median| / sample std (2 dp), the largest top_k."""
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in selected if is_numeric_type(types[c])]
    stats = {c: s for c, s in _numeric_stats(df, num).items() if s[1] not in (None, 0.0) and s[0] is not None}
    if not stats:
        return df.sparkSession.createDataFrame([], "row_id long, feature string, value double, "
                                                   "typical double, deviation double, position int")
    t = _targets(df, rows, row_id)
    parts = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"),
                      F.col(c).cast("double").alias("value"), F.lit(stats[c][0]).alias("median"),
                      F.lit(stats[c][1]).alias("std")) for i, c in enumerate(num) if c in stats]
    long = t.select(row_id, F.explode(F.array(*parts)).alias("s")).select(row_id, "s.*") \
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
    long = long.withColumn("deviation", F.bround(F.abs(F.col("value") - F.col("median")) / F.col("std"), 2))
    w = Window.partitionBy(row_id).orderBy(F.desc("deviation"), "position")
    return (long.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_k)
            .select(row_id, "feature", "value", F.bround("median", 2).alias("typical"), "deviation",
                    F.col("_r").alias("position")))


def reasons(df: DataFrame, rows: DataFrame, selected: list[str], rare_threshold: float = 0.01,
            combo_columns: list[str] | None = None, flags: DataFrame | None = None,
            row_id: str = "row_id") -> DataFrame:
    """Every reason of every row in ``rows``: (row_id, kind, column, message, score, seq).

    ``seq`` is the order in which the reference lists reasons (column order, then
    the combination, then rule flags); E6 uses it to break score ties.
    """
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    sel = [c for c in selected if c in types]
    num = [c for c in sel if is_numeric_type(types[c])]
    cat = [c for c in sel if c not in num]
    t = checkpoint(_targets(df, rows, row_id))  # read by every kind of reason
    out = []
    # E2 numeric
    stats = {c: s for c, s in _numeric_stats(df, num).items() if s[1] is not None and s[1] > 0}
    if stats:
        parts = [F.struct(F.lit(c).alias("column"), F.lit(sel.index(c)).alias("seq"),
                          F.col(c).cast("double").alias("v"), F.lit(stats[c][0]).alias("med"),
                          F.lit(stats[c][1]).alias("sd")) for c in num if c in stats]
        long = t.select(row_id, F.explode(F.array(*parts)).alias("s")).select(row_id, "s.*") \
            .filter(F.col("v").isNotNull() & ~F.isnan("v"))
        z = F.abs(F.col("v") - F.col("med")) / F.col("sd")
        direction = F.when(F.col("v") > F.col("med"), F.lit(K.DIRECTION_HIGH)).otherwise(F.lit(K.DIRECTION_LOW))
        msg = F.format_string(K.REASON_NUMERIC, F.col("column"), F.col("v"), F.col("med"), z, direction)
        out.append(long.filter(z >= 2).select(row_id, F.lit(KIND_NUMERIC).alias("kind"), "column",
                                              msg.alias("message"), z.alias("score"), "seq"))
    n_total = df.count()  # one scalar: shares count nulls in the denominator
    # E3 rare categorical value (share counts nulls in the denominator). Only the
    # values of the rows being explained are counted: the whole column is
    # semi-joined with that value set, then aggregated.
    if cat:
        parts = [F.struct(F.lit(c).alias("column"), F.lit(sel.index(c)).alias("seq"),
                          F.col(c).cast("string").alias("value")) for c in cat]
        long = t.select(row_id, F.explode(F.array(*parts)).alias("s")).select(row_id, "s.*") \
            .filter(F.col("value").isNotNull())
        wanted = long.select("column", "value").distinct()
        base = df.select(F.lit(0).alias("_k"), *[F.col(c).cast("string").alias(c) for c in cat])
        freq = (base.unpivot(["_k"], cat, "column", "value")
                .join(wanted, ["column", "value"], "left_semi")
                .groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
                .select("column", "value", (F.col("cnt") / F.lit(n_total)).alias("f")))
        j = long.join(freq, ["column", "value"], "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
        rare = (F.col("f") > 0) & (F.col("f") < rare_threshold)
        msg_rare = F.format_string(K.REASON_RARE, F.col("column"), F.col("value"), F.col("f") * 100)
        msg_unseen = F.format_string(K.REASON_UNSEEN, F.col("column"), F.col("value"))
        out.append(j.filter(rare | (F.col("f") == 0)).select(
            row_id, F.lit(KIND_CATEGORICAL).alias("kind"), "column",
            F.when(rare, msg_rare).otherwise(msg_unseen).alias("message"),
            F.when(rare, (F.lit(rare_threshold) - F.col("f")) / rare_threshold * 5).otherwise(F.lit(5.0))
            .alias("score"), "seq"))
    # E4 rare combination (values compared as text, a null reads "None")
    if combo_columns and len(combo_columns) >= 2 and all(c in types for c in combo_columns):
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(f"_c{i}") for i, c in enumerate(combo_columns)]
        kn = [f"_c{i}" for i in range(len(combo_columns))]
        tk = t.select(row_id, *keys)
        counts = (df.select(*keys).join(tk.select(*kn).distinct(), kn, "left_semi")
                  .groupBy(*kn).agg(F.count(F.lit(1)).alias("cnt"))
                  .select(*kn, (F.col("cnt") / F.lit(n_total)).alias("f")))
        j = tk.join(counts, kn, "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
        pretty = F.concat_ws(" + ", *[F.concat(F.lit(f"{c}=`"), F.col(k), F.lit("`"))
                                      for c, k in zip(combo_columns, kn)])
        msg = F.format_string(K.REASON_COMBO, pretty, F.col("f") * 100)
        out.append(j.filter((F.col("f") > 0) & (F.col("f") < rare_threshold)).select(
            row_id, F.lit(KIND_COMBO).alias("kind"), F.lit(" + ".join(combo_columns)).alias("column"),
            msg.alias("message"), ((F.lit(rare_threshold) - F.col("f")) / rare_threshold * 4).alias("score"),
            F.lit(len(sel)).alias("seq")))
    # E5 rule flags
    if flags is not None:
        fcols = [c for c in flags.columns if c != row_id]
        if fcols:
            ft = _targets(flags, rows, row_id)
            parts = [F.struct(F.lit(c.split("__", 1)[0]).alias("rule"),
                              F.lit(c.split("__", 1)[1] if "__" in c else "").alias("column"),
                              F.lit(len(sel) + 1 + i).alias("seq"), F.col(c).cast("int").alias("v"))
                     for i, c in enumerate(fcols)]
            long = ft.select(row_id, F.explode(F.array(*parts)).alias("s")).select(row_id, "s.*") \
                .filter(F.coalesce(F.col("v"), F.lit(0)) != 0)
            msg = F.concat(F.replace(F.lit(K.REASON_RULE), F.lit("{rule}"), F.regexp_replace("rule", "_", " ")),
                           F.when(F.col("column") != "", F.concat(F.lit(" ("), F.col("column"), F.lit(")")))
                           .otherwise(F.lit("")))
            out.append(long.select(row_id, F.lit(KIND_RULE).alias("kind"), "column", msg.alias("message"),
                                   F.lit(6.0).alias("score"), "seq"))
    if not out:
        return spark.createDataFrame([], REASON_SCHEMA)
    return reduce(DataFrame.unionByName, out)


def explain(df: DataFrame, rows: DataFrame, selected: list[str], rare_threshold: float = 0.01,
            combo_columns: list[str] | None = None, flags: DataFrame | None = None, top_k: int = 8,
            row_id: str = "row_id") -> DataFrame:
    """The top_k reasons of each row by score (stable on ties), with their rank."""
    r = reasons(df, rows, selected, rare_threshold, combo_columns, flags, row_id)
    w = Window.partitionBy(row_id).orderBy(F.desc("score"), F.asc("seq"))
    return r.withColumn("reason_rank", F.row_number().over(w)).filter(F.col("reason_rank") <= top_k)


def reasons_by_kind(explained: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Per row and kind, the number of reasons and their columns in rank order."""
    return (explained.groupBy(row_id, "kind")
            .agg(F.count(F.lit(1)).alias("n_reasons"),
                 F.array_sort(F.collect_list(F.struct("reason_rank", "column"))).alias("_s"))
            .select(row_id, "kind", "n_reasons",
                    F.concat_ws(", ", F.transform("_s", lambda s: s["column"])).alias("columns")))
