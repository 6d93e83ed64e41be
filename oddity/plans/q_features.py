"""Registered queries: feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import features as FT
from ..operators import quality as QC
from ..operators.order import dense_index
from .views import (SQL_CUSTOMER_EXPLAIN, SQL_CUSTOMER_NULLS, SQL_CUSTOMER_RULES, SQL_NATION_OFFICES,
                    customer_explain, customer_nulls, customer_rules, keyed, load, nation_offices, with_ctes)

QUERIES, SQL = {}, {}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _r6(df, key_from="row_id", key_to="c_custkey"):
    return df.select(F.col(key_from).alias(key_to),
                     *[F.round(F.col(c), 6).alias(c) for c in df.columns if c != key_from])


def _q(name: str) -> str:
    return '"' + name + '"'


# ------------------------------------------------------------------------- F1/F2
@register("impute", with_ctes(
    SQL_CUSTOMER_NULLS,
    "med AS (SELECT median(c_acctbal) AS m FROM cn)",
    "mo AS (SELECT c_mktsegment AS v FROM cn WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment "
    "ORDER BY count(*) DESC, c_mktsegment LIMIT 1)")
    + """SELECT c_custkey, round(coalesce(c_acctbal, (SELECT m FROM med)), 6) AS c_acctbal,
          coalesce(c_mktsegment, (SELECT v FROM mo), 'UNKNOWN') AS c_mktsegment FROM cn""")
def impute(spark, sf):
    cn = customer_nulls(spark, sf)
    out = FT.impute(cn, ["c_acctbal"], ["c_mktsegment"])
    return out.select(F.col("row_id").alias("c_custkey"), F.round("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment")


# ------------------------------------------------------------------------- F3
@register("one_hot", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS {_q('c_mktsegment_' + s)}" for s in SEGMENTS)
    + ", CASE WHEN c_acctbal >= 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS c_tier_pos FROM customer")
def one_hot(spark, sf):
    c = keyed(load(spark, sf, "customer"), "c_custkey")
    c = c.withColumn("c_tier", F.when(F.col("c_acctbal") >= 0, F.lit("pos")).otherwise(F.lit("neg")))
    feats, _ = FT.build_features(c, ["c_mktsegment", "c_tier"], max_onehot=15, scale=False)
    return _r6(feats)


# ------------------------------------------------------------------------- F4
@register("freq_encode", """SELECT p_partkey,
    round(count(*) OVER (PARTITION BY p_brand) / count(*) OVER (), 6) AS p_brand_freq,
    round(count(*) OVER (PARTITION BY p_type) / count(*) OVER (), 6) AS p_type_freq FROM part""")
def freq_encode(spark, sf):
    p = keyed(load(spark, sf, "part"), "p_partkey")
    feats, _ = FT.build_features(p, ["p_brand", "p_type"], max_onehot=3, scale=False)
    return _r6(feats, key_to="p_partkey")


# ------------------------------------------------------------------------- F5
@register("rare_category", with_ctes(SQL_CUSTOMER_EXPLAIN) + """SELECT c_custkey,
    round(count(*) OVER (PARTITION BY c_segment) / count(*) OVER (), 6) AS c_segment_freq,
    CASE WHEN count(*) OVER (PARTITION BY c_segment) / count(*) OVER () < 0.005 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      AS c_segment_is_rare FROM ce""")
def rare_category(spark, sf):
    ce = customer_explain(spark, sf)
    feats, _ = FT.build_features(ce, [], rare_columns=["c_segment"], scale=False)
    return _r6(feats)


# ------------------------------------------------------------------------- F6
COMBO = ["l_returnflag", "l_linestatus"]
COMBO_NAME = FT.combo_name(COMBO)


@register("combo_freq", f"""SELECT l_orderkey, l_linenumber,
    round(count(*) OVER (PARTITION BY l_returnflag, l_linestatus) / count(*) OVER (), 6) AS {_q(COMBO_NAME + '_freq')},
    CASE WHEN count(*) OVER (PARTITION BY l_returnflag, l_linestatus) / count(*) OVER () < 0.005
         THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS {_q(COMBO_NAME + '_is_rare')} FROM lineitem""")
def combo_freq(spark, sf):
    li = dense_index(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *COMBO))
    feats, _ = FT.build_features(li, [], combo_columns=COMBO, scale=False)
    return (li.select("row_id", "l_orderkey", "l_linenumber").join(feats, "row_id")
            .select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in feats.columns if c != "row_id"]))


# ------------------------------------------------------------------------- F7-F9
def _sql_rule_numeric(c: str, table: str) -> str:
    return (f"CASE WHEN {c} < 0 THEN 1 ELSE 0 END AS {c}_is_negative, "
            f"CASE WHEN {c} = 0 THEN 1 ELSE 0 END AS {c}_is_zero, "
            f"CASE WHEN (SELECT stddev_samp({c}) FROM {table}) > 0 AND abs({c} - (SELECT avg({c}) FROM {table})) "
            f"/ (SELECT stddev_samp({c}) FROM {table}) > 4 THEN 1 ELSE 0 END AS {c}_is_extreme")


@register("rule_features_numeric", "SELECT c_custkey, " + ", ".join(
    _sql_rule_numeric(c, "customer") for c in ["c_acctbal", "c_nationkey"]) + " FROM customer")
def rule_features_numeric(spark, sf):
    c = keyed(load(spark, sf, "customer"), "c_custkey")
    rules = FT.rule_features(c, ["c_acctbal", "c_nationkey"])
    return c.select(F.col("row_id").alias("c_custkey"), *[e.alias(n) for n, e in rules])


@register("rule_features_text", with_ctes(SQL_CUSTOMER_RULES) + f"""SELECT c_custkey,
    CASE WHEN regexp_matches(coalesce(c_name, 'None'), '^\\s*\\d+\\s*$') THEN 1 ELSE 0 END AS c_name_digits_only,
    CASE WHEN regexp_matches(coalesce(c_name, 'None'), '{K.CONTROL_CHAR_RE}') THEN 1 ELSE 0 END
      AS c_name_has_control_char FROM cr""")
def rule_features_text(spark, sf):
    c = customer_rules(spark, sf)
    rules = FT.rule_features(c, ["c_name"])
    return c.select(F.col("row_id").alias("c_custkey"), *[e.alias(n) for n, e in rules])


@register("rule_features_branch", with_ctes(SQL_NATION_OFFICES) + "SELECT n_nationkey, CASE WHEN " + " OR ".join(
    f"contains(upper(office_location), '{t}')" for t in K.COUNTRY_TOKENS)
    + " THEN 1 ELSE 0 END AS office_location_country_in_branch FROM no")
def rule_features_branch(spark, sf):
    n = nation_offices(spark, sf)
    rules = FT.rule_features(n, ["office_location"])
    return n.select("n_nationkey", *[e.alias(nm) for nm, e in rules])


# ------------------------------------------------------------------------- F10
@register("feature_merge", with_ctes(
    SQL_CUSTOMER_NULLS,
    "med AS (SELECT median(c_acctbal) AS m FROM cn)",
    "mo AS (SELECT c_mktsegment AS v FROM cn WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment "
    "ORDER BY count(*) DESC, c_mktsegment LIMIT 1)",
    "imp AS (SELECT c_custkey, coalesce(c_acctbal, (SELECT m FROM med)) AS c_acctbal, "
    "coalesce(c_mktsegment, (SELECT v FROM mo), 'UNKNOWN') AS seg_imp, c_mktsegment FROM cn)")
    + """SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal,
      round(count(*) OVER (PARTITION BY seg_imp) / count(*) OVER (), 6) AS c_mktsegment_freq,
      CASE WHEN count(*) OVER (PARTITION BY c_mktsegment) / count(*) OVER () < 0.005 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
        AS c_mktsegment_is_rare FROM imp""")
def feature_merge(spark, sf):
    """the encoded c_mktsegment_freq (after imputation) wins over the rare-feature one."""
    cn = customer_nulls(spark, sf)
    feats, _ = FT.build_features(cn, ["c_acctbal", "c_mktsegment"], max_onehot=3,
                                 rare_columns=["c_mktsegment"], scale=False)
    return _r6(feats)


# ------------------------------------------------------------------------- F11
@register("standard_scale", "SELECT c_custkey, " + ", ".join(
    f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () "
    f"ELSE {c} - avg({c}) OVER () END, 6) AS {c}" for c in ["c_acctbal", "c_nationkey"]) + " FROM customer")
def standard_scale(spark, sf):
    c = keyed(load(spark, sf, "customer"), "c_custkey")
    feats, _ = FT.build_features(c, ["c_acctbal", "c_nationkey"])
    return _r6(feats)


# ------------------------------------------------------------------------- F12
MATRIX_FEATURES = (["c_acctbal", "c_nationkey"] + [f"c_mktsegment_{s}" for s in SEGMENTS]
                   + ["c_mktsegment_freq", "c_mktsegment_is_rare", "isim_alanında_sadece_rakam__c_name"])


def _sql_matrix() -> str:
    raw = ("raw AS (SELECT c_custkey, c_acctbal, c_nationkey, " + ", ".join(
        f"CASE WHEN c_mktsegment = '{s}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS {_q('c_mktsegment_' + s)}" for s in SEGMENTS)
        + ", count(*) OVER (PARTITION BY c_mktsegment) / count(*) OVER () AS c_mktsegment_freq"
        + ", CASE WHEN count(*) OVER (PARTITION BY c_mktsegment) / count(*) OVER () < 0.005 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
        + " AS c_mktsegment_is_rare"
        + ", CASE WHEN regexp_matches(coalesce(c_name, ''), '^\\s*\\d+\\s*$') AND length(coalesce(c_name, '')) > 0"
        + " THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS " + _q("isim_alanında_sadece_rakam__c_name") + " FROM cr)")
    cols = ", ".join(
        f"round(CASE WHEN stddev_pop({_q(c)}) OVER () > 0 THEN ({_q(c)} - avg({_q(c)}) OVER ()) / "
        f"stddev_pop({_q(c)}) OVER () ELSE {_q(c)} - avg({_q(c)}) OVER () END, 6) AS {_q(c)}"
        for c in MATRIX_FEATURES)
    return with_ctes(SQL_CUSTOMER_RULES, raw) + f"SELECT c_custkey, {cols} FROM raw"


def matrix(spark, sf, preset: str = K.DEFAULT_PRESET):
    """F12 as the application runs it: DQ flags of enabled rules are extra features."""
    cr = customer_rules(spark, sf)
    p = K.PRESETS[preset]
    _, frame, flag_cols = QC.quality_flags(cr, allowed_currencies=p["allowed_currencies"], preset=preset)
    return FT.build_features(frame, ["c_acctbal", "c_nationkey", "c_mktsegment"],
                             max_onehot=p["encoding"]["onehot_max_unique"], rare_columns=["c_mktsegment"],
                             extra_columns=flag_cols)


@register("feature_matrix", _sql_matrix())
def feature_matrix(spark, sf):
    feats, _ = matrix(spark, sf)
    return _r6(feats)
