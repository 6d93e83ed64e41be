"""Registered queries: explanations (E1-E7) and the rolling band."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import explain as EX
from ..operators import quality as QC
from ..operators import results as RS
from ..operators import temporal as TM
from .views import SQL_CUSTOMER_EXPLAIN, customer_explain, keyed, load, with_ctes

QUERIES, SQL = {}, {}
SELECTED = ["c_acctbal", "c_nationkey", "c_segment", "c_spend"]
COMBO = ["c_segment", "c_nationkey"]
RARE = 0.01
NUM = ["c_acctbal", "c_nationkey", "c_spend"]


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ shared inputs
def _inputs(spark, sf):
    """(table, rows to explain = top 20 by |z| of balance + 5 for a rare segment, DQ flags)."""
    ce = customer_explain(spark, sf)
    st = ce.agg(F.avg("c_spend").alias("m"), F.stddev_samp("c_spend").alias("s")).first()
    s = (F.abs(F.col("c_spend") - F.lit(st["m"])) / F.lit(st["s"])
         + F.when(F.col("c_segment") == "RARE", F.lit(5.0)).otherwise(F.lit(0.0)))
    top = RS.top_n(ce.select("row_id", s.alias("s")), 20, "s").select("row_id")
    _, flags = QC.run_quality_checks(ce)
    return ce, top, flags


_RULES_NUM = [(K.RULE_NEGATIVE, "{c} < 0"), (K.RULE_ZERO, "{c} = 0"),
              (K.RULE_EXTREME, "(SELECT stddev_samp({c}) FROM ce) > 0 AND abs({c} - (SELECT avg({c}) FROM ce))"
                               " / (SELECT stddev_samp({c}) FROM ce) > 4")]
_FLAG_COLS = ["c_custkey", "c_acctbal", "c_nationkey", "c_spend"]


def _sql_flags() -> str:
    parts = []
    for ci, c in enumerate(_FLAG_COLS):
        for ri, (rule, cond) in enumerate(_RULES_NUM):
            parts.append(f"SELECT c_custkey, '{rule}' AS rule, '{c}' AS \"column\", {100 + ci * 10 + ri} AS seq "
                         f"FROM ce WHERE {cond.format(c=c)}")
    return "flags AS (" + " UNION ALL ".join(parts) + ")"


SQL_BASE = [
    SQL_CUSTOMER_EXPLAIN,
    "st AS (SELECT median(c_acctbal) AS med_a, stddev_samp(c_acctbal) AS sd_a, median(c_nationkey) AS med_n, "
    "stddev_samp(c_nationkey) AS sd_n, median(c_spend) AS med_s, stddev_samp(c_spend) AS sd_s, "
    "avg(c_spend) AS mu_s, count(*) AS n FROM ce)",
    "tgt AS (SELECT c_custkey FROM ce, st ORDER BY abs(c_spend - mu_s) / sd_s "
    "+ CASE WHEN c_segment = 'RARE' THEN 5.0 ELSE 0.0 END DESC, c_custkey LIMIT 20)",
    "num AS (SELECT c_custkey, 'c_acctbal' AS \"column\", 0 AS seq, c_acctbal AS v, med_a AS med, sd_a AS sd "
    "FROM ce JOIN tgt USING (c_custkey), st UNION ALL SELECT c_custkey, 'c_nationkey', 1, c_nationkey, med_n, sd_n "
    "FROM ce JOIN tgt USING (c_custkey), st UNION ALL SELECT c_custkey, 'c_spend', 3, c_spend, med_s, sd_s "
    "FROM ce JOIN tgt USING (c_custkey), st)",
    _sql_flags(),
    f"""reasons AS (
      SELECT c_custkey, 'numeric' AS kind, "column", abs(v - med) / sd AS score, seq FROM num
        WHERE v IS NOT NULL AND abs(v - med) / sd >= 2
      UNION ALL
      SELECT c_custkey, 'kategorik', 'c_segment', ({RARE} - f) / {RARE} * 5, 2 FROM
        (SELECT t.c_custkey, (SELECT count(*) FROM ce c2 WHERE c2.c_segment = ce.c_segment) / (SELECT n FROM st) AS f
         FROM ce JOIN tgt t USING (c_custkey) WHERE ce.c_segment IS NOT NULL) q WHERE f > 0 AND f < {RARE}
      UNION ALL
      SELECT c_custkey, 'kombinasyon', 'c_segment + c_nationkey', ({RARE} - f) / {RARE} * 4, 4 FROM
        (SELECT t.c_custkey, (SELECT count(*) FROM ce c2 WHERE coalesce(c2.c_segment, 'None') = coalesce(ce.c_segment, 'None')
            AND CAST(c2.c_nationkey AS VARCHAR) = CAST(ce.c_nationkey AS VARCHAR)) / (SELECT n FROM st) AS f
         FROM ce JOIN tgt t USING (c_custkey)) q WHERE f > 0 AND f < {RARE}
      UNION ALL
      SELECT c_custkey, 'kural', "column", 6.0, seq FROM flags JOIN tgt USING (c_custkey))""",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, seq) AS reason_rank
                FROM reasons)""",
]


def _reasons(spark, sf):
    ce, top, flags = _inputs(spark, sf)
    return EX.reasons(ce, top, SELECTED, RARE, COMBO, flags)


def _kind_out(r, kind):
    return r.filter(F.col("kind") == kind).select(F.col("row_id").alias("c_custkey"), "column",
                                                   F.round("score", 6).alias("score"))


_KIND_SQL = 'SELECT c_custkey, "column", round(score, 6) AS score FROM reasons WHERE kind = '


@register("top_deviations", with_ctes(*SQL_BASE) + """SELECT c_custkey, "column" AS feature, CAST(v AS DOUBLE) AS value,
    round_even(med, 2) AS typical, round_even(abs(v - med) / sd, 2) AS deviation,
    row_number() OVER (PARTITION BY c_custkey ORDER BY round_even(abs(v - med) / sd, 2) DESC, seq) AS position
    FROM num WHERE v IS NOT NULL""")
def top_deviations(spark, sf):
    ce, top, _ = _inputs(spark, sf)
    d = EX.top_deviations(ce, top, SELECTED, 5)
    return d.select(F.col("row_id").alias("c_custkey"), "feature", "value", "typical", "deviation", F.col("position").cast("long").alias("position"))


@register("reasons_numeric", with_ctes(*SQL_BASE) + _KIND_SQL + "'numeric'")
def reasons_numeric(spark, sf):
    return _kind_out(_reasons(spark, sf), "numeric")


@register("reasons_rare", with_ctes(*SQL_BASE) + _KIND_SQL + "'kategorik'")
def reasons_rare(spark, sf):
    return _kind_out(_reasons(spark, sf), "kategorik")


@register("reasons_combo", with_ctes(*SQL_BASE) + _KIND_SQL + "'kombinasyon'")
def reasons_combo(spark, sf):
    return _kind_out(_reasons(spark, sf), "kombinasyon")


@register("reasons_rule", with_ctes(*SQL_BASE) + """SELECT c_custkey, "column",
    'Kural ihlali: **' || replace(rule, '_', ' ') || '** (' || "column" || ')' AS message
    FROM flags JOIN tgt USING (c_custkey)""")
def reasons_rule(spark, sf):
    r = _reasons(spark, sf).filter(F.col("kind") == "kural")
    return r.select(F.col("row_id").alias("c_custkey"), "column", "message")


@register("explain", with_ctes(*SQL_BASE) + """SELECT c_custkey, reason_rank, kind, "column", round(score, 6) AS score
    FROM ranked WHERE reason_rank <= 8""")
def explain(spark, sf):
    ce, top, flags = _inputs(spark, sf)
    e = EX.explain(ce, top, SELECTED, RARE, COMBO, flags, top_k=8)
    return e.select(F.col("row_id").alias("c_custkey"), F.col("reason_rank").cast("long").alias("reason_rank"), "kind", "column",
                    F.round("score", 6).alias("score"))


@register("reasons_by_kind", with_ctes(*SQL_BASE) + """SELECT c_custkey, kind, count(*) AS n_reasons,
    string_agg("column", ', ' ORDER BY reason_rank) AS columns FROM ranked WHERE reason_rank <= 8
    GROUP BY c_custkey, kind""")
def reasons_by_kind(spark, sf):
    ce, top, flags = _inputs(spark, sf)
    e = EX.explain(ce, top, SELECTED, RARE, COMBO, flags, top_k=8)
    return EX.reasons_by_kind(e).withColumnRenamed("row_id", "c_custkey")


# ------------------------------------------------------------------ W1, W2
SQL_BAND = """WITH w AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS position,
    count(value) OVER win AS c, avg(value) OVER win AS m, stddev_samp(value) OVER win AS s
    FROM events WINDOW win AS (ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING)),
  g AS (SELECT stddev_samp(value) AS gs FROM events),
  b AS (SELECT event_id, value, position, CASE WHEN c >= 3 THEN m END AS rm,
               coalesce(CASE WHEN c >= 3 THEN s END, gs) AS rs FROM w, g)
"""


def _band(spark, sf):
    ev = keyed(load(spark, sf, "events"), "event_id")
    return TM.rolling_band(ev, "ts", "value", 14, bucket_rows=4096)


@register("rolling_band", SQL_BAND + """SELECT event_id, position, round(rm, 6) AS rolling_mean,
    round(rs, 6) AS rolling_std, round(rm + 2.5 * rs, 6) AS upper, round(rm - 2.5 * rs, 6) AS lower,
    coalesce(value > rm + 2.5 * rs OR value < rm - 2.5 * rs, false) AS is_anomaly FROM b""")
def rolling_band(spark, sf):
    b = _band(spark, sf)
    return b.select(F.col("row_id").alias("event_id"), "position",
                    *[F.round(c, 6).alias(c) for c in ("rolling_mean", "rolling_std", "upper", "lower")],
                    "is_anomaly")


@register("rolling_band_points", SQL_BAND + """SELECT event_id, value, round(rm, 6) AS expected FROM b
    WHERE coalesce(value > rm + 2.5 * rs OR value < rm - 2.5 * rs, false)""")
def rolling_band_points(spark, sf):
    p = TM.band_points(_band(spark, sf), "ts", "value")
    return p.select(F.col("row_id").alias("event_id"), "value", F.round("expected", 6).alias("expected"))
