"""All registered queries (Spark callables) and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import explain as EX
from ..operators import order as OR
from ..operators import results as RS
from . import q_explain, q_features, q_io, q_models, q_profile, q_quality
from .views import keyed, load

QUERIES: dict = {}
SQL: dict = {}


def flagship(spark, sf):
    """Events: standard score of ``value`` -> percentile rank -> rank -> top 20 -> numeric reason."""
    ev = keyed(load(spark, sf, "events"), "event_id")
    st = ev.agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd")).first()
    scored = ev.select("row_id", "event_id", "value",
                       F.abs((F.col("value") - F.lit(st["mu"])) / F.lit(st["sd"])).alias("abs_z"))
    pct = OR.percentile_rank(scored, "abs_z", "pct")
    ranked = RS.ranked(pct, "pct")
    top = ranked.filter(F.col("rank") <= 20)
    why = EX.reasons(ev, top.select("row_id"), ["value"]).filter(F.col("kind") == EX.KIND_NUMERIC)
    direction = F.when(F.col("message").endswith(K.DIRECTION_HIGH), F.lit(K.DIRECTION_HIGH)) \
        .when(F.col("message").endswith(K.DIRECTION_LOW), F.lit(K.DIRECTION_LOW))
    return (top.join(why.select("row_id", F.col("score").alias("reason_score"), direction.alias("direction")),
                     "row_id", "left")
            .select("event_id", "rank", F.round("pct", 6).alias("pct"), F.round("abs_z", 6).alias("abs_z"),
                    "value", F.round("reason_score", 6).alias("reason_score"), "direction"))


FLAGSHIP_SQL = """WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd, median(value) AS med,
                            stddev_samp(value) AS ssd FROM events),
z AS (SELECT event_id, value, abs((value - mu) / sd) AS abs_z FROM events, s),
p AS (SELECT *, (rank() OVER (ORDER BY abs_z) + (count(*) OVER (PARTITION BY abs_z) - 1) / 2.0)
                / count(*) OVER () AS pct FROM z),
r AS (SELECT *, row_number() OVER (ORDER BY pct DESC, event_id) AS rank FROM p)
SELECT event_id, rank, round(pct, 6) AS pct, round(abs_z, 6) AS abs_z, value,
  CASE WHEN abs(value - med) / ssd >= 2 THEN round(abs(value - med) / ssd, 6) END AS reason_score,
  CASE WHEN abs(value - med) / ssd >= 2 THEN CASE WHEN value > med THEN 'yüksek' ELSE 'düşük' END END
    AS direction
FROM r, s WHERE rank <= 20"""

QUERIES["flagship"] = flagship
SQL["flagship"] = FLAGSHIP_SQL


def review_top(spark, sf):
    """The whole review flow on the customer table (finance preset): top 20 with reason counts.

    Includes the randomised models, so it is checked by rows and invariants only.
    """
    from .review import review
    from .views import customer_rules
    r = review(customer_rules(spark, sf), preset="İşlem / Finans Verisi", top_n=20, as_of="2026-01-01 00:00:00")
    n_reasons = r.reasons.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_reasons"))
    return (r.top.join(n_reasons, "row_id", "left")
            .select(F.col("row_id").alias("c_custkey"), "rank", F.round("ensemble_score", 6).alias("ensemble_score"),
                    "any_top", F.coalesce("n_reasons", F.lit(0)).alias("n_reasons")))


QUERIES["review_top"] = review_top

for mod in (q_profile, q_quality, q_features, q_models, q_explain, q_io):
    QUERIES.update(mod.QUERIES)
    SQL.update(mod.SQL)
