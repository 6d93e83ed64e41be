"""Registered queries: models, ensemble and ranked results.

The isolation forest (M1, M10) draws its rows and splits from MD5 digests, so
SQL grows the same trees, level by level. The one-class SVM (M3) is iterative: SQL
checks facts of its scores. Everything else is compared on deterministic scores:
the standard score of ``events.value`` and LOF on the scaled customer balance and nation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import ensemble as EN
from ..operators import features as FT
from ..operators import models as MD
from ..operators import results as RS
from ..operators.order import exact_quantile
from .views import keyed, load, with_ctes

QUERIES, SQL = {}, {}
CONTAMINATION = 0.05
ENS_WEIGHTS = {"value": 1.1, "zscore": 1.3, "rarity": 1.0}
ENS_MODELS = ["value", "zscore", "rarity"]


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ deterministic scores
def events_z(spark, sf):
    """events with score = |value - mean| / sample std."""
    ev = keyed(load(spark, sf, "events"), "event_id")
    st = ev.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).first()
    return ev.withColumn("score", F.abs(F.col("value") - F.lit(st["m"])) / F.lit(st["s"]))


SQL_EZ = ("ez AS (SELECT e.*, abs(value - (SELECT avg(value) FROM events)) / "
          "(SELECT stddev_samp(value) FROM events) AS score FROM events e)")


def events_long_scores(spark, sf):
    """(row_id, model_key, score) for three deterministic scores of the events."""
    ez = events_z(spark, sf)
    n = ez.count()
    share = ez.groupBy("event_type").agg((F.count(F.lit(1)) / F.lit(n)).alias("_share"))
    ez = ez.join(share.withColumnRenamed("event_type", "_type"), F.col("event_type").eqNullSafe(F.col("_type")))
    return ez.select("row_id", F.explode(F.array(
        F.struct(F.lit("value").alias("model_key"), F.col("value").alias("score")),
        F.struct(F.lit("zscore").alias("model_key"), F.col("score").alias("score")),
        F.struct(F.lit("rarity").alias("model_key"), (F.lit(1.0) - F.col("_share")).alias("score"))))
        .alias("s")).select("row_id", "s.model_key", "s.score")


SQL_LONG = [SQL_EZ, """lng AS (
  SELECT event_id, 'value' AS model_key, value AS score FROM ez
  UNION ALL SELECT event_id, 'zscore', score FROM ez
  UNION ALL SELECT event_id, 'rarity', 1.0 - count(*) OVER (PARTITION BY event_type) / count(*) OVER () FROM ez)""",
            """pr AS (SELECT *, (rank() OVER (PARTITION BY model_key ORDER BY score)
                      + (count(*) OVER (PARTITION BY model_key, score) - 1) / 2.0)
                      / count(*) OVER (PARTITION BY model_key) AS pct FROM lng)""",
            "thr AS (SELECT model_key, quantile_cont(score, 0.95) AS t FROM lng GROUP BY model_key)",
            "tops AS (SELECT pr.*, score >= t AS top FROM pr JOIN thr ON pr.model_key = thr.model_key)"]


def customer_features(spark, sf):
    c = keyed(load(spark, sf, "customer"), "c_custkey")
    return FT.build_features(c, ["c_acctbal", "c_nationkey"])


SQL_CF = ("f AS (SELECT c_custkey AS id, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x1,"
          " (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS x2 FROM customer)")
SQL_LOF = [SQL_CF,
           "d AS (SELECT a.id AS a, b.id AS b, sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))"
           " AS d FROM f a JOIN f b ON a.id <> b.id)",
           "nn AS (SELECT a, b, d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) q"
           " WHERE r <= 20)",
           "kd AS (SELECT a, max(d) AS kd FROM nn GROUP BY a)",
           "lrd AS (SELECT nn.a, 1.0 / (avg(greatest(kd.kd, nn.d)) + 1e-10) AS lrd FROM nn JOIN kd ON nn.b = kd.a"
           " GROUP BY nn.a)",
           "lof AS (SELECT l1.a AS id, avg(l2.lrd) / l1.lrd AS score FROM nn JOIN lrd l1 ON nn.a = l1.a"
           " JOIN lrd l2 ON nn.b = l2.a GROUP BY l1.a, l1.lrd)"]


def customer_lof(spark, sf):
    feats, spec = customer_features(spark, sf)
    return MD.lof(feats, spec.names, k=20), feats, spec


# ------------------------------------------------------------------ M1, M10
FOREST_SEED, FOREST_DEPTH, FOREST_ROWS = 42, 8, 256
_PATH = "CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2 * (ln({n} - 1) + 0.5772156649015329) - 2.0 * ({n} - 1) / {n} END"


def _hex(digest: str, start: int, digits: int) -> str:
    return f"CAST('0x' || substr({digest}, {start}, {digits}) AS BIGINT)"


def sql_forest(dims: int, n_trees: int) -> list[str]:
    """CTEs growing a forest over the training rows t (id, xs) and scoring the rows f (id, xs): forest (id, score)."""
    draw = f"md5('{FOREST_SEED}:' || tree || ':' || node)"
    ctes = [f"""drawn AS (SELECT id, xs, {_hex('d', 1, 8)} AS a, {_hex('d', 9, 8)} AS b
              FROM (SELECT *, md5(CAST(id AS VARCHAR) || ':{FOREST_SEED}') AS d FROM t) q)""",
            f"""n0 AS MATERIALIZED (SELECT tree, 1::BIGINT AS node, xs FROM (SELECT tree, xs, row_number() OVER (
              PARTITION BY tree ORDER BY (a + tree * b) % 4294967296, id) AS r FROM drawn, range({n_trees}) s(tree)) q
              WHERE r <= {FOREST_ROWS})"""]
    leaves = []
    for k in range(FOREST_DEPTH + 1):
        ends = ", ".join(f"[min(xs[{j}]), max(xs[{j}])]" for j in range(1, dims + 1))
        ctes.append(f"""s{k} AS MATERIALIZED (SELECT *, {k} AS depth, {'len(able) > 0' if k < FOREST_DEPTH else 'false'} AS inner_node,
          able[1 + CAST(floor({_hex(draw, 1, 8)} / 4294967296.0 * len(able)) AS BIGINT)] AS f FROM (
          SELECT *, list_filter(range(1, {dims + 1}), lambda j: ends[j][2] > ends[j][1]) AS able FROM (
          SELECT tree, node, count(*) AS n, [{ends}] AS ends FROM n{k} GROUP BY tree, node) q) q)""")
        ctes.append(f"""p{k} AS MATERIALIZED (SELECT tree, node, depth, n, inner_node, f,
          ends[f][1] + {_hex(draw, 9, 13)} / 4503599627370496.0 * (ends[f][2] - ends[f][1]) AS thr FROM s{k})""")
        leaves.append(f"SELECT tree, node, depth + {_PATH.format(n='n')} AS leaf FROM p{k} WHERE NOT inner_node")
        if k < FOREST_DEPTH:
            ctes.append(f"""n{k + 1} AS MATERIALIZED (SELECT n{k}.tree, 2 * n{k}.node + CASE WHEN xs[f] <= thr THEN 0 ELSE 1 END AS node, xs
              FROM n{k} JOIN p{k} USING (tree, node) WHERE inner_node)""")
    ctes.append(f"w0 AS (SELECT id, xs, tree, 1::BIGINT AS node FROM f, range({n_trees}) s(tree))")
    for k in range(FOREST_DEPTH):
        ctes.append(f"""w{k + 1} AS MATERIALIZED (SELECT id, xs, w{k}.tree, CASE WHEN NOT coalesce(inner_node, false) THEN w{k}.node
          WHEN xs[f] <= thr THEN 2 * w{k}.node ELSE 2 * w{k}.node + 1 END AS node FROM w{k} LEFT JOIN p{k} USING (tree, node))""")
    ctes += ["leaves AS (" + " UNION ALL ".join(leaves) + ")",
             f"psi AS (SELECT least({FOREST_ROWS}, count(*)) AS psi FROM t)",
             f"""raws AS (SELECT id, pow(2.0, -avg(leaf) / (SELECT {_PATH.format(n='psi')} FROM psi)) AS raw
               FROM w{FOREST_DEPTH} JOIN leaves USING (tree, node) GROUP BY id)""",
             f"forest AS (SELECT id, raw - (SELECT quantile_cont(raw, {1 - CONTAMINATION}) FROM raws) AS score FROM raws)"]
    return ctes


def sql_scaled(table: str, key: str, exprs: list[str]) -> list[str]:
    """CTE f (id, xs) of the scaled expressions (population standard deviation; constant ones are centred)."""
    each = ", ".join(f"{e} AS x{i}" for i, e in enumerate(exprs))
    scaled = ", ".join(f"(x{i} - avg(x{i}) OVER ()) / (CASE WHEN stddev_pop(x{i}) OVER () > 0 THEN stddev_pop(x{i}) OVER () ELSE 1 END)"
                       for i in range(len(exprs)))
    return [f"base AS (SELECT {key} AS id, {each} FROM {table})", f"f AS MATERIALIZED (SELECT id, [{scaled}] AS xs FROM base)"]


def _sql_is(column: str, values: list[str]) -> list[str]:
    mode = f"(SELECT {column} FROM q_table WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    return [f"(coalesce({column}, {mode}) = '{v}')::INT::DOUBLE" for v in values]


_EVENT_X = ["coalesce(value, (SELECT median(value) FROM events))", "coalesce(user_id::DOUBLE, (SELECT median(user_id) FROM events))",
            *[e.replace("q_table", "events") for e in _sql_is("event_type", ["click", "error", "purchase", "signup", "view"])]]
_DOC_X = ["coalesce(n_chars::DOUBLE, (SELECT median(n_chars) FROM documents))",
          *[e.replace("q_table", "documents") for e in _sql_is("lang", ["de", "en", "es", "fr"])]]


@register("isolation_forest", with_ctes(*sql_scaled("events", "event_id", _EVENT_X), "t AS (SELECT * FROM f)", *sql_forest(7, 100))
          + "SELECT id AS event_id, round(score, 6) AS score FROM forest")
def isolation_forest(spark, sf):
    ev = keyed(load(spark, sf, "events"), "event_id")
    feats, spec = FT.build_features(ev, ["value", "user_id", "event_type"])
    s = MD.isolation_forest(feats, spec.names, CONTAMINATION)
    return s.select(F.col("row_id").alias("event_id"), F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ M3
@register("ocsvm")
def ocsvm(spark, sf):
    feats, spec = customer_features(spark, sf)
    s = MD.ocsvm(feats, spec.names, nu=CONTAMINATION)
    return s.select(F.col("row_id").alias("c_custkey"), F.round("score", 6).alias("score"))


@register("ocsvm_certificate", f"""SELECT count(*) AS n_rows, true AS gap_below_a_thousandth, true AS dual_in_its_box,
    true AS bounded_at_most_nu, true AS support_at_least_nu, (1 + floor((count(*) - 1) * {CONTAMINATION}))::BIGINT AS n_flagged FROM customer""")
def ocsvm_certificate(spark, sf):
    """The fitted SVM with its duality gap, the shares of the nu-property and the rows at or above 0."""
    feats, spec = customer_features(spark, sf)
    model = MD.fit_ocsvm(feats, spec.names, CONTAMINATION)
    c = MD.ocsvm_certificate(feats, spec.names, model)
    facts = (c["n"], bool(-1e-9 <= c["gap"] < 1e-3 * abs(c["dual"])), bool(c["excess"] < 1e-6),
             bool(c["bounded_share"] <= CONTAMINATION + 1 / c["n"]), bool(c["support_share"] >= CONTAMINATION - 1 / c["n"]))
    scores = MD.ocsvm_scores(feats, spec.names, model)
    return scores.agg(*[F.lit(x).alias(name) for x, name in zip(facts, (
        "n_rows", "gap_below_a_thousandth", "dual_in_its_box", "bounded_at_most_nu", "support_at_least_nu"), strict=True)],
        F.count_if(F.col("score") >= -1e-9).alias("n_flagged")).select(
            F.col("n_rows").cast("long").alias("n_rows"), "gap_below_a_thousandth", "dual_in_its_box", "bounded_at_most_nu",
            "support_at_least_nu", "n_flagged")


@register("semi_supervised", with_ctes(
    *sql_scaled("documents", "doc_id", _DOC_X), "t AS (SELECT * FROM f WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))",
    *sql_forest(5, 150)) + "SELECT id AS doc_id, round(score, 6) AS score FROM forest")
def semi_supervised(spark, sf):
    docs = keyed(load(spark, sf, "documents"), "doc_id")
    feats, spec = FT.build_features(docs, ["n_chars", "lang"])
    labels = load(spark, sf, "labels").select(F.col("doc_id").cast("long").alias("row_id"),
                                              F.col("toxic").alias("label"))
    s = MD.semi_supervised(feats, spec.names, labels, CONTAMINATION)
    return s.select(F.col("row_id").alias("doc_id"), F.round("score", 6).alias("score"))


# M1, M3, M10 as facts that hold for any seed: every row scored, no null, the (1 - c) quantile at 0, planted rows found
def _facts(scores, planted):
    return scores.agg(F.count(F.lit(1)).alias("n_scores"), F.count_if(F.col("score").isNull()).alias("n_null"),
                      F.count_if(F.col("score") >= -1e-9).alias("n_flagged"),
                      F.count_if(planted & (F.col("score") >= 0)).alias("planted_flagged"))


def _sql_facts(table, planted):
    """Rows at or above the linear quantile at 1 - c: the order statistics from ceil((n - 1)(1 - c)) on."""
    return (f"SELECT count(*) AS n_scores, 0::BIGINT AS n_null, (count(*) - ceil((count(*) - 1) * {1 - CONTAMINATION}))::BIGINT"
            f" AS n_flagged, count(*) FILTER (WHERE {planted}) AS planted_flagged FROM {table}")


@register("isolation_forest_facts", _sql_facts("events", "event_id % 1000 = 7"))
def isolation_forest_facts(spark, sf):
    """events with planted rows, whose value is far outside."""
    ev = keyed(load(spark, sf, "events"), "event_id")
    far = F.col("event_id") % 1000 == 7
    ev = ev.withColumn("value", F.when(far, F.lit(1e5) + F.col("event_id")).otherwise(F.col("value")))
    feats, spec = FT.build_features(ev, ["value", "user_id"])
    return _facts(MD.isolation_forest(feats, spec.names, CONTAMINATION), F.col("row_id") % 1000 == 7)


@register("ocsvm_facts", _sql_facts("customer", "c_custkey % 500 = 7"))
def ocsvm_facts(spark, sf):
    """customers with planted balances; the nu-quantile of the margins puts 1 + floor((n - 1) nu) rows at or above 0."""
    c = keyed(load(spark, sf, "customer"), "c_custkey")
    far = F.col("c_custkey") % 500 == 7
    c = c.withColumn("c_acctbal", F.when(far, F.lit(9e4) + F.col("c_custkey")).otherwise(F.col("c_acctbal")))
    feats, spec = FT.build_features(c, ["c_acctbal", "c_nationkey"])
    return _facts(MD.ocsvm(feats, spec.names, nu=CONTAMINATION), F.col("row_id") % 500 == 7)


@register("semi_supervised_facts", "SELECT count(*) AS n_scores, 0::BIGINT AS n_null, "
          "count(*) FILTER (WHERE event_id % 1000 = 7) AS confirmed_flagged FROM events")
def semi_supervised_facts(spark, sf):
    """The planted events are confirmed, left out of the training rows, and still flagged."""
    ev = keyed(load(spark, sf, "events"), "event_id")
    far = F.col("event_id") % 1000 == 7
    ev = ev.withColumn("value", F.when(far, F.lit(1e5) + F.col("event_id")).otherwise(F.col("value")))
    feats, spec = FT.build_features(ev, ["value", "user_id"])
    labels = ev.filter(far).select("row_id", F.lit(1).alias("label"))
    facts = _facts(MD.semi_supervised(feats, spec.names, labels, CONTAMINATION), F.col("row_id") % 1000 == 7)
    return facts.select("n_scores", "n_null", F.col("planted_flagged").alias("confirmed_flagged"))


# ------------------------------------------------------------------ M2
@register("lof", with_ctes(*SQL_LOF) + "SELECT id AS c_custkey, round(score, 6) AS score FROM lof")
def lof(spark, sf):
    s, _, _ = customer_lof(spark, sf)
    return s.select(F.col("row_id").alias("c_custkey"), F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ M4
@register("quantile_labels", with_ctes(SQL_EZ) + """SELECT event_id, round(score, 6) AS score,
    CASE WHEN score >= (SELECT quantile_cont(score, 0.95) FROM ez) THEN 1 ELSE 0 END AS label FROM ez""")
def quantile_labels(spark, sf):
    ez = events_z(spark, sf)
    lab = EN.quantile_label_frame(ez.select("row_id", F.lit("zscore").alias("model_key"), "score"), CONTAMINATION)
    return lab.select(F.col("row_id").alias("event_id"), F.round("score", 6).alias("score"), "label")


# ------------------------------------------------------------------ M5, M6
def _sql_silhouette(name: str, labels: str) -> list[str]:
    """CTE ``name`` = Euclidean silhouette of ``labels`` (id, label) over the feature CTE f."""
    return [f"{name}_l AS ({labels})",
            f"{name}_f AS MATERIALIZED (SELECT f.*, label FROM f JOIN {name}_l USING (id))",
            f"""{name}_p AS (SELECT a.id AS a, a.label AS la, b.label AS lb,
                 sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)) AS d
               FROM {name}_f a JOIN {name}_f b ON a.id <> b.id)""",
            f"""{name}_s AS (SELECT a, CASE WHEN count(*) FILTER (WHERE lb = la) = 0 THEN 0.0 ELSE
                 (avg(d) FILTER (WHERE lb <> la) - avg(d) FILTER (WHERE lb = la))
                 / greatest(avg(d) FILTER (WHERE lb <> la), avg(d) FILTER (WHERE lb = la)) END AS s
               FROM {name}_p GROUP BY a)""",
            f"{name} AS (SELECT round_even(avg(s), 4) AS silhouette FROM {name}_s)"]


_Z_LABELS = ("SELECT id, CASE WHEN abs(x1) >= (SELECT quantile_cont(abs(x1), 0.95) FROM f) THEN 1 ELSE 0 END"
             " AS label FROM f")
_LOF_LABELS = ("SELECT id, CASE WHEN score >= (SELECT quantile_cont(score, 0.95) FROM lof) THEN 1 ELSE 0 END"
               " AS label FROM lof")


def _z_labels(feats):
    s = feats.select("row_id", F.abs("c_acctbal").alias("score"))
    thr = exact_quantile(s, "score", 1 - CONTAMINATION)
    return s.withColumn("label", (F.col("score") >= F.lit(thr)).cast("int"))


@register("silhouette", with_ctes(SQL_CF, *_sql_silhouette("sz", _Z_LABELS)) + "SELECT silhouette FROM sz")
def silhouette(spark, sf):
    feats, spec = customer_features(spark, sf)
    sil = MD.silhouette(feats, spec.names, _z_labels(feats))
    return spark.createDataFrame([(float(sil),)], "silhouette double")


SEL_WEIGHTS = {"zscore": 1.0, "lof": 1.3}


@register("model_selection", with_ctes(*SQL_LOF, *_sql_silhouette("sz", _Z_LABELS),
                                       *_sql_silhouette("sl", _LOF_LABELS))
          + """, bench AS (SELECT 'zscore' AS model_key, silhouette, 0 AS ord, 1.0 AS w FROM sz
                          UNION ALL SELECT 'lof', silhouette, 1, 1.3 FROM sl)
             SELECT model_key, silhouette, round((silhouette + 1) / 2 * w, 6) AS weighted,
               model_key = (SELECT model_key FROM bench ORDER BY (silhouette + 1) / 2 * w DESC, ord LIMIT 1)
                 AS is_best FROM bench""")
def model_selection(spark, sf):
    lof_s, feats, spec = customer_lof(spark, sf)
    lof_s = lof_s.cache()
    thr = exact_quantile(lof_s, "score", 1 - CONTAMINATION)
    lof_labels = lof_s.withColumn("label", (F.col("score") >= F.lit(thr)).cast("int"))
    sil_z = MD.silhouette(feats, spec.names, _z_labels(feats))
    sil_l = MD.silhouette(feats, spec.names, lof_labels)
    bench = spark.createDataFrame([("zscore", sil_z, True), ("lof", sil_l, True)],
                                  "model_key string, silhouette double, success boolean")
    best = MD.select_model(bench, SEL_WEIGHTS, order=("zscore", "lof")).first()["best_key"]
    w = F.when(F.col("model_key") == "lof", F.lit(SEL_WEIGHTS["lof"])).otherwise(F.lit(SEL_WEIGHTS["zscore"]))
    return bench.select("model_key", "silhouette", F.round((F.col("silhouette") + 1) / 2 * w, 6).alias("weighted"),
                        (F.col("model_key") == F.lit(best)).alias("is_best"))


# ------------------------------------------------------------------ M7-M9
@register("percentile_rank", """SELECT event_id, round((rank() OVER (ORDER BY value)
    + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / count(*) OVER (), 6) AS pct FROM events""")
def percentile_rank(spark, sf):
    ev = keyed(load(spark, sf, "events"), "event_id")
    pr = EN.percentile_ranks(ev.select("row_id", F.lit("value").alias("model_key"), F.col("value").alias("score")))
    return pr.select(F.col("row_id").alias("event_id"), F.round("pct", 6).alias("pct"))


def _ensemble(spark, sf):
    return EN.ensemble(events_long_scores(spark, sf), CONTAMINATION, ENS_WEIGHTS)


_W_SUM = sum(ENS_WEIGHTS.values())


@register("ensemble", with_ctes(*SQL_LONG) + "SELECT event_id, round(sum(pct * CASE model_key " + " ".join(
    f"WHEN '{m}' THEN {w}" for m, w in ENS_WEIGHTS.items()) + f" END) / {_W_SUM}, 6) AS ensemble_score, "
    "bool_or(top) AS any_top FROM tops GROUP BY event_id")
def ensemble(spark, sf):
    e = _ensemble(spark, sf)
    return e.select(F.col("row_id").alias("event_id"), F.round("ensemble_score", 6).alias("ensemble_score"), "any_top")


@register("any_top", with_ctes(*SQL_LONG) + "SELECT event_id, " + ", ".join(
    f"bool_or(top) FILTER (WHERE model_key = '{m}') AS top_{m}" for m in ENS_MODELS)
    + ", bool_or(top) AS any_top FROM tops GROUP BY event_id")
def any_top(spark, sf):
    e = _ensemble(spark, sf)
    return e.select(F.col("row_id").alias("event_id"), *[f"top_{m}" for m in ENS_MODELS], "any_top")


# ------------------------------------------------------------------ R1-R6
@register("ranked", with_ctes(SQL_EZ) + """SELECT event_id, round(score, 6) AS score,
    row_number() OVER (ORDER BY score DESC, event_id) AS rank FROM ez""")
def ranked(spark, sf):
    r = RS.ranked(events_z(spark, sf).select("row_id", "score"))
    return r.select(F.col("row_id").alias("event_id"), F.round("score", 6).alias("score"), "rank")


@register("top_n", with_ctes(SQL_EZ) + "SELECT event_id, round(score, 6) AS score FROM ez "
                                       "ORDER BY score DESC, event_id LIMIT 20")
def top_n(spark, sf):
    t = RS.top_n(events_z(spark, sf).select("row_id", "score"), 20)
    return t.select(F.col("row_id").alias("event_id"), F.round("score", 6).alias("score"))


@register("result_metrics", with_ctes(*SQL_LONG) + """SELECT count(*) AS total,
    count(*) FILTER (WHERE score >= (SELECT quantile_cont(score, 0.95) FROM ez)) AS suspicious,
    round(count(*) FILTER (WHERE score >= (SELECT quantile_cont(score, 0.95) FROM ez)) / count(*) * 100, 6)
      AS suspicious_share,
    (SELECT count(*) FROM (SELECT event_id FROM tops GROUP BY event_id HAVING bool_or(top)) q) AS any_top_count
    FROM ez""")
def result_metrics(spark, sf):
    ez = events_z(spark, sf)
    thr = exact_quantile(ez, "score", 1 - CONTAMINATION)
    joined = ez.select("row_id", "score").join(_ensemble(spark, sf).select("row_id", "any_top"), "row_id")
    m = RS.result_metrics(joined, thr, "score", "any_top")
    return m.select("total", "suspicious", F.round("suspicious_share", 6).alias("suspicious_share"), "any_top_count")


@register("score_histogram", with_ctes(SQL_EZ, "b AS (SELECT min(score) AS lo, max(score) AS hi FROM ez)")
          + """SELECT bin, round(lo + (bin - 1) * (hi - lo) / 50, 6) AS bin_lo, round(lo + bin * (hi - lo) / 50, 6)
                AS bin_hi, count(*) AS count FROM (SELECT CAST(CASE WHEN hi > lo THEN
                least(floor((score - lo) / (hi - lo) * 50) + 1, 50) ELSE 1 END AS BIGINT) AS bin, lo, hi
                FROM ez, b) q GROUP BY bin, lo, hi""")
def score_histogram(spark, sf):
    h = RS.score_histogram(events_z(spark, sf).select("row_id", "score"), 50)
    return h.select("bin", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"), "count")


@register("id_first", with_ctes(SQL_EZ) + """SELECT event_id, user_id, round(score, 6) AS score,
    row_number() OVER (ORDER BY score DESC, event_id) AS rank, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
    event_type, value, props FROM ez""")
def id_first(spark, sf):
    ez = events_z(spark, sf)
    r = RS.ranked(ez, "score").drop("row_id")
    out = RS.id_first(r, ["event_id", "user_id"])
    return out.select("event_id", "user_id", F.round("score", 6).alias("score"), "rank",
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type", "value", "props")


@register("rescore_delta", with_ctes(
    SQL_EZ,
    "conf AS (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 10)",
    "st AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events WHERE event_id NOT IN (SELECT event_id FROM conf))",
    "nz AS (SELECT event_id, abs(value - m) / s AS score FROM events, st)")
    + """SELECT (SELECT count(*) FROM ez WHERE score >= (SELECT quantile_cont(score, 0.95) FROM ez)) AS old_suspicious,
       (SELECT count(*) FROM nz WHERE score >= (SELECT quantile_cont(score, 0.95) FROM nz)) AS new_suspicious,
       (SELECT count(*) FROM nz WHERE score >= (SELECT quantile_cont(score, 0.95) FROM nz))
       - (SELECT count(*) FROM ez WHERE score >= (SELECT quantile_cont(score, 0.95) FROM ez)) AS delta""")
def rescore_delta(spark, sf):
    """Re-score without the 10 confirmed (highest-value) events as the training set."""
    ez = events_z(spark, sf)
    confirmed = RS.top_n(ez.select("row_id", F.col("value").alias("v")), 10, "v").select("row_id")
    train = ez.join(confirmed, "row_id", "left_anti")
    st = train.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).first()
    nz = ez.select("row_id", (F.abs(F.col("value") - F.lit(st["m"])) / F.lit(st["s"])).alias("score"))
    old_t = exact_quantile(ez, "score", 1 - CONTAMINATION)
    new_t = exact_quantile(nz, "score", 1 - CONTAMINATION)
    return RS.rescore_delta(ez, nz, old_t, new_t)


# ------------------------------------------------------------------ M2 on a wide matrix
EMB_DIMS = 64
_EMB_COLS = [f"e{i}" for i in range(EMB_DIMS)]
_SQL_EMB = ("ef AS (SELECT vec_id AS id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(EMB_DIMS)) + " FROM embeddings)")
_SQL_EMB_DIST = " + ".join(f"(a.e{i} - b.e{i}) * (a.e{i} - b.e{i})" for i in range(EMB_DIMS))


@register("lof_embeddings", with_ctes(
    _SQL_EMB,
    f"d AS (SELECT a.id AS a, b.id AS b, sqrt({_SQL_EMB_DIST}) AS d FROM ef a JOIN ef b ON a.id <> b.id)",
    "nn AS (SELECT a, b, d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) q"
    " WHERE r <= 20)",
    "kd AS (SELECT a, max(d) AS kd FROM nn GROUP BY a)",
    "lrd AS (SELECT nn.a, 1.0 / (avg(greatest(kd.kd, nn.d)) + 1e-10) AS lrd FROM nn JOIN kd ON nn.b = kd.a"
    " GROUP BY nn.a)")
    + """SELECT l1.a AS vec_id, round(avg(l2.lrd) / l1.lrd, 6) AS score FROM nn JOIN lrd l1 ON nn.a = l1.a
         JOIN lrd l2 ON nn.b = l2.a GROUP BY l1.a, l1.lrd""")
def lof_embeddings(spark, sf):
    """M2 on the 64-dimensional embedding vectors (unscaled), exact."""
    e = load(spark, sf, "embeddings")
    feats = e.select(F.col("vec_id").alias("row_id"),
                     *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_EMB_COLS)])
    s = MD.lof(feats, _EMB_COLS, k=20)
    return s.select(F.col("row_id").alias("vec_id"), F.round("score", 6).alias("score"))
