"""Registered queries: feedback (B2-B6) and sources / sinks.

File round trips write under the session's checkpoint folder (the shared
folder on a cluster), never a machine-local temporary folder.
"""

from __future__ import annotations

import uuid
import zipfile

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import feedback as FB
from ..operators import results as RS
from ..operators.order import exact_quantile
from ..session import ensure_checkpoint_dir
from ..sources import files as SRC
from ..sources import sinks as SNK
from .q_models import SQL_EZ, events_z
from .views import load, with_ctes

QUERIES, SQL = {}, {}
PRESET = "İşlem / Finans Verisi"
SIG_COLUMNS = ["lang", "n_chars", "source"]


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ feedback entries
def entries(spark, sf, corrections: bool = False):
    """Feedback entries built from the labels table: label = toxic, scores derived from doc_id."""
    lab = load(spark, sf, "labels")
    n = load(spark, sf, "documents").agg(F.count(F.lit(1)).alias("_n"))
    d = F.col("doc_id")
    s_if, s_lof, s_oc = (d % 100) / 100.0, ((d * 7) % 100) / 100.0, ((d * 13) % 100) / 100.0
    scores = F.create_map(F.lit("isolation_forest"), s_if, F.lit("lof"), s_lof, F.lit("ocsvm"), s_oc,
                          F.lit("ensemble"), (s_if + s_lof + s_oc) / 3.0)
    base = lab.select(
        FB.signature_expr(F.lit("documents.parquet"), F.lit(n.first()["_n"]), SIG_COLUMNS).alias("signature"),
        F.lit(PRESET).alias("preset"), d.cast("long").alias("row_id"), F.col("toxic").cast("int").alias("label"),
        scores.alias("scores"), F.lit("").alias("note"),
        F.timestamp_seconds(F.lit(1767225600) + d).alias("ts"))
    if not corrections:
        return base
    fix = (base.filter(F.col("row_id") % 3 == 0)
           .withColumn("label", (1 - F.col("label")).cast("int"))
           .withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAYS")))
    return base.unionByName(fix)


SQL_ENTRIES = f"""e AS (SELECT substr(sha1('documents.parquet' || CAST((SELECT count(*) FROM documents) AS VARCHAR)
      || '{''.join('|' + c for c in sorted(SIG_COLUMNS))}'), 1, 16) AS signature, doc_id AS row_id, toxic AS label,
      (doc_id % 100) / 100.0 AS isolation_forest, ((doc_id * 7) % 100) / 100.0 AS lof,
      ((doc_id * 13) % 100) / 100.0 AS ocsvm, to_timestamp(1767225600 + doc_id) AS ts FROM labels)"""
SQL_EL = SQL_ENTRIES + """, el AS (SELECT row_id, label, 'isolation_forest' AS model_key, isolation_forest AS score FROM e
      UNION ALL SELECT row_id, label, 'lof', lof FROM e UNION ALL SELECT row_id, label, 'ocsvm', ocsvm FROM e)"""
SQL_STATS = SQL_EL + f""", stats AS (SELECT '{PRESET}' AS preset, model_key,
      count(*) FILTER (WHERE label = 1 AND score >= 0.7) AS true_positive,
      count(*) FILTER (WHERE label <> 1 AND score >= 0.7) AS false_positive,
      count(*) FILTER (WHERE label <> 1 AND score < 0.7) AS true_negative,
      count(*) FILTER (WHERE label = 1 AND score < 0.7) AS false_negative,
      coalesce(sum(score) FILTER (WHERE label = 1 AND score >= 0.7), 0.0) AS score_sum_tp,
      coalesce(sum(score) FILTER (WHERE label <> 1 AND score >= 0.7), 0.0) AS score_sum_fp FROM el GROUP BY model_key)"""
SQL_LATEST = SQL_ENTRIES + """, ev AS (SELECT signature, row_id, label, ts FROM e
      UNION ALL SELECT signature, row_id, 1 - label, ts + INTERVAL 1 DAY FROM e WHERE row_id % 3 = 0),
    latest AS (SELECT signature, row_id, arg_max(label, ts) AS label FROM ev GROUP BY signature, row_id)"""


@register("feedback_insert", "WITH " + SQL_ENTRIES + """ SELECT signature, row_id, label FROM e
    WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.row_id % 2 = 0 AND x.signature = e.signature
                      AND x.row_id = e.row_id AND x.label = e.label)""")
def feedback_insert(spark, sf):
    batch = entries(spark, sf)
    existing = batch.filter(F.col("row_id") % 2 == 0)
    return FB.insert(existing, batch).select("signature", "row_id", "label")


@register("model_stats", "WITH " + SQL_STATS + """ SELECT preset, model_key, true_positive, false_positive,
    true_negative, false_negative, round(score_sum_tp, 6) AS score_sum_tp, round(score_sum_fp, 6) AS score_sum_fp
    FROM stats""")
def model_stats(spark, sf):
    st = FB.model_stats(entries(spark, sf))
    return st.select("preset", "model_key", "true_positive", "false_positive", "true_negative", "false_negative",
                     F.round("score_sum_tp", 6).alias("score_sum_tp"), F.round("score_sum_fp", 6).alias("score_sum_fp"))


_BASE_W = K.PRESETS[PRESET]["model_weights"]


@register("derived_weights", "WITH " + SQL_STATS + ", base AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', {v})" for k, v in _BASE_W.items()) + """) AS b(model_key, w))
    SELECT coalesce(base.model_key, stats.model_key) AS model_key,
      CASE WHEN true_positive + false_positive >= 10
           THEN round_even(coalesce(w, 1.0) * (0.5 + true_positive / (true_positive + false_positive)), 3)
           ELSE w END AS weight
    FROM base FULL JOIN stats ON base.model_key = stats.model_key""")
def derived_weights(spark, sf):
    return FB.derived_weights(FB.model_stats(entries(spark, sf)), PRESET)


@register("latest_label", "WITH " + SQL_LATEST + " SELECT signature, row_id, label FROM latest")
def latest_label(spark, sf):
    return FB.latest_labels(entries(spark, sf, corrections=True))


@register("feedback_totals", "WITH " + SQL_LATEST + """ SELECT count(*) AS total,
    count(*) FILTER (WHERE label = 1) AS anomalies, count(*) FILTER (WHERE label = 0) AS normals FROM latest""")
def feedback_totals(spark, sf):
    return FB.totals(FB.latest_labels(entries(spark, sf, corrections=True)))


# ------------------------------------------------------------------ S1
@register("csv_scan", """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
    round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer""")
def csv_scan(spark, sf):
    path = scratch(spark, "customer-csv")
    load(spark, sf, "customer").write.option("header", True).csv(path)
    df = SRC.read_csv(spark, path)
    return df.select("c_custkey", "c_name", "c_nationkey", F.round("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment")


# ------------------------------------------------------------------ S2
@register("xml_scan", """SELECT CAST(c_custkey AS VARCHAR) AS "@key", c_name AS name, c_mktsegment AS origin_segment,
    CAST(c_nationkey AS VARCHAR) AS origin_nation, CAST(c_acctbal AS VARCHAR) AS balance FROM customer""")
def xml_scan(spark, sf):
    path = scratch(spark, "customer-xml")
    c = load(spark, sf, "customer")
    (c.select(F.col("c_custkey").alias("@key"), F.col("c_name").alias("name"),
              F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("origin"),
              F.col("c_acctbal").alias("balance"))
     .write.format("xml").option("rowTag", "record").option("rootTag", "records")
     .option("attributePrefix", "@").save(path))
    df = SRC.read_xml(spark, path, "record")
    return df.select("@key", "name", "origin_segment", "origin_nation", "balance")


# ------------------------------------------------------------------ S3
def _open_out(path: str, name: str):
    import pyarrow.fs as pafs
    if path.startswith("file:"):
        fs, target = pafs.LocalFileSystem(), path[len("file:"):]
        while target.startswith("//"):
            target = target[1:]
    else:
        fs, target = pafs.FileSystem.from_uri(path)
    fs.create_dir(target, recursive=True)
    return fs.open_output_stream(f"{target}/{name}")


def _zip_writer(path: str, cols: list[str]):
    def write(batches):
        pid, rows = TaskContext.get().partitionId(), 0
        with _open_out(path, f"part-{pid:05d}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
            with zf.open("data/orders.csv", "w", force_zip64=True) as member:
                member.write(pd.DataFrame(columns=cols).to_csv(index=False).encode())
                for pdf in batches:
                    member.write(pdf.to_csv(index=False, header=False).encode())
                    rows += len(pdf)
            zf.writestr("__MACOSX/data/._orders.csv", b"\x00\x05\x16\x07")
            zf.writestr("data/.hidden.csv", "x,y\n1,2\n")
            zf.writestr("data/readme.txt", "not a data file")
        yield pd.DataFrame({"part": [pid], "rows": [rows]})
    return write


ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@register("archive_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, "
                          "o_orderpriority FROM orders")
def archive_scan(spark, sf):
    path = scratch(spark, "orders-zip")
    o = load(spark, sf, "orders").select(*ORDER_COLS)
    o.mapInPandas(_zip_writer(path, ORDER_COLS), "part int, rows long").collect()  # one row per archive
    df = SRC.read_archive(spark, path)
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 6).alias("o_totalprice"),
                     "o_orderpriority")


# ------------------------------------------------------------------ S5
@register("result_sink", with_ctes(SQL_EZ) + """SELECT event_id, round(score, 6) AS score,
    row_number() OVER (ORDER BY score DESC, event_id) AS rank,
    score >= (SELECT quantile_cont(score, 0.95) FROM ez) AS is_highlighted FROM ez""")
def result_sink(spark, sf):
    ez = events_z(spark, sf).select("row_id", "score")
    thr = exact_quantile(ez, "score", 0.95)
    path = scratch(spark, "results")
    SNK.write_results(RS.ranked(ez), path, thr)
    back = spark.read.parquet(path)
    return back.select(F.col("row_id").alias("event_id"), F.round("score", 6).alias("score"), "rank", "is_highlighted")


# ------------------------------------------------------------------ S6
@register("feedback_table", "WITH " + SQL_ENTRIES + " SELECT signature, row_id, label FROM e")
def feedback_table(spark, sf):
    table = SNK.FeedbackTable(spark, scratch(spark, "feedback"))
    batch = entries(spark, sf)
    table.save(batch.filter(F.col("row_id") % 2 == 0))
    table.save(batch)  # only the rows not stored yet are appended
    return table.read().select("signature", "row_id", "label")
