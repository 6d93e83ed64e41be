"""Registered queries: data-quality rules (Q1-Q16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expressions import PY_WHITESPACE
from ..operators import quality as QC
from ..sources.files import scan_index
from .views import (FORMAT_COLUMNS, SQL_CUSTOMER_RULES, SQL_DATE_FORMATS, SQL_DATE_TEXT, SQL_DIRTY, SQL_READ_FORMATS,
                    customer_rules, date_formats, date_text, dirty_orders, keyed, load, sql_parse, with_ctes)

QUERIES, SQL = {}, {}
FINANCE = "İşlem / Finans Verisi"
ALLOWED = K.PRESETS[FINANCE]["allowed_currencies"]
AS_OF = "1990-06-01 00:00:00"


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_WHITESPACE}+|{PY_WHITESPACE}+$', '', 'g')"


def hits(df: DataFrame, keys: list[str], rules: set[str] | None = None, **kw) -> DataFrame:
    """Long (keys..., rule, column) rows for every rule a row breaks."""
    frame, checks = QC.build_checks(df, **kw)
    checks = [c for c in checks if rules is None or c.rule in rules]
    if not checks:
        return df.sparkSession.createDataFrame([], ", ".join(f"{k} long" for k in keys) + ", rule string, column string")
    parts = [F.when(c.predicate, F.struct(F.lit(c.rule).alias("rule"), F.lit(c.column).alias("column")))
             for c in checks]
    return (frame.select(*keys, F.explode(F.array(*parts)).alias("h")).filter(F.col("h").isNotNull())
            .select(*keys, "h.rule", "h.column"))


def sql_hits(table: str, keys: str, rule: str, col: str, cond: str) -> str:
    return f"SELECT {keys}, '{rule}' AS rule, '{col}' AS \"column\" FROM {table} WHERE {cond}"


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


# ------------------------------------------------------------------------- Q2
CUST_NUM = ["c_custkey", "c_nationkey", "c_acctbal"]


@register("dq_negative", union(sql_hits("customer", "c_custkey", K.RULE_NEGATIVE, c, f"{c} < 0") for c in CUST_NUM))
def dq_negative(spark, sf):
    c = keyed(load(spark, sf, "customer"), "c_custkey")
    return hits(c, ["c_custkey"], {K.RULE_NEGATIVE})


# ------------------------------------------------------------------------- Q3
LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]


@register("dq_zero", union(sql_hits("lineitem", "l_orderkey, l_linenumber", K.RULE_ZERO, c, f"{c} = 0")
                           for c in LINE_NUM))
def dq_zero(spark, sf):
    li = scan_index(load(spark, sf, "lineitem"))
    return hits(li, ["l_orderkey", "l_linenumber"], {K.RULE_ZERO})


# ------------------------------------------------------------------------- Q4
EV_NUM = ["event_id", "user_id", "value"]


@register("dq_extreme", with_ctes(
    "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in EV_NUM) + " FROM events)")
    + union(f"SELECT event_id, '{K.RULE_EXTREME}' AS rule, '{c}' AS \"column\" FROM events, st "
            f"WHERE s_{c} > 0 AND abs({c} - m_{c}) / s_{c} > 4" for c in EV_NUM))
def dq_extreme(spark, sf):
    ev = keyed(load(spark, sf, "events"), "event_id")
    return hits(ev, ["event_id"], {K.RULE_EXTREME})


# ------------------------------------------------------------------------- Q5, Q1
@register("dq_parse_number", with_ctes(SQL_DIRTY)
          + f"SELECT o_orderkey, price_text FROM dirty WHERE price_text IS NOT NULL "
            f"AND {sql_parse(sql_strip('price_text'))} IS NULL")
def dq_parse_number(spark, sf):
    d = dirty_orders(spark, sf)
    h = hits(d, ["o_orderkey"], {K.RULE_BAD_NUMBER}, kinds={"price_text": K.KIND_NUMERIC})
    return h.join(d.select("o_orderkey", "price_text"), "o_orderkey").select("o_orderkey", "price_text")


@register("dq_required", with_ctes(SQL_DIRTY)
          + f"SELECT o_orderkey FROM dirty WHERE price_text IS NULL OR {sql_strip('price_text')} = ''")
def dq_required(spark, sf):
    d = dirty_orders(spark, sf)
    return hits(d, ["o_orderkey"], {K.RULE_REQUIRED}, required_columns=["price_text"]).select("o_orderkey")


# ------------------------------------------------------------------------- Q6
@register("dq_parse_date", with_ctes(SQL_DATE_TEXT)
          + "SELECT o_orderkey, order_date_text FROM date_text WHERE order_date_text IS NOT NULL AND "
            "try_strptime(order_date_text, '%Y-%m-%d') IS NULL")
def dq_parse_date(spark, sf):
    d = date_text(spark, sf)
    h = hits(d, ["o_orderkey"], {K.RULE_BAD_DATE}, kinds={"order_date_text": K.KIND_DATETIME})
    return h.join(d.select("o_orderkey", "order_date_text"), "o_orderkey").select("o_orderkey", "order_date_text")


@register("dq_parse_date_formats", with_ctes(SQL_DATE_FORMATS) + "\n UNION ALL ".join(
    f"SELECT o_orderkey, '{c}' AS \"column\" FROM (SELECT o_orderkey, \"{c}\" AS value FROM df) q WHERE {e} IS NULL"
    for c, e in SQL_READ_FORMATS.items()))
def dq_parse_date_formats(spark, sf):
    """Q6 over eleven formats: the rows and columns whose text is not a date of the column's format."""
    kinds = dict.fromkeys(FORMAT_COLUMNS, K.KIND_DATETIME)
    return hits(date_formats(spark, sf), ["o_orderkey"], {K.RULE_BAD_DATE}, kinds=kinds).select("o_orderkey", "column")


# ------------------------------------------------------------------------- Q7, Q8
@register("dq_future_date",
          f"SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '{AS_OF}' + INTERVAL 3650 DAY")
def dq_future_date(spark, sf):
    o = keyed(load(spark, sf, "orders"), "o_orderkey").select("row_id", "o_orderkey", "o_orderdate")
    return hits(o, ["o_orderkey"], {K.RULE_FUTURE_DATE}, as_of=AS_OF).select("o_orderkey")


@register("dq_past_date", """SELECT o_orderkey FROM (SELECT o_orderkey,
      CASE WHEN o_orderkey % 97 = 0 THEN o_orderdate - INTERVAL 100 YEAR ELSE o_orderdate END AS d FROM orders) q
    WHERE d < TIMESTAMP '1900-01-01'""")
def dq_past_date(spark, sf):
    o = load(spark, sf, "orders")
    shifted = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_orderdate") - F.expr("INTERVAL 100 YEARS")) \
        .otherwise(F.col("o_orderdate"))
    o = o.select(F.col("o_orderkey").alias("row_id"), "o_orderkey", shifted.alias("d"))
    return hits(o, ["o_orderkey"], {K.RULE_PAST_DATE}, as_of=AS_OF).select("o_orderkey")


# ------------------------------------------------------------------------- Q9-Q13
DOC_TEXT = ["text", "lang", "source"]


@register("dq_control_chars", union(
    sql_hits("documents", "doc_id", K.RULE_CONTROL_CHAR, c, f"regexp_matches(coalesce({c}, ''), '{K.CONTROL_CHAR_RE}')")
    for c in DOC_TEXT))
def dq_control_chars(spark, sf):
    d = keyed(load(spark, sf, "documents"), "doc_id")
    return hits(d, ["doc_id"], {K.RULE_CONTROL_CHAR})


@register("dq_long_text", union(
    f"SELECT doc_id, '{c}' AS \"column\", length(coalesce({c}, '')) AS n_chars FROM documents "
    f"WHERE length(coalesce({c}, '')) > 200" for c in DOC_TEXT))
def dq_long_text(spark, sf):
    d = keyed(load(spark, sf, "documents"), "doc_id")
    h = hits(d, ["doc_id"], {K.RULE_LONG_TEXT})
    return h.join(d.select("doc_id", "text", "lang", "source"), "doc_id").select(
        "doc_id", "column",
        F.length(F.coalesce(F.when(F.col("column") == "text", F.col("text"))
                            .when(F.col("column") == "lang", F.col("lang")).otherwise(F.col("source")),
                            F.lit(""))).cast("long").alias("n_chars"))


@register("dq_digits_only", with_ctes(SQL_CUSTOMER_RULES)
          + "SELECT c_custkey, c_name FROM cr WHERE regexp_matches(coalesce(c_name, ''), '^\\s*\\d+\\s*$')")
def dq_digits_only(spark, sf):
    c = customer_rules(spark, sf)
    h = hits(c, ["c_custkey"], {K.RULE_DIGITS_IN_NAME})
    return h.join(c.select("c_custkey", "c_name"), "c_custkey").select("c_custkey", "c_name")


_ALLOWED_SQL = ", ".join(f"'{a}'" for a in ALLOWED)
_CUR_UP = sql_strip("upper(coalesce(c_currency, ''))")
_ISO_FMT = "'%Y-%m-%d'"


@register("dq_allowed_values", with_ctes(SQL_CUSTOMER_RULES)
          + f"SELECT c_custkey, c_currency FROM cr WHERE {_CUR_UP} NOT IN ({_ALLOWED_SQL}) AND {_CUR_UP} <> ''")
def dq_allowed_values(spark, sf):
    c = customer_rules(spark, sf)
    h = hits(c, ["c_custkey"], {K.RULE_CURRENCY}, allowed_currencies=ALLOWED)
    return h.join(c.select("c_custkey", "c_currency"), "c_custkey").select("c_custkey", "c_currency")


@register("dq_duplicate_id", """SELECT l_orderkey, l_linenumber FROM lineitem
    WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL
                         GROUP BY l_orderkey HAVING count(*) > 1)""")
def dq_duplicate_id(spark, sf):
    li = scan_index(load(spark, sf, "lineitem"))
    return hits(li, ["l_orderkey", "l_linenumber"], {K.RULE_DUPLICATE_ID},
                kinds={"l_orderkey": K.KIND_ID}).select("l_orderkey", "l_linenumber")


# ------------------------------------------------------------------------- Q14-Q16
CR_TEXT = ["c_name", "c_mktsegment", "c_currency"]


def _sql_summary_row(rule: str, col: str, cond: str) -> str:
    desc = QC._description(rule, K.LONG_TEXT_THRESHOLD, ALLOWED)
    return f"""SELECT '{rule}' AS rule, '{col}' AS "column", '{K.RULE_SEVERITY[rule]}' AS severity,
      count(*) AS count, round_even(count(*) / (SELECT count(*) FROM cr) * 100, 2) AS share,
      coalesce((SELECT string_agg(v, ', ' ORDER BY k) FROM (SELECT coalesce(CAST({col} AS VARCHAR), 'None') AS v,
                c_custkey AS k FROM cr WHERE {cond} ORDER BY c_custkey LIMIT 3) q), '') AS samples,
      '{desc}' AS description FROM cr WHERE {cond} HAVING count(*) > 0"""


def _sql_summary_parts() -> list[str]:
    parts = []
    for c in CUST_NUM:
        parts.append(_sql_summary_row(K.RULE_NEGATIVE, c, f"{c} < 0"))
        parts.append(_sql_summary_row(K.RULE_ZERO, c, f"{c} = 0"))
        parts.append(_sql_summary_row(
            K.RULE_EXTREME, c, f"(SELECT stddev_samp({c}) FROM cr) > 0 AND "
                               f"abs({c} - (SELECT avg({c}) FROM cr)) / (SELECT stddev_samp({c}) FROM cr) > 4"))
    for c in CR_TEXT:
        s = f"coalesce({c}, '')"
        parts.append(_sql_summary_row(K.RULE_CONTROL_CHAR, c, f"regexp_matches({s}, '{K.CONTROL_CHAR_RE}')"))
        parts.append(_sql_summary_row(K.RULE_LONG_TEXT, c, f"length({s}) > 200"))
        if any(t in c.lower() for t in K.NAME_TOKENS):
            parts.append(_sql_summary_row(K.RULE_DIGITS_IN_NAME, c,
                                          f"regexp_matches({s}, '^\\s*\\d+\\s*$') AND length({s}) > 0"))
        if any(t in c.lower() for t in K.CURRENCY_TOKENS):
            up = sql_strip(f"upper({s})")
            parts.append(_sql_summary_row(K.RULE_CURRENCY, c, f"{up} NOT IN ({_ALLOWED_SQL}) AND {up} <> ''"))
    return parts


SQL_SUMMARY = "summ AS (" + union(_sql_summary_parts()) + ")"


def _summary(spark, sf):
    summ, flags = QC.run_quality_checks(customer_rules(spark, sf), allowed_currencies=ALLOWED, as_of=AS_OF)
    return summ, flags


@register("dq_summary", with_ctes(SQL_CUSTOMER_RULES, SQL_SUMMARY) + "SELECT * FROM summ")
def dq_summary(spark, sf):
    return _summary(spark, sf)[0]


def _sql_flag_rows() -> str:
    rows = []
    for c in CUST_NUM:
        rows += [(K.RULE_NEGATIVE, c, f"{c} < 0"), (K.RULE_ZERO, c, f"{c} = 0")]
    for c in CR_TEXT:
        s = f"coalesce({c}, '')"
        if any(t in c.lower() for t in K.NAME_TOKENS):
            rows.append((K.RULE_DIGITS_IN_NAME, c, f"regexp_matches({s}, '^\\s*\\d+\\s*$') AND length({s}) > 0"))
        if any(t in c.lower() for t in K.CURRENCY_TOKENS):
            up = sql_strip(f"upper({s})")
            rows.append((K.RULE_CURRENCY, c, f"{up} NOT IN ({_ALLOWED_SQL}) AND {up} <> ''"))
    return union(f"SELECT c_custkey, '{r}__{c}' AS flag FROM cr WHERE {cond}" for r, c, cond in rows)


@register("dq_row_flags", with_ctes(SQL_CUSTOMER_RULES) + _sql_flag_rows())
def dq_row_flags(spark, sf):
    _, flags = _summary(spark, sf)
    cols = [c for c in flags.columns if c != "row_id"]
    parts = [F.when(F.col(c) == 1, F.lit(c)) for c in cols]
    return (flags.select(F.col("row_id").alias("c_custkey"), F.explode(F.array(*parts)).alias("flag"))
            .filter(F.col("flag").isNotNull()))


_GENEL = K.PRESETS[K.DEFAULT_PRESET]["rule_checks"]
_OFF = ", ".join(f"'{r}'" for r, on in _GENEL.items() if not on)


@register("dq_toggled", with_ctes(SQL_CUSTOMER_RULES, SQL_SUMMARY)
          + f"""SELECT rule, "column", count, CASE severity WHEN 'high' THEN 'Yüksek' WHEN 'medium' THEN 'Orta'
                WHEN 'low' THEN 'Düşük' ELSE 'Bilgi' END AS severity_label FROM summ WHERE rule NOT IN ({_OFF})""")
def dq_toggled(spark, sf):
    summ, flags = _summary(spark, sf)
    visible, _ = QC.apply_toggles(summ, flags, K.DEFAULT_PRESET)
    return visible.select("rule", "column", "count", "severity_label")


# ------------------------------------------------------------------------- Q9, Q10 on raw web pages
PAGE_TEXT = ["url", "html"]


@register("dq_text_pages", union(
    sql_hits("pages", "page_id", K.RULE_CONTROL_CHAR, c, f"regexp_matches(coalesce({c}, ''), '{K.CONTROL_CHAR_RE}')")
    for c in PAGE_TEXT) + "\nUNION ALL " + union(
    sql_hits("pages", "page_id", K.RULE_LONG_TEXT, c, f"length(coalesce({c}, '')) > 200") for c in PAGE_TEXT))
def dq_text_pages(spark, sf):
    p = keyed(load(spark, sf, "pages"), "page_id")
    return hits(p, ["page_id"], {K.RULE_CONTROL_CHAR, K.RULE_LONG_TEXT})
