"""Derived views over the driver tables, defined twice: as Spark DataFrames and
as SQL common-table expressions for the DuckDB oracle. Both must describe the
same rows; the SQL side is written independently of the Spark operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expressions import NUMBER_TEXT_RE


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def keyed(df: DataFrame, key: str) -> DataFrame:
    """The table with ``row_id`` = its unique key, first."""
    return df.select(F.col(key).cast("long").alias("row_id"), *df.columns)


# ---------------------------------------------------------------- dirty orders
def dirty_orders(spark: SparkSession, sf: str) -> DataFrame:
    """orders with price as text in six shapes (by o_orderkey % 6)."""
    o = load(spark, sf, "orders")
    p = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    ip = F.split_part(p, F.lit("."), F.lit(1))
    cents = F.split_part(p, F.lit("."), F.lit(2))
    m6 = F.col("o_orderkey") % 6
    tr = F.concat(F.regexp_replace(F.format_number(ip.cast("long"), 0), ",", "."), F.lit(","), cents)
    price = (F.when(m6 == 0, p).when(m6 == 1, tr).when(m6 == 2, F.concat(p, F.lit(" TL")))
             .when(m6 == 3, F.concat(F.lit("₺"), p)).when(m6 == 4, F.concat(ip, F.lit("\n."), cents))
             .otherwise(F.when(F.col("o_orderkey") % 12 == 5, F.lit("n/a"))))
    return o.select(F.col("o_orderkey").alias("row_id"), "o_orderkey", price.alias("price_text"),
                    F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
                    F.col("o_custkey").cast("string").alias("cust_ref"))


SQL_DIRTY = r"""dirty AS (
  SELECT o_orderkey,
    CASE o_orderkey % 6
      WHEN 0 THEN p
      WHEN 1 THEN replace(format('{:,}', CAST(ip AS BIGINT)), ',', '.') || ',' || cents
      WHEN 2 THEN p || ' TL'
      WHEN 3 THEN '₺' || p
      WHEN 4 THEN ip || chr(10) || '.' || cents
      ELSE CASE WHEN o_orderkey % 12 = 5 THEN 'n/a' END END AS price_text,
    o_orderstatus AS status, o_orderpriority AS priority,
    strftime(o_orderdate, '%Y-%m-%d') AS order_date, CAST(o_custkey AS VARCHAR) AS cust_ref
  FROM (SELECT *, split_part(p, '.', 1) AS ip, split_part(p, '.', 2) AS cents
        FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS p FROM orders) t0) t1)"""

DIRTY_TEXT_COLUMNS = ["price_text", "status", "priority", "order_date", "cust_ref"]


# ---------------------------------------------------------------- date text
def date_text(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    txt = F.when(F.col("o_orderkey") % 7 == 3, F.lit("not a date")) \
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(F.col("o_orderkey").alias("row_id"), "o_orderkey", txt.alias("order_date_text"))


SQL_DATE_TEXT = r"""date_text AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN 'not a date'
                          ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date_text FROM orders)"""


# ---------------------------------------------------------------- dates in many formats
def date_formats(spark: SparkSession, sf: str) -> DataFrame:
    """orders with their date as text in eleven formats, a part of each spoilt or in another format."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey").cast("long")
    seconds = (k % 24) * 3600 + (k % 60) * 60 + k % 59
    t = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + seconds)
    f = lambda pattern: F.date_format(t, pattern)
    first = F.lit(o.agg(F.min("o_orderkey")).first()[0])
    return o.select(
        k.alias("row_id"), "o_orderkey",
        F.when(k % 7 == 3, f("yyyy-MM-dd HH:mm:ss")).otherwise(f("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso_zone"),
        F.concat(f("yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0")).alias("millis"),
        F.when(k % 9 == 4, f("dd/MM/yyyy")).otherwise(f("MM/dd/yyyy")).alias("slashes"), f("dd.MM.yyyy").alias("dots"),
        F.when(k % 5 == 2, f("'Foo' dd, yyyy")).otherwise(f("MMM dd, yyyy")).alias("short_month"), f("dd MMMM yyyy").alias("long_month"),
        F.when(k % 11 == 2, f("'x'yyyyMMdd")).otherwise(f("yyyyMMdd")).alias("compact"), f("yyyy-MM-dd HH:mm:ss'+03:00'").alias("offset"),
        F.when(k % 13 == 6, f("MM/dd/yyyy HH:mm")).otherwise(f("MM/dd/yyyy hh:mm a")).alias("half_days"),
        F.when(k % 4 == 1, F.lit("NaT")).otherwise(f("dd-MM-yyyy")).alias("dashes"),
        F.when(k == first, F.lit("unknown")).when(k % 3 == 0, f("MMMM d, yyyy")).when(k % 3 == 1, f("yyyy-MM-dd")).otherwise(F.lit("n/a"))
        .alias("mixed"))


SQL_DATE_FORMATS = """df AS (SELECT o_orderkey,
    CASE WHEN k % 7 = 3 THEN strftime(t, '%Y-%m-%d %H:%M:%S') ELSE strftime(t, '%Y-%m-%dT%H:%M:%SZ') END AS iso_zone,
    strftime(t, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') AS millis,
    CASE WHEN k % 9 = 4 THEN strftime(t, '%d/%m/%Y') ELSE strftime(t, '%m/%d/%Y') END AS slashes,
    strftime(t, '%d.%m.%Y') AS dots,
    CASE WHEN k % 5 = 2 THEN strftime(t, 'Foo %d, %Y') ELSE strftime(t, '%b %d, %Y') END AS short_month,
    strftime(t, '%d %B %Y') AS long_month,
    CASE WHEN k % 11 = 2 THEN strftime(t, 'x%Y%m%d') ELSE strftime(t, '%Y%m%d') END AS compact,
    strftime(t, '%Y-%m-%d %H:%M:%S+03:00') AS "offset",
    CASE WHEN k % 13 = 6 THEN strftime(t, '%m/%d/%Y %H:%M') ELSE strftime(t, '%m/%d/%Y %I:%M %p') END AS half_days,
    CASE WHEN k % 4 = 1 THEN 'NaT' ELSE strftime(t, '%d-%m-%Y') END AS dashes,
    CASE WHEN k = first THEN 'unknown' WHEN k % 3 = 0 THEN strftime(t, '%B %-d, %Y') WHEN k % 3 = 1 THEN strftime(t, '%Y-%m-%d')
      ELSE 'n/a' END AS mixed
  FROM (SELECT o_orderkey, o_orderkey AS k, (SELECT min(o_orderkey) FROM orders) AS first,
        CAST(o_orderdate AS TIMESTAMP) + to_seconds((o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59) AS t FROM orders) q)"""


def _day_or_month_first(column: str, sep: str) -> str:
    """Month first, unless the first value has a number above 12 there."""
    first = f"(SELECT arg_min({column}, o_orderkey) FROM df WHERE {column} <> 'NaT')"
    return (f"CASE WHEN CAST(substr({first}, 1, 2) AS INTEGER) > 12 THEN try_strptime(value, '%d{sep}%m{sep}%Y') "
            f"ELSE try_strptime(value, '%m{sep}%d{sep}%Y') END")


#: How each column of the view reads, stated format by format.
SQL_READ_FORMATS = {
    "iso_zone": "try_strptime(value, '%Y-%m-%dT%H:%M:%SZ')", "millis": "try_strptime(value, '%Y-%m-%d %H:%M:%S.%g')",
    "slashes": _day_or_month_first("slashes", "/"), "dots": _day_or_month_first("dots", "."),
    "short_month": "try_strptime(value, '%b %d, %Y')", "long_month": "try_strptime(value, '%d %B %Y')",
    "compact": "CASE WHEN regexp_matches(value, '^[0-9]{8}$') THEN try_strptime(value, '%Y%m%d') END",
    "offset": "try_strptime(value, '%Y-%m-%d %H:%M:%S+03:00') - INTERVAL 3 HOUR",
    # a first value just after midnight shows 12 where the hour is 0, so each value is read on its own
    "half_days": "coalesce(try_strptime(value, '%m/%d/%Y %I:%M %p'), try_strptime(value, '%m/%d/%Y %H:%M'))", "dashes": _day_or_month_first("dashes", "-"),
    "mixed": "coalesce(try_strptime(value, '%B %d, %Y'), try_strptime(value, '%Y-%m-%d'))",
}
FORMAT_COLUMNS = list(SQL_READ_FORMATS)


# ---------------------------------------------------------------- customer variants
def customer_nulls(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    return keyed(c.select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("c_mktsegment")),
        "c_custkey")


SQL_CUSTOMER_NULLS = r"""cn AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer)"""


def customer_rules(spark: SparkSession, sf: str) -> DataFrame:
    """customer with digit-only names and a currency column."""
    c = load(spark, sf, "customer")
    m5 = F.col("c_custkey") % 5
    cur = (F.when(m5 == 0, F.lit("TRY")).when(m5 == 1, F.lit("usd")).when(m5 == 2, F.lit(" EUR "))
           .when(m5 == 3, F.lit("XYZ")).otherwise(F.lit("")))
    name = F.when(F.col("c_custkey") % 13 == 0, (F.col("c_custkey") * 7).cast("string")).otherwise(F.col("c_name"))
    return keyed(c.select("c_custkey", name.alias("c_name"), "c_nationkey", "c_acctbal", "c_mktsegment",
                          cur.alias("c_currency")), "c_custkey")


SQL_CUSTOMER_RULES = r"""cr AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 13 = 0 THEN CAST(c_custkey * 7 AS VARCHAR) ELSE c_name END AS c_name,
         c_nationkey, c_acctbal, c_mktsegment,
         CASE c_custkey % 5 WHEN 0 THEN 'TRY' WHEN 1 THEN 'usd' WHEN 2 THEN ' EUR '
                            WHEN 3 THEN 'XYZ' ELSE '' END AS c_currency FROM customer)"""


def customer_explain(spark: SparkSession, sf: str) -> DataFrame:
    """customer with a rare segment value (for the rare-value reasons)."""
    c = load(spark, sf, "customer")
    seg = (F.when(F.col("c_custkey") % 307 == 0, F.lit("RARE"))
           .when(F.col("c_custkey") % 11 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")))
    spend = F.col("c_acctbal") * F.when(F.col("c_custkey") % 97 == 0, F.lit(10.0)).otherwise(F.lit(1.0))
    return keyed(c.select("c_custkey", "c_acctbal", "c_nationkey", seg.alias("c_segment"), spend.alias("c_spend")),
                 "c_custkey")


SQL_CUSTOMER_EXPLAIN = r"""ce AS (
  SELECT c_custkey, c_acctbal, c_nationkey,
         CASE WHEN c_custkey % 307 = 0 THEN 'RARE' WHEN c_custkey % 11 = 0 THEN NULL
              ELSE c_mktsegment END AS c_segment,
         c_acctbal * CASE WHEN c_custkey % 97 = 0 THEN 10.0 ELSE 1.0 END AS c_spend FROM customer)"""


def nation_offices(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    m4 = F.col("n_nationkey") % 4
    office = (F.when(m4 == 0, F.concat(F.col("n_name"), F.lit(" GERMANY")))
              .when(m4 == 1, F.concat(F.lit("Şube "), F.col("n_name")))
              .when(m4 == 2, F.concat(F.lit("ıstanbul çin "), F.col("n_name")))
              .otherwise(F.col("n_name")))
    return keyed(n.select("n_nationkey", office.alias("office_location")), "n_nationkey")


SQL_NATION_OFFICES = r"""no AS (
  SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name || ' GERMANY'
                                            WHEN 1 THEN 'Şube ' || n_name
                                            WHEN 2 THEN 'ıstanbul çin ' || n_name
                                            ELSE n_name END AS office_location FROM nation)"""


# ---------------------------------------------------------------- SQL expression helpers
def sql_clean(x: str) -> str:
    """T1 in DuckDB SQL."""
    s = f"regexp_replace(regexp_replace({x}, '[\\r\\n\\t]+', '', 'g'), '\\s+', '', 'g')"
    s = f"regexp_replace({s}, '^(₺|\\$|€|£)', '')"
    s = f"regexp_replace({s}, '(?i)(TL|TRY|USD|EUR|GBP)$', '')"
    return (f"(CASE WHEN regexp_matches({s}, '{K.TR_NUMBER_RE}') "
            f"THEN replace(replace({s}, '.', ''), ',', '.') ELSE {s} END)")


def sql_parse(x: str) -> str:
    return (f"(CASE WHEN regexp_matches({x}, '{NUMBER_TEXT_RE}') OR lower({x}) IN "
            f"('inf','+inf','-inf','infinity','+infinity','-infinity') THEN TRY_CAST({x} AS DOUBLE) END)")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
