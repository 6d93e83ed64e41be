"""Registered queries: coercion and kinds (T1-T8), profiling and column choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expressions import PY_WHITESPACE, clean_numeric_text, is_id_kind_name, name_has_hint
from ..operators import kinds as KD
from ..operators import profile as PF
from ..sources.files import scan_index
from .views import (DIRTY_TEXT_COLUMNS, FORMAT_COLUMNS, SQL_DATE_FORMATS, SQL_DATE_TEXT, SQL_DIRTY,
                    SQL_READ_FORMATS, date_formats, date_text, dirty_orders, keyed, load,
                    sql_clean, sql_parse, with_ctes)

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _r6(c):
    return F.round(c, 6)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_WHITESPACE}+|{PY_WHITESPACE}+$', '', 'g')"


def sql_unpivot(table: str, key: str, cols: list[str]) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT {key} AS rid, '{c.strip(chr(34))}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {table}" for c in cols)


DIRTY_ALL = ["o_orderkey"] + DIRTY_TEXT_COLUMNS
DIRTY_TYPES = {"o_orderkey": (True, False)}  # (is numeric, is datetime); the rest are text


def sql_meta(cols: list[str], types: dict, preset_hints=()) -> str:
    rows = []
    for i, c in enumerate(cols):
        is_num, is_dt = types.get(c, (False, False))
        flags = [is_num, is_dt, name_has_hint(c, K.NUMERIC_NAME_HINTS), name_has_hint(c, K.DATETIME_NAME_HINTS),
                 is_id_kind_name(c), bool(preset_hints) and name_has_hint(c, preset_hints)]
        rows.append(f"({i}, '{c}', " + ", ".join("true" if f else "false" for f in flags) + ")")
    return ("meta AS (SELECT * FROM (VALUES " + ", ".join(rows) +
            ") AS m(position, \"column\", is_num, is_dt, hint_num, hint_dt, id_name, hint_preset))")


#: Of the text columns of the dirty view one holds dates; few values of the others read as one (day or year numbers).
DIRTY_DATES = {"order_date": "try_strptime(value, '%Y-%m-%d')"}


def sql_dates(dates: dict) -> str:
    """CASE reading a value of the long form as a date, by column; other columns hold none."""
    return "(CASE " + " ".join(f"WHEN \"column\" = '{c}' THEN {e}" for c, e in dates.items()) + " END)"


def sql_content_ctes(table: str, key: str, cols: list[str], dates: dict = DIRTY_DATES) -> list[str]:
    """CTEs s500 (first 500 non-null per column) and ct (looks_numeric, looks_datetime)."""
    strip_v = sql_strip("value")
    return [
        f"lng AS ({sql_unpivot(table, key, cols)})",
        "s500 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY rid) AS rn "
        "FROM lng WHERE value IS NOT NULL) q WHERE rn <= 500)",
        f"""agg AS (SELECT "column", count(*) AS n500,
            count({sql_parse(sql_clean('value'))}) AS n_parse,
            avg(CASE WHEN regexp_matches({strip_v}, '[.,]\\d') THEN 1.0 ELSE 0.0 END) AS dec_share,
            bool_or(starts_with({strip_v}, '-')) AS any_neg,
            avg(CASE WHEN regexp_matches({strip_v}, '^0\\d') THEN 1.0 ELSE 0.0 END) AS lz_share,
            count(DISTINCT length({strip_v})) AS n_len,
            arg_min(length({strip_v}), rn) AS first_len,
            sum(CASE WHEN rn <= 200 THEN 1 ELSE 0 END) AS n200,
            sum(CASE WHEN rn <= 200 AND regexp_matches(value, '\\d') THEN 1 ELSE 0 END) AS n200_digit
          FROM s500 GROUP BY "column")""",
        f"""dp AS (SELECT "column", count({sql_dates(dates)}) AS n200_parse FROM s500 WHERE rn <= 200 GROUP BY "column")""",
        """ct AS (SELECT agg."column",
            CASE WHEN n_parse / n500 < 0.85 THEN false
                 WHEN dec_share > 0.05 OR any_neg THEN true
                 WHEN lz_share > 0.05 OR (n_len <= 2 AND first_len >= 4) THEN false
                 ELSE true END AS looks_numeric,
            (n200_digit / n200 >= 0.5) AND (coalesce(n200_parse, 0) / n200 >= 0.8) AS looks_datetime
          FROM agg LEFT JOIN dp ON agg."column" = dp."column")""",
    ]


def sql_stats(table: str, cols: list[str]) -> str:
    return "stats AS (" + "\n  UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nd, count(*) AS n, count(*) - count({c}) AS missing "
        f"FROM {table}" for c in cols) + ")"


def sql_kinds_ctes(table: str, key: str, cols: list[str], types: dict, preset_hints=()) -> list[str]:
    text_cols = [c for c in cols if types.get(c, (False, False)) == (False, False)]
    ctes = [sql_meta(cols, types, preset_hints), sql_stats(table, cols)] + sql_content_ctes(table, key, text_cols)
    ctes.append(f"""kinds AS (SELECT position, meta."column",
      CASE WHEN k0 = '{K.KIND_CATEGORICAL}' AND hint_preset THEN '{K.KIND_NUMERIC}' ELSE k0 END AS kind
      FROM (SELECT meta.*, CASE WHEN nd <= 1 THEN '{K.KIND_EXCLUDED}'
                WHEN is_num THEN '{K.KIND_NUMERIC}' WHEN is_dt THEN '{K.KIND_DATETIME}'
                WHEN hint_num THEN '{K.KIND_NUMERIC}' WHEN hint_dt THEN '{K.KIND_DATETIME}'
                WHEN id_name THEN '{K.KIND_ID}'
                WHEN coalesce(looks_numeric, false) THEN '{K.KIND_NUMERIC}'
                WHEN coalesce(looks_datetime, false) THEN '{K.KIND_DATETIME}'
                WHEN (CASE WHEN n > 0 THEN nd / n ELSE 0 END) > 0.95 THEN '{K.KIND_ID}'
                ELSE '{K.KIND_CATEGORICAL}' END AS k0
            FROM meta JOIN stats ON meta."column" = stats."column"
            LEFT JOIN ct ON meta."column" = ct."column") meta)""")
    return ctes


def _dirty(spark, sf):
    return dirty_orders(spark, sf)


# ------------------------------------------------------------------------- T1
@register("numeric_clean", with_ctes(SQL_DIRTY) +
          f"SELECT o_orderkey, price_text, {sql_clean('price_text')} AS cleaned FROM dirty")
def numeric_clean(spark, sf):
    d = _dirty(spark, sf)
    return d.select("o_orderkey", "price_text", clean_numeric_text(F.col("price_text")).alias("cleaned"))


# ------------------------------------------------------------------------- T2
_SQL_REPORT = """SELECT '{col}' AS "column", count(newv) AS converted,
  count(*) FILTER (WHERE orig IS NOT NULL AND newv IS NULL) AS failed,
  count(orig) AS non_null_original,
  coalesce((SELECT string_agg(v, ' | ' ORDER BY f) FROM
     (SELECT orig AS v, min(rid) AS f FROM {x} WHERE orig IS NOT NULL AND newv IS NULL
      GROUP BY orig ORDER BY f LIMIT 5) q), '') AS failed_samples,
  false AS already_typed FROM {x}"""


@register("numeric_coerce_report", with_ctes(
    SQL_DIRTY, f"x AS (SELECT o_orderkey AS rid, price_text AS orig, "
               f"{sql_parse(sql_clean('price_text'))} AS newv FROM dirty)")
    + _SQL_REPORT.format(col="price_text", x="x"))
def numeric_coerce_report(spark, sf):
    _, rep = KD.coerce_numeric(_dirty(spark, sf), ["price_text"])
    return rep


# ------------------------------------------------------------------------- T3
@register("datetime_coerce_report", with_ctes(
    SQL_DATE_TEXT, "x AS (SELECT o_orderkey AS rid, order_date_text AS orig, try_strptime(order_date_text, '%Y-%m-%d') AS newv FROM date_text)")
    + _SQL_REPORT.format(col="order_date_text", x="x"))
def datetime_coerce_report(spark, sf):
    _, rep = KD.coerce_datetime(date_text(spark, sf), ["order_date_text"])
    return rep


@register("datetime_formats_report", with_ctes(
    SQL_DATE_FORMATS, *[f"x_{c} AS (SELECT rid, orig, {e} AS newv FROM (SELECT o_orderkey AS rid, \"{c}\" AS orig, \"{c}\" AS value FROM df) q)"
                        for c, e in SQL_READ_FORMATS.items()])
    + "\n UNION ALL ".join(_SQL_REPORT.format(col=c, x=f"x_{c}") for c in FORMAT_COLUMNS))
def datetime_formats_report(spark, sf):
    """T3 on eleven formats: month or day first, names of months, fractions, offsets, compact digits, none at all."""
    _, rep = KD.coerce_datetime(date_formats(spark, sf), FORMAT_COLUMNS)
    return rep


@register("datetime_formats_values", with_ctes(SQL_DATE_FORMATS) + "SELECT o_orderkey, " + ", ".join(
    f"strftime((SELECT {e} FROM (SELECT \"{c}\" AS value) v), '%Y-%m-%d %H:%M:%S.%g') AS \"{c}\"" for c, e in SQL_READ_FORMATS.items())
    + " FROM df")
def datetime_formats_values(spark, sf):
    typed, _ = KD.coerce_datetime(date_formats(spark, sf), FORMAT_COLUMNS)
    return typed.select("o_orderkey", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias(c) for c in FORMAT_COLUMNS])


# ------------------------------------------------------------------------- T4/T5
@register("content_kind_tests", with_ctes(SQL_DIRTY, *sql_content_ctes("dirty", "o_orderkey", DIRTY_TEXT_COLUMNS))
          + 'SELECT "column", looks_numeric, looks_datetime FROM ct')
def content_kind_tests(spark, sf):
    return KD.content_tests(_dirty(spark, sf), DIRTY_TEXT_COLUMNS)


@register("content_kind_formats", with_ctes(SQL_DATE_FORMATS, *sql_content_ctes(
    "df", "o_orderkey", [f'"{c}"' for c in FORMAT_COLUMNS], SQL_READ_FORMATS)) + 'SELECT "column", looks_numeric, looks_datetime FROM ct')
def content_kind_formats(spark, sf):
    return KD.content_tests(date_formats(spark, sf), FORMAT_COLUMNS)


# ------------------------------------------------------------------------- T6
@register("kind_inference", with_ctes(SQL_DIRTY, *sql_kinds_ctes("dirty", "o_orderkey", DIRTY_ALL, DIRTY_TYPES))
          + 'SELECT position, "column", kind FROM kinds')
def kind_inference(spark, sf):
    return KD.infer_kinds(_dirty(spark, sf))


CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUSTOMER_TYPES = {"c_custkey": (True, False), "c_nationkey": (True, False), "c_acctbal": (True, False)}
FIN_HINTS = K.PRESETS["İşlem / Finans Verisi"]["numeric_hints"]


@register("kind_inference_typed", with_ctes(*sql_kinds_ctes("customer", "c_custkey", CUSTOMER_COLS,
                                                             CUSTOMER_TYPES, FIN_HINTS))
          + 'SELECT position, "column", kind FROM kinds')
def kind_inference_typed(spark, sf):
    """T6 on a typed table with the finance preset's extra numeric hints."""
    return KD.infer_kinds(keyed(load(spark, sf, "customer"), "c_custkey"), preset_hints=FIN_HINTS)


# ------------------------------------------------------------------------- T7
@register("apply_kinds", with_ctes(SQL_DIRTY) + f"""SELECT o_orderkey,
  round({sql_parse(sql_clean('price_text'))}, 6) AS price_text, status, priority,
  strftime(try_strptime(order_date, '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS order_date, cust_ref FROM dirty""")
def apply_kinds(spark, sf):
    d = _dirty(spark, sf)
    kinds = {r["column"]: r["kind"] for r in KD.infer_kinds(d).collect()}  # one row per column
    typed, _ = KD.apply_kinds(d, kinds)
    return typed.select("o_orderkey", _r6(F.col("price_text")).alias("price_text"), "status", "priority",
                        F.date_format("order_date", "yyyy-MM-dd HH:mm:ss").alias("order_date"), "cust_ref")


# ------------------------------------------------------------------------- T8
@register("column_type_split", with_ctes(
    SQL_DIRTY, sql_meta(DIRTY_ALL, DIRTY_TYPES), f"lng AS ({sql_unpivot('dirty', 'o_orderkey', DIRTY_TEXT_COLUMNS)})",
    "s50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY rid) AS rn "
    "FROM lng WHERE value IS NOT NULL) q WHERE rn <= 50)",
    f"share AS (SELECT \"column\", count({sql_dates(DIRTY_DATES)}) / count(*) AS dt_share FROM s50 GROUP BY \"column\")")
    + """SELECT position, meta."column", CASE WHEN is_num THEN 'numeric' WHEN is_dt THEN 'datetime'
           WHEN coalesce(dt_share, 0) > 0.8 THEN 'datetime' ELSE 'categorical' END AS type_group
         FROM meta LEFT JOIN share ON meta."column" = share."column\"""")
def column_type_split(spark, sf):
    return KD.column_type_split(_dirty(spark, sf))


@register("column_type_split_formats", with_ctes(
    SQL_DATE_FORMATS, f"lng AS ({sql_unpivot('df', 'o_orderkey', [chr(34) + c + chr(34) for c in FORMAT_COLUMNS])})",
    "s50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY rid) AS rn FROM lng) q WHERE rn <= 50)")
    + f"""SELECT "column", CASE WHEN count({sql_dates(SQL_READ_FORMATS)}) / count(*) > 0.8 THEN 'datetime' ELSE 'categorical' END
          AS type_group FROM s50 GROUP BY "column\"""")
def column_type_split_formats(spark, sf):
    return KD.column_type_split(date_formats(spark, sf).drop("o_orderkey")).drop("position")


# ------------------------------------------------------------------------- P1
@register("dataset_metrics", with_ctes(SQL_DIRTY) + "SELECT count(*) AS n_rows, 6 AS n_columns, CAST(" +
          " + ".join(f"(count(*) - count({c}))" for c in DIRTY_ALL) + " AS BIGINT) AS missing_cells FROM dirty")
def dataset_metrics(spark, sf):
    return PF.dataset_metrics(_dirty(spark, sf))


@register("preview_rows", with_ctes(SQL_DIRTY) +
          "SELECT o_orderkey, price_text, status, order_date FROM dirty ORDER BY o_orderkey LIMIT 100")
def preview_rows(spark, sf):
    return PF.preview(_dirty(spark, sf), 100).select("o_orderkey", "price_text", "status", "order_date")


# ------------------------------------------------------------------------- P2
@register("kind_review", with_ctes(SQL_DIRTY, *sql_kinds_ctes("dirty", "o_orderkey", DIRTY_ALL, DIRTY_TYPES),
                                   f"lall AS ({sql_unpivot('dirty', 'o_orderkey', DIRTY_ALL)})")
          + """SELECT kinds.position, kinds."column", kind, coalesce(fv.first_value, '') AS first_value,
                round_even(stats.missing / greatest(stats.n, 1) * 100, 1) AS missing_pct
               FROM kinds JOIN stats ON kinds."column" = stats."column"
               LEFT JOIN (SELECT "column", arg_min(value, rid) AS first_value FROM lall
                          WHERE value IS NOT NULL GROUP BY "column") fv ON kinds."column" = fv."column\"""")
def kind_review(spark, sf):
    d = _dirty(spark, sf)
    return PF.kind_review(d, KD.infer_kinds(d))


# ------------------------------------------------------------------------- P3
@register("conversion_report", with_ctes(
    SQL_DIRTY,
    f"x AS (SELECT o_orderkey AS rid, price_text AS orig, {sql_parse(sql_clean('price_text'))} AS newv FROM dirty)",
    f"y AS (SELECT o_orderkey AS rid, order_date AS orig, try_strptime(order_date, '%Y-%m-%d') AS newv "
    f"FROM dirty)",
    "rep AS (" + _SQL_REPORT.format(col="price_text", x="x") + " UNION ALL "
    + _SQL_REPORT.format(col="order_date", x="y") + ")")
    + """SELECT "column", converted, failed, failed_samples,
           CAST(sum(failed) OVER () AS BIGINT) AS total_failed FROM rep WHERE NOT already_typed""")
def conversion_report(spark, sf):
    d = _dirty(spark, sf)
    kinds = {r["column"]: r["kind"] for r in KD.infer_kinds(d).collect()}
    _, rep = KD.apply_kinds(d, kinds)
    from pyspark.sql import Window
    return (rep.filter(~F.col("already_typed"))
            .select("column", "converted", "failed", "failed_samples",
                    F.sum("failed").over(Window.partitionBy()).cast("long").alias("total_failed")))


# ------------------------------------------------------------------------- P4
ORDERS_NUM = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double")]


@register("summary_stats", "\n UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
        round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
        round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max,
        count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_distinct, '{t}' AS dtype FROM orders"""
    for c, t in ORDERS_NUM))
def summary_stats(spark, sf):
    o = keyed(load(spark, sf, "orders"), "o_orderkey")
    s = PF.summary_stats(o, [c for c, _ in ORDERS_NUM])
    return s.select("column", "count", *[_r6(F.col(c)).alias(c) for c in
                                         ("mean", "std", "min", "q25", "q50", "q75", "max")],
                    "missing", "n_distinct", "dtype")


# ------------------------------------------------------------------------- P5-P10
PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
PART_TYPES = {"p_partkey": (True, False), "p_size": (True, False), "p_retailprice": (True, False)}
DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]
DOC_TYPES = {"doc_id": (True, False), "n_chars": (True, False)}
LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_TYPES = {c: (True, False) for c in LINE_COLS[:8]} | {"l_shipdate": (False, True)}


def sql_quality_cte(table: str, key: str | None, cols: list[str], types: dict) -> list[str]:
    text_cols = [c for c in cols if not types.get(c, (False, False))[0]]
    words = ""
    ctes = [sql_meta(cols, types), sql_stats(table, cols)]
    if text_cols and key:
        ctes.append(f"lw AS ({sql_unpivot(table, key, text_cols)})")
        ctes.append(f"""words AS (SELECT "column", avg(len(list_filter(
            regexp_split_to_array(value, '{PY_WHITESPACE}+'), lambda w: w <> ''))) AS avg_words
          FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY rid) AS rn
                FROM lw WHERE value IS NOT NULL) q WHERE rn <= 200 GROUP BY "column")""")
        words = 'LEFT JOIN words ON meta."column" = words."column"'
    avg_words = "coalesce(avg_words, 0)" if words else "0"
    ctes.append(f"""q0 AS (SELECT meta.position, meta."column", is_num, is_dt, nd, n, missing,
        CASE WHEN n > 0 THEN nd / n ELSE 0.0 END AS ratio, {avg_words} AS avg_words
        FROM meta JOIN stats ON meta."column" = stats."column" {words})""")
    ctes.append("""q1 AS (SELECT *, nd <= 1 AS c_const,
        CASE WHEN is_num THEN ratio > 0.95 ELSE ratio > 0.9 END AS c_idlike,
        (NOT is_num) AND nd > 1 AND avg_words > 3 AS c_free FROM q0)""")
    ctes.append("""quality AS (SELECT position, "column", is_num, is_dt, nd AS "unique",
        round_even(ratio, 3) AS unique_ratio, missing,
        CASE WHEN n > 0 THEN round_even(missing / n * 100, 1) ELSE 0.0 END AS missing_pct,
        c_const AS constant, c_idlike AS id_like, c_free AS free_text,
        (NOT is_num) AND nd > 50 AND NOT c_idlike AS high_cardinality,
        coalesce(nullif(concat_ws(', ', CASE WHEN c_const THEN 'constant' END,
            CASE WHEN c_idlike THEN 'id_like' END, CASE WHEN c_free THEN 'free_text' END,
            CASE WHEN (NOT is_num) AND nd > 50 AND NOT c_idlike THEN 'high_cardinality' END), ''), '-') AS flags,
        NOT c_idlike AND NOT c_const AND NOT c_free AS recommended FROM q1)""")
    return ctes


_QUALITY_OUT = ('SELECT position, "column", "unique", unique_ratio, missing, missing_pct, flags, recommended '
                'FROM quality')


def _quality_out(q):
    return q.select("position", "column", "unique", "unique_ratio", "missing", "missing_pct", "flags", "recommended")


@register("column_quality", with_ctes(*sql_quality_cte("part", "p_partkey", PART_COLS, PART_TYPES)) + _QUALITY_OUT)
def column_quality(spark, sf):
    return _quality_out(PF.column_quality(keyed(load(spark, sf, "part"), "p_partkey")))


@register("column_quality_text", with_ctes(*sql_quality_cte("documents", "doc_id", DOC_COLS, DOC_TYPES))
          + _QUALITY_OUT)
def column_quality_text(spark, sf):
    return _quality_out(PF.column_quality(keyed(load(spark, sf, "documents"), "doc_id")))


_SQL_IDS = f"""ids AS (SELECT "column" FROM quality WHERE regexp_matches("column", '(?i){K.ID_SELECT_NAME_RE}')
                   OR id_like)"""


@register("id_columns", with_ctes(*sql_quality_cte("part", "p_partkey", PART_COLS, PART_TYPES), _SQL_IDS)
          + 'SELECT DISTINCT "column" FROM ids')
def id_columns(spark, sf):
    return PF.id_columns(PF.column_quality(keyed(load(spark, sf, "part"), "p_partkey")))


@register("safe_columns", with_ctes(*sql_quality_cte("part", "p_partkey", PART_COLS, PART_TYPES))
          + 'SELECT position, "column" FROM quality WHERE recommended')
def safe_columns(spark, sf):
    return PF.safe_columns(PF.column_quality(keyed(load(spark, sf, "part"), "p_partkey")))


_R = K.SELECTION_REASONS


def sql_selection(max_columns=K.MAX_SELECTED_COLUMNS, max_mid=K.MAX_MEDIUM_CARD) -> list[str]:
    return [f"""sel0 AS (SELECT quality.*, ids."column" IS NOT NULL AS is_id FROM quality
                 LEFT JOIN ids ON quality."column" = ids."column")""",
            f"""sel1 AS (SELECT *, CASE WHEN is_id THEN '{_R["id"]}'
                  WHEN constant THEN '{_R["constant"]}'
                  WHEN id_like THEN '{_R["id_like"]}'
                  WHEN free_text THEN '{_R["free_text"]}' END AS skip_reason FROM sel0)""",
            f"""sel2 AS (SELECT *, skip_reason IS NULL AND NOT is_num AND NOT is_dt AND "unique" > {K.LOW_CARD_LIMIT}
                  AND "unique" <= {K.MEDIUM_CARD_LIMIT} AS mid FROM sel1)""",
            f"""sel3 AS (SELECT *, coalesce(sum(CASE WHEN mid THEN 1 ELSE 0 END) OVER (ORDER BY position
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mid_before FROM sel2)""",
            f"""sel4 AS (SELECT *, skip_reason IS NULL AND (is_num OR (NOT is_dt AND "unique" <= {K.LOW_CARD_LIMIT})
                  OR (mid AND mid_before < {max_mid})) AS inc,
                  CASE WHEN skip_reason IS NOT NULL THEN skip_reason WHEN is_num THEN '{_R["numeric"]}'
                       WHEN is_dt THEN '{_R["datetime"]}'
                       WHEN "unique" <= {K.LOW_CARD_LIMIT} THEN '{_R["low_card"]}'
                       WHEN mid AND mid_before < {max_mid} THEN '{_R["mid_card_in"]}'
                       WHEN mid THEN '{_R["mid_card_out"]}'
                       ELSE replace('{_R["high_card"]}', '{{n}}', CAST("unique" AS VARCHAR))
                  END AS reason0 FROM sel3)""",
            f"""sel5 AS (SELECT *, sum(CASE WHEN inc THEN 1 ELSE 0 END) OVER (ORDER BY position
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sel_through FROM sel4)""",
            f"""sel6 AS (SELECT *, min(CASE WHEN skip_reason IS NULL AND NOT is_num AND NOT is_dt
                  AND sel_through >= {max_columns} THEN position END) OVER () AS stop_pos FROM sel5)""",
            f"""selection AS (SELECT position, "column", inc AND NOT coalesce(position > stop_pos, false) AS included,
                  CASE WHEN coalesce(position > stop_pos, false) THEN '{_R["limit"].format(max_columns=max_columns)}'
                       ELSE reason0 END AS reason FROM sel6)"""]


@register("balanced_selection", with_ctes(*sql_quality_cte("part", "p_partkey", PART_COLS, PART_TYPES), _SQL_IDS,
                                          *sql_selection()) + "SELECT * FROM selection")
def balanced_selection(spark, sf):
    q = PF.column_quality(keyed(load(spark, sf, "part"), "p_partkey"))
    return PF.balanced_selection(q, PF.id_columns(q))


@register("combo_eligible", with_ctes(*sql_quality_cte("lineitem", None, LINE_COLS, LINE_TYPES), _SQL_IDS,
                                      *sql_selection())
          + """SELECT quality.position, quality."column", quality."unique" FROM quality
               JOIN selection ON quality."column" = selection."column"
               WHERE selection.included AND NOT quality.is_num AND quality."unique" <= 200""")
def combo_eligible(spark, sf):
    df = scan_index(load(spark, sf, "lineitem"))
    li = df.drop("row_id")
    q = PF.column_quality(df.select("row_id", *LINE_COLS)).cache()  # one row per column, read three times
    sel = [r["column"] for r in PF.balanced_selection(q, PF.id_columns(q)).filter("included").collect()]
    return PF.combo_eligible(q, sel)


# ------------------------------------------------------------------------- P5 on conversation turns
CONV_COLS = ["conv_id", "turn", "role", "text"]
CONV_TYPES = {"conv_id": (True, False), "turn": (True, False)}
_SQL_CONV = "conv AS (SELECT conv_id * 100000 + turn AS rid, * FROM conversations)"


@register("column_quality_conversations", with_ctes(_SQL_CONV, *sql_quality_cte("conv", "rid", CONV_COLS, CONV_TYPES))
          + _QUALITY_OUT)
def column_quality_conversations(spark, sf):
    """P5 on (conv_id, turn)-keyed turns; row order is conversation, then turn."""
    c = load(spark, sf, "conversations")
    df = c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("row_id"), *CONV_COLS)
    return _quality_out(PF.column_quality(df))


# ------------------------------------------------------------------------- T2 with automatic column choice
def _sql_autopick() -> str:
    """Report rows for the text columns T2 would pick by itself on the dirty view."""
    cand = [c for c in DIRTY_TEXT_COLUMNS if not is_id_kind_name(c)]
    parts = []
    for c in cand:
        hint = "true" if name_has_hint(c, K.NUMERIC_NAME_HINTS) else "false"
        picked = (f"({hint} OR (SELECT count({sql_parse(sql_clean('v'))}) / count(*) FROM (SELECT {c} AS v FROM dirty "
                  f"WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 500) s) >= 0.85)")
        x = (f"(SELECT o_orderkey AS rid, {c} AS orig, {sql_parse(sql_clean(c))} AS newv FROM dirty)")
        parts.append(_SQL_REPORT.format(col=c, x=x.replace("FROM dirty)", "FROM dirty) xx")) + f" HAVING {picked}")
    return with_ctes(SQL_DIRTY) + "\nUNION ALL ".join(parts)


@register("numeric_autopick", _sql_autopick())
def numeric_autopick(spark, sf):
    """T2 without a column list: name hint, or >= 85 % of the first 500 values parse; never ID names."""
    _, rep = KD.coerce_numeric(_dirty(spark, sf), None)
    return rep
