"""Date text and content tests: each value is converted once, and only the rows that a sample needs are read."""

from __future__ import annotations

import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddity.functions import dates
from oddity.operators import kinds as KD
from oddity.operators import profile as PF


def _one_by_one(texts):
    return [pd.to_datetime(t, format="mixed", errors="coerce", utc=True).tz_localize(None) if t is not None else pd.NaT for t in texts]


@pytest.fixture
def read_alone(monkeypatch):
    """The texts that were read one by one."""
    seen, real = [], pd.to_datetime

    def counted(values, *args, **kw):
        if kw.get("format") == "mixed":
            seen.extend(values)
        return real(values, *args, **kw)
    monkeypatch.setattr(dates.pd, "to_datetime", counted)
    return seen


@pytest.mark.parametrize("pattern", ["%m/%d/%Y %I:%M %p", "%m/%d/%Y %H:%M:%S", "%B %d, %Y", "%d %b %Y %H:%M", "%d. %B %Y"])
def test_dates_of_one_shape_are_read_together(read_alone, pattern):
    texts = [t.strftime(pattern) for t in pd.date_range("1990-01-01 00:07", periods=3000, freq="37h")]
    got = dates._read_each(pd.Series(texts, dtype=object))
    assert read_alone == []
    assert list(got[:400]) == _one_by_one(texts[:400])


def test_texts_that_do_not_fit_the_common_shape_read_as_on_their_own():
    rows = [f"{m:02}/{d:02}/{y:04} {h:02}:{i:02}:{s:02}{p}" for m, d, y, h, i, s, p in itertools.product(
        (0, 2, 12, 13, 31), (1, 12, 13, 30), (31, 1699, 2024), (0, 12, 13), (5,), (7, 59, 60, 61), ("", " AM", " pm"))]
    rows += ["n/a", None, "today is", "", "NaT"] * 10
    got = dates._read_each(pd.Series(rows, dtype=object))
    want = pd.Series(_one_by_one(rows))
    assert got.isna().tolist() == want.isna().tolist() and got.dropna().tolist() == want.dropna().tolist()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_formats_read_their_fields(spark, zone):
    cases = [("%Y-%m-%d %H:%M:%S%z", "2001-02-03 04:05:06+03:30", "2001-02-03 00:35:06Z"), ("%Y-%m-%dT%H:%M:%S.%f%z", "2001-02-03T04:05:06.1234567-0230", "2001-02-03 06:35:06.123456Z"),
             ("%b %d, %Y %I:%M %p", "FEB  3, 2001 12:05 am", "2001-02-03 00:05:00"), ("%d %B %Y %I:%M %p", "3 February 2001 12:05 PM", "2001-02-03 12:05:00"),
             ("%d/%m/%Y", "30/02/2001", None), ("%Y-%m-%d %H:%M:%S", "2001-02-03 04:05:60", None), ("%Y%m%d", "20010203x", None),
             ("%Y-%m-%d %H:%M:%S", "1677-09-21 00:12:43", None), ("%Y-%m-%d %H:%M:%S", "1677-09-21 00:12:44", "1677-09-21 00:12:44"), ("%Y-%m-%d", "2262-04-12", None)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.range(1).select(*[(dates.parse_with(F.lit(v), f).eqNullSafe(F.lit(want).cast("timestamp"))).alias(str(i))
                                      for i, (f, v, want) in enumerate(cases)]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [c for c, ok in zip(cases, row) if not ok] == []


def _counting(spark, deterministic=True):
    n = spark.sparkContext.accumulator(0)

    def same(v):
        n.add(1)
        return v
    udf = F.udf(same, "string")
    return n, udf if deterministic else udf.asNondeterministic()


def test_report_converts_each_value_once(spark):
    n, same = _counting(spark, deterministic=False)
    df = spark.range(600).select(F.col("id").alias("row_id"), F.when(F.col("id") % 5 == 1, F.concat(F.lit("bad"), F.col("id") % 40))
                                 .when(F.col("id") % 5 > 1, F.col("id").cast("string")).alias("a"))
    _, rep = KD.coerce_report(df, ["a"], lambda d, c: same(F.col(c)).try_cast("int"), lambda t: False)
    assert [tuple(r) for r in rep.collect()] == [("a", 360, 120, 480, "bad1 | bad6 | bad11 | bad16 | bad21", False)]
    assert n.value == 600


def test_samples_read_the_leading_rows_only(spark):
    n, same = _counting(spark)
    df = spark.range(5000).select((4999 - F.col("id")).alias("row_id"), F.col("id").cast("string").alias("v"))
    got = PF.first_non_null(df.select("row_id", same("v").alias("v")), ["v"], 50).orderBy("rn").collect()
    assert [(r["rn"], r["row_id"], r["value"]) for r in got] == [(i + 1, i, str(4999 - i)) for i in range(50)]
    assert n.value < 1000


def test_first_values_of_sparse_and_null_keyed_rows(spark):
    rows = [(None, "k", None, None)] * 2 + [(i // 2, f"d{i // 2}", f"s{i}" if i % 90 == 89 else None, None) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, dense string, sparse string, none string").repartition(5)
    got = PF.first_non_null(df, ["dense", "sparse", "none"], 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    out = {c: [(r["row_id"], r["value"]) for r in got.where(F.col("column") == c).orderBy("rn").collect()] for c in ("dense", "sparse", "none")}
    assert out["dense"] == [(None, "k")] * 2 + [(0, "d0")] * 2 + [(1, "d1")] * 2 + [(2, "d2")]
    assert out["sparse"] == [(i // 2, f"s{i}") for i in range(900) if i % 90 == 89][:7]
    assert out["none"] == []


def test_the_first_date_may_come_late(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") == 2900, F.lit("13/02/2001")).when(F.col("id") > 2900, F.lit("03/02/2001")).alias("a"),
                                  F.lit("NaT").alias("b"))
    assert KD.first_values(df, ["a", "b"]) == {"a": "13/02/2001", "b": None}
    typed, rep = KD.coerce_datetime(df, ["a", "b"])
    assert typed.where("row_id = 2950").select(F.date_format("a", "yyyy-MM-dd")).first()[0] == "2001-02-03"
    assert {r["column"]: (r["converted"], r["failed"], r["failed_samples"]) for r in rep.collect()} == {"a": (100, 0, ""), "b": (0, 3000, "NaT")}
