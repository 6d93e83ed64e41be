import random
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddity.functions import dates as D
from oddity.functions.expressions import clean_numeric_text, py_strip, to_number, word_count
from oddity.operators import order as OR


@pytest.mark.parametrize("text,cleaned,number", [
    ("1.234,56", "1234.56", 1234.56),
    ("0.900", "0900", 900.0),          # matches the Turkish thousands pattern
    ("1234,56", "1234,56", None),      # no thousands group: not a number
    ("1,234.56", "1,234.56", None),
    ("123.45 TL", "123.45", 123.45),
    ("₺12", "12", 12.0),
    ("$ 7", "7", 7.0),
    ("5usd", "5", 5.0),
    ("0\n\n\n.90", "0.90", 0.9),
    ("n/a", "n/a", None),
    ("1d", "1d", None),                # Spark would cast this; pandas does not
    ("nan", "nan", None),
    ("-3e2", "-3e2", -300.0),
])
def test_numeric_cleaning(spark, text, cleaned, number):
    row = spark.createDataFrame([(text,)], "x string").select(
        clean_numeric_text(F.col("x")).alias("c"), to_number(F.col("x")).alias("n")).first()
    assert row["c"] == cleaned
    assert row["n"] == number


FORMATS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S+03:00", "%Y-%m-%d %H:%M:%S-0530",
           "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y", "%m-%d-%Y", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%Y%m%d%H%M%S", "%b %d, %Y", "%d %B %Y", "%d-%b-%Y",
           "%m/%d/%Y %I:%M %p", "%A, %d %B %Y", "%Y-%m-%d %H:%M", "%Y", "%Y-%m", "%d.%m.%Y %H:%M", "%m/%d/%y", "%Y-%m-%d %H:%M:%S UTC"]


def test_dates_equal_pandas_in_many_formats(spark):
    rnd = random.Random(6)
    some = lambda f: (pd.Timestamp(rnd.randrange(-10 ** 9, 4 * 10 ** 9), unit="s") + pd.Timedelta(microseconds=rnd.randrange(10 ** 6))).strftime(f)
    columns = []
    for f in FORMATS:
        values = [some(f) for _ in range(25)]
        values += [v[:-1] for v in values[:5]] + [v.replace("0", "", 1) for v in values[:9]] + [v.upper() for v in values[:3]]
        values += [some(rnd.choice(FORMATS)) for _ in range(10)] + ["", "NaT", "not a date", "2999-01-01", None, "12", "31.02.2024", "02/30/2024"]
        columns.append(["NaT", None, "", *values] if rnd.random() < 0.3 else values)
    for f, values in zip(FORMATS, columns, strict=True):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            read = pd.to_datetime(pd.Series(values, dtype=object), errors="coerce")
        # where offsets differ, pandas keeps objects of any year, and missing text as it is
        want = [None if isinstance(t, str) or pd.isna(t) or not 1677 < t.year < 2262 else pd.Timestamp(t) for t in read]
        want = [t and (t.tz_convert("UTC").tz_localize(None) if t.tzinfo else t).floor("us") for t in want]
        first = next(v for v in values if v and v not in D.MISSING)
        d = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        got = {r["i"]: r["t"] for r in d.select("i", D.to_timestamp(F.col("v"), first).cast("string").alias("t")).collect()}
        assert [None if got[i] is None else pd.Timestamp(got[i]) for i in range(len(values))] == want, f


def test_date_formats_put_the_month_first_unless_forced():
    shown = {"05.03.2024": "%m.%d.%Y", "25/12/2024": "%d/%m/%Y", "2024-01-05T10:00:00Z": "%Y-%m-%dT%H:%M:%S%z", "Jan 5, 2024": "%b %d, %Y",
             "2024-01-05 10:00:00.123": "%Y-%m-%d %H:%M:%S.%f", "05-03-2024": "%m-%d-%Y", "20240105": "%Y%m%d", "hello": None, None: None, "NaT": None}
    assert {v: D.infer_format(v) for v in shown} == shown


def test_whitespace_helpers(spark):
    row = spark.createDataFrame([("  a  b\tc 　",)], "x string").select(
        py_strip(F.col("x")).alias("s"), word_count(F.col("x")).alias("w")).first()
    assert row["s"] == "a  b\tc"
    assert row["w"] == 3


def test_row_number_global_is_dense_and_ordered(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"row_id": np.arange(3000), "s": rng.integers(0, 50, 3000).astype(float)})
    df = spark.createDataFrame(pdf).repartition(7)
    out = OR.row_number_global(df, [F.desc("s"), F.asc("row_id")]).toPandas()
    exp = pdf.sort_values(["s", "row_id"], ascending=[False, True]).reset_index(drop=True)
    exp["rn"] = np.arange(1, 3001)
    got = out.sort_values("rn").reset_index(drop=True)
    assert got["row_id"].tolist() == exp["row_id"].tolist()


def test_percentile_rank_matches_pandas_average_rank(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"row_id": np.arange(2000), "score": rng.integers(0, 30, 2000).astype(float)})
    out = OR.percentile_rank(spark.createDataFrame(pdf), "score").toPandas().sort_values("row_id")
    exp = pdf["score"].rank(pct=True, method="average").to_numpy()
    assert np.allclose(out["pct"].to_numpy(), exp)


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_quantiles_match_numpy(spark, p):
    rng = np.random.default_rng(3)
    vals = np.round(rng.normal(size=1001), 2)
    df = spark.createDataFrame(pd.DataFrame({"s": vals}))
    exp = float(np.quantile(vals, p))
    assert OR.exact_quantile(df, "s", p) == pytest.approx(exp)
    # the distributed path, used above the in-memory bound
    assert OR.quantile_from_distribution(OR.score_distribution(df, "s"), p) == pytest.approx(exp)


def test_dense_index_follows_partition_order(spark):
    df = spark.range(0, 1000, 1, 5).withColumnRenamed("id", "v")
    out = OR.dense_index(df).orderBy("row_id").toPandas()
    assert out["v"].tolist() == list(range(1000))
    assert out["row_id"].tolist() == list(range(1000))


@pytest.mark.parametrize("most", [1 << 16, 40])
def test_selected_quantiles_match_numpy(spark, most):
    rng = np.random.default_rng(3)
    groups = {"wide": rng.normal(size=30_000), "ties": rng.integers(0, 3, 20_000).astype(float), "few": np.array([4.0, 1.0]), "one": np.array([7.0]),
              "hot": np.where(np.arange(25_000) % 3 == 0, 0.25, rng.normal(size=25_000)), "ends": np.array([-np.inf, 0.0, 1.0, np.inf])}
    pdf = pd.DataFrame({"k": np.repeat(list(groups), [len(v) for v in groups.values()]), "x": np.concatenate(list(groups.values()))})
    d = spark.createDataFrame(pdf).union(spark.createDataFrame([("wide", None), ("void", None), ("few", float("nan"))], "k string, x double"))
    for p in (0.0, 0.5, 0.95, 1.0):
        got = OR.select_quantiles(d, p, "k", "x", most)
        want = {k: np.quantile(v, p) for k, v in groups.items() if k != "ends"}
        assert {k: got[k] for k in want} == pytest.approx(want) and "void" not in got

