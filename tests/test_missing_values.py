"""NaN and null values: missing everywhere, and no row is lost to them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddity.operators import ensemble as EN
from oddity.operators import features as FT
from oddity.operators import models as MD
from oddity.operators import order as OR
from oddity.operators import quality as QC
from oddity.operators import temporal as TP


def frame(spark, values, name="v"):
    return spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(values)], f"row_id long, {name} double")


def test_a_nan_does_not_switch_the_extreme_rule_off(spark):
    values = [1.0, 2.0] * 60 + [500.0]
    for extra in ([], [float("nan")], [None]):
        f, checks = QC.build_checks(frame(spark, values + extra))
        hits = QC.all_flags(f, checks).toPandas()
        assert hits[[c for c in hits.columns if c.startswith("extreme")]].to_numpy().sum() in (0, 1)
        column = next(c.flag for c in checks if c.flag.endswith("__v") and hits[c.flag].sum() == 1 and hits.loc[120, c.flag] == 1)
        assert column


def test_scaling_and_rule_features_skip_nan(spark):
    values = [1.0, 2.0, 3.0, float("nan"), None]
    feats, spec = FT.build_features(frame(spark, values), ["v"])
    x = feats.toPandas().sort_values("row_id")[spec.names].to_numpy()
    assert np.isfinite(x).all()
    assert FT.medians(frame(spark, values), ["v"]) == {"v": 2.0}
    assert FT.medians(frame(spark, [None, None]), ["v"]) == {"v": None}


def test_modes_take_the_least_of_equal_counts(spark):
    d = spark.createDataFrame([("b", "x"), ("a", None), ("b", None), ("a", None)], "p string, q string")
    assert FT.modes(d, ["p", "q"]) == {"p": "a", "q": "x"}
    assert FT.modes(d.where("q is null"), ["q"]) == {"q": None}


def test_ranks_keep_rows_without_score(spark):
    values = [1, 2, None, 3, float("nan")]
    want = pd.Series([1, 2, np.nan, 3, np.nan]).rank(pct=True)
    one = OR.percentile_rank(frame(spark, values, "score"), "score").toPandas().sort_values("row_id")
    assert np.allclose(one["pct"], want, equal_nan=True)
    long = frame(spark, values, "score").withColumn("model_key", F.lit("lof"))
    many = EN.percentile_ranks(long).toPandas().sort_values("row_id")
    assert np.allclose(many["pct"], want, equal_nan=True)
    e = EN.ensemble(long, 0.3).toPandas().sort_values("row_id")
    assert np.allclose(e["ensemble_score"], want, equal_nan=True) and e["any_top"].tolist() == [False, False, False, True, False]
    assert EN.ensemble(long.limit(0)).count() == 0


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_quantiles_leave_missing_scores_out(spark, p):
    d = frame(spark, [1, 2, None, 3, 4, float("nan")], "s")
    assert OR.exact_quantile(d, "s", p) == pytest.approx(np.quantile([1, 2, 3, 4], p))
    assert OR.exact_quantile(d.where("s is null"), "s", p) is None


def test_rows_without_date_come_last_in_the_band(spark):
    d = spark.createDataFrame([(0, None, 9.0), (1, "2024-01-02", 1.0), (2, "2024-01-01", float("nan")), (3, "2024-01-03", None)],
                              "row_id long, day string, v double")
    out = TP.rolling_band(d, "day", "v").toPandas().set_index("row_id")
    assert out["position"].to_dict() == {2: 0, 1: 1, 3: 2, 0: 3} and out["v"].notna().to_dict() == {0: True, 1: True, 2: False, 3: False}


def test_one_class_svm_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(900, 3))
    pdf = pd.DataFrame(X, columns=["a", "b", "c"])
    pdf.insert(0, "row_id", np.arange(900))
    d = spark.createDataFrame(pdf)
    runs = [MD.ocsvm(d.repartition(n), ["a", "b", "c"], nu=0.05).toPandas().set_index("row_id")["score"].sort_index() for n in (1, 3, 8)]
    assert all(np.abs(r - runs[0]).max() < 1e-9 for r in runs[1:])
    assert (runs[0] >= -1e-12).sum() == int(np.floor(899 * 0.05)) + 1


def test_forest_trees_sample_independently(spark):
    d = spark.range(60_000).select(F.col("id").alias("row_id"), F.rand(1).alias("x"))
    seen = MD.forest_samples(d, ["x"], 40, 256, 42).select("row_id").distinct().count()
    assert seen > 0.95 * 60_000 * (1 - (1 - 256 / 60_000) ** 40)
