import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddity.functions import constants as K
from oddity.operators import features as FT
from oddity.operators import feedback as FB
from oddity.operators import kinds as KD
from oddity.operators import profile as PF
from oddity.operators import quality as QC
from oddity.operators import temporal as TM


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, "row_id long, " + schema)


def test_kind_precedence(spark):
    rows = [(i, "x", f"{i * 1.5:.2f}", f"2024-01-{i % 28 + 1:02d}", f"R{i}", f"A{i % 3}", str(i % 7),
             f"{1000 + i}") for i in range(100)]
    df = frame(spark, rows, "const string, tutar_text string, when_txt string, order_ref string, "
                            "cat string, small_int string, code string")
    kinds = {r["column"]: r["kind"] for r in KD.infer_kinds(df).collect()}
    assert kinds["const"] == K.KIND_EXCLUDED            # one value
    assert kinds["tutar_text"] == K.KIND_NUMERIC        # numeric name hint
    assert kinds["when_txt"] == K.KIND_DATETIME         # content parses as dates
    assert kinds["order_ref"] == K.KIND_ID              # ID name pattern
    assert kinds["cat"] == K.KIND_CATEGORICAL
    assert kinds["small_int"] == K.KIND_NUMERIC         # varying-length integers
    # 4-digit fixed-width codes: not numeric by content, distinct ratio 1.0 > 0.95 -> ID
    assert kinds["code"] == K.KIND_ID


def test_coerce_report_samples_and_counts(spark):
    rows = [(0, "1.234,56"), (1, "bad"), (2, None), (3, "worse"), (4, "bad"), (5, "12 TL")]
    df = frame(spark, rows, "amount string")
    typed, rep = KD.coerce_numeric(df, ["amount"])
    r = rep.first()
    assert (r["converted"], r["failed"], r["non_null_original"]) == (2, 3, 5)
    assert r["failed_samples"] == "bad | worse"
    assert [x[0] for x in typed.orderBy("row_id").select("amount").collect()] == [1234.56, None, None, None, None, 12.0]


def test_balanced_selection_numerics_never_stop_the_walk(spark):
    pdf = pd.DataFrame({f"n{i}": np.arange(50) % (i + 2) for i in range(40)})
    pdf.insert(0, "row_id", np.arange(50))
    df = spark.createDataFrame(pdf)
    q = PF.column_quality(df)
    sel = PF.balanced_selection(q, PF.id_columns(q)).toPandas()
    # numerics skip the limit check in the reference, so all 40 stay in
    assert sel["included"].sum() == 40


def test_balanced_selection_limit_after_categorical(spark):
    cols = {f"n{i}": np.arange(60) % (i + 2) for i in range(30)}
    cols["cat"] = np.array(["a", "b", "c"] * 20)
    cols["late_num"] = np.arange(60) % 5
    pdf = pd.DataFrame(cols)
    pdf.insert(0, "row_id", np.arange(60))
    q = PF.column_quality(spark.createDataFrame(pdf))
    sel = PF.balanced_selection(q, PF.id_columns(q)).toPandas().set_index("column")
    assert bool(sel.loc["cat", "included"])
    assert not bool(sel.loc["late_num", "included"])
    assert "doldu" in sel.loc["late_num", "reason"]


def test_quality_rules_on_small_frame(spark):
    rows = [(i, float(i) if i != 5 else -3.0, "12345" if i == 2 else f"Ali {i}", "usd" if i % 2 else "XYZ",
             "x\ty" if i == 3 else "ok", "1" if i < 3 else str(i)) for i in range(10)]
    df = frame(spark, rows, "tutar double, musteri_ad string, currency string, note string, id string")
    summ, flags = QC.run_quality_checks(df, allowed_currencies=["USD"], required_columns=["note"])
    got = {(r["rule"], r["column"]): r["count"] for r in summ.collect()}
    assert got[(K.RULE_NEGATIVE, "tutar")] == 1
    assert got[(K.RULE_ZERO, "tutar")] == 1
    assert got[(K.RULE_DIGITS_IN_NAME, "musteri_ad")] == 1
    assert got[(K.RULE_CURRENCY, "currency")] == 5
    assert got[(K.RULE_CONTROL_CHAR, "note")] == 1
    assert got[(K.RULE_DUPLICATE_ID, "id")] == 3         # column named exactly "id"
    assert (K.RULE_REQUIRED, "note") not in got          # no blank value
    assert f"{K.RULE_NEGATIVE}__tutar" in flags.columns
    assert f"{K.RULE_LONG_TEXT}__note" not in flags.columns  # no hit, no column
    visible, kept = QC.apply_toggles(summ, flags, K.DEFAULT_PRESET)
    assert K.RULE_NEGATIVE not in {r["rule"] for r in visible.collect()}
    assert f"{K.RULE_NEGATIVE}__tutar" not in kept.columns


def test_onehot_binary_keeps_second_and_single_stays(spark):
    rows = [(i, "b" if i % 2 else "a", "only") for i in range(6)]
    df = frame(spark, rows, "two string, one string")
    feats, spec = FT.build_features(df, ["two", "one"], scale=False)
    assert spec.names == ["two_b", "one_only"]


def test_frequency_feature_first_name_wins_and_null_share(spark):
    rows = [(i, None if i < 2 else ("a" if i < 6 else "b")) for i in range(10)]
    df = frame(spark, rows, "seg string")
    feats, spec = FT.build_features(df, ["seg"], max_onehot=1, rare_columns=["seg"], scale=False)
    assert spec.names == ["seg_freq", "seg_is_rare"]
    pdf = feats.orderBy("row_id").toPandas()
    # encoded share after mode imputation: nulls become "a" (6 of 10)
    assert pdf["seg_freq"].tolist()[:2] == [0.6, 0.6]


def test_scaling_population_std_and_constant(spark):
    rows = [(i, float(i), 7.0) for i in range(5)]
    df = frame(spark, rows, "x double, c double")
    feats, _ = FT.build_features(df, ["x", "c"])
    pdf = feats.orderBy("row_id").toPandas()
    x = np.arange(5.0)
    assert np.allclose(pdf["x"], (x - x.mean()) / x.std())
    assert np.allclose(pdf["c"], 0.0)


def test_rolling_band_matches_pandas_across_bucket_edges(spark):
    rng = np.random.default_rng(5)
    n = 700
    vals = rng.normal(size=n)
    vals[[50, 333, 650]] = [9.0, -8.0, 7.5]
    vals[[10, 11, 400]] = np.nan
    pdf = pd.DataFrame({"row_id": np.arange(n), "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "v": vals})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    out = TM.rolling_band(df, "ts", "v", 14, bucket_rows=64).toPandas().sort_values("position")
    s = pd.Series(vals)
    m = s.rolling(14, center=True, min_periods=3).mean()
    sd = s.rolling(14, center=True, min_periods=3).std().fillna(s.std())
    exp = (s > m + 2.5 * sd) | (s < m - 2.5 * sd)
    assert np.allclose(out["rolling_mean"].to_numpy(dtype=float), m.to_numpy(), equal_nan=True)
    assert np.allclose(out["rolling_std"].to_numpy(dtype=float), sd.to_numpy(), equal_nan=True)
    assert out["is_anomaly"].tolist() == exp.tolist()


def test_feedback_signature_insert_and_weights(spark):
    sig = FB.dataset_signature(spark, "data.csv", 100, ["b", "a"])
    h = hashlib.sha1()
    for part in (b"data.csv", b"100", b"|", b"a", b"|", b"b"):
        h.update(part)
    assert sig == h.hexdigest()[:16]
    schema = FB.FEEDBACK_SCHEMA
    ts = pd.Timestamp("2026-01-01").to_pydatetime()
    existing = spark.createDataFrame([(sig, "p", 1, 1, {"lof": 0.9}, "", ts)], schema)
    batch = spark.createDataFrame([(sig, "p", 1, 1, {"lof": 0.9}, "", ts), (sig, "p", 2, 0, {"lof": 0.8}, "", ts),
                                   (sig, "p", 2, 0, {"lof": 0.8}, "", ts)], schema)
    assert FB.insert(existing, batch).count() == 2  # duplicates inside a batch are kept
    rows = [(sig, "P", i, 1 if i < 8 else 0, {"lof": 0.9, "ensemble": 0.9}, "", ts) for i in range(12)]
    stats = FB.model_stats(spark.createDataFrame(rows, schema))
    w = {r["model_key"]: r["weight"] for r in FB.derived_weights(stats, "P", {"lof": 1.0, "ocsvm": 0.9}).collect()}
    assert w == {"lof": round(1.0 * (0.5 + 8 / 12), 3), "ocsvm": 0.9}


def test_summary_stats_distributed_quartiles_match_pandas(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"row_id": np.arange(501), "a": np.round(rng.normal(size=501), 2),
                        "b": rng.integers(0, 9, 501).astype(float)})
    pdf.loc[[3, 7], "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.when(F.isnan("a"), None).otherwise(F.col("a")))
    for frame in (df, spark.createDataFrame(pdf)):   # null, then NaN as missing
        s = PF.summary_stats(frame, ["a", "b"]).toPandas().set_index("column")
        d = pdf[["a", "b"]].describe()
        for c in ("a", "b"):
            assert s.loc[c, "count"] == d.loc["count", c]
            for q, k in (("25%", "q25"), ("50%", "q50"), ("75%", "q75")):
                assert s.loc[c, k] == pytest.approx(d.loc[q, c])
            assert s.loc[c, "std"] == pytest.approx(d.loc["std", c])


def test_numeric_auto_pick(spark):
    rows = [(i, f"{i},5" if i % 10 else "x", f"word{i}", str(1000 + i), "abc", f"{i}.{i % 7}")
            for i in range(60)]
    df = frame(spark, rows, "measure string, label string, acct_no string, tutar string, ratio_txt string")
    # measure: "12,5" is a Turkish decimal (-> 12.5), 54 of 60 parse = 90 % >= 85 % -> picked;
    # label: no value parses; acct_no: ID-like name, never picked; tutar: name hint; ratio_txt: all parse
    assert KD.auto_numeric_columns(df) == ["measure", "tutar", "ratio_txt"]
