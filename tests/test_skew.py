"""One value holding a third of all rows: results stay whole and exact."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddity.functions import constants as K
from oddity.operators import ensemble as EN
from oddity.operators import features as FT
from oddity.operators import kinds as KD
from oddity.operators import profile as PF
from oddity.operators import quality as QC
from oddity.operators import results as RS


@pytest.fixture(scope="module")
def hot(spark):
    n = 3000
    rng = np.random.default_rng(21)
    key = np.where(np.arange(n) % 3 == 0, 777, rng.integers(0, 5000, n))
    score = np.where(np.arange(n) % 3 == 0, 1.5, np.round(rng.normal(size=n), 3))
    pdf = pd.DataFrame({"row_id": np.arange(n), "id": key.astype(str), "score": score,
                        "seg": np.where(np.arange(n) % 3 == 0, "HOT", rng.choice(["a", "b", "c"], n))})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_value_frequencies_with_hot_value(hot):
    pdf, df = hot
    freq = PF.value_freq(df, ["id", "seg"]).toPandas()
    got = freq[(freq["column"] == "seg") & (freq["value"] == "HOT")]["n"].iloc[0]
    assert got == (pdf["seg"] == "HOT").sum()
    stats = PF.column_stats(df, ["id"]).first()
    assert stats["n_distinct"] == pdf["id"].nunique()


def test_duplicate_ids_with_hot_value(hot):
    pdf, df = hot
    summ, flags = QC.run_quality_checks(df.select("row_id", "id"), kinds={"id": K.KIND_ID})
    got = {r["rule"]: r["count"] for r in summ.collect()}
    exp = pdf["id"].duplicated(keep=False).sum()
    assert got[K.RULE_DUPLICATE_ID] == exp
    assert flags.count() == len(pdf)


def test_ranks_with_hot_score(hot):
    pdf, df = hot
    long = df.select("row_id", F.lit("m").alias("model_key"), "score")
    pr = EN.percentile_ranks(long).toPandas().sort_values("row_id")
    assert np.allclose(pr["pct"].to_numpy(), pdf["score"].rank(pct=True).to_numpy())
    r = RS.ranked(df.select("row_id", "score")).toPandas()
    assert sorted(r["rank"]) == list(range(1, len(pdf) + 1))
    hot_ranks = r[r["score"] == 1.5].sort_values("row_id")["rank"].to_numpy()
    assert (np.diff(hot_ranks) == 1).all()   # ties in row-id order


def test_frequency_encoding_with_hot_value(hot):
    pdf, df = hot
    feats, spec = FT.build_features(df, ["seg"], max_onehot=2, rare_columns=["seg"], scale=False)
    out = feats.toPandas().set_index("row_id").sort_index()
    share = pdf["seg"].map(pdf["seg"].value_counts(normalize=True))
    assert np.allclose(out["seg_freq"].to_numpy(), share.to_numpy())


def test_shares_of_heavy_values_skip_the_shuffle(hot, monkeypatch):
    pdf, df = hot
    df = df.withColumn("seg", F.when(F.col("row_id") % 7 != 0, F.col("seg"))).withColumn("n", (F.col("row_id") % 5).cast("int"))
    segs = pdf["seg"].where(pdf["row_id"] % 7 != 0, None)
    monkeypatch.setattr(FT, "HEAVY", 0.2)
    tables = FT.share_tables(df, {"one": ["seg"], "two": ["seg", "n"]})
    keys = []
    was = FT._look_up
    monkeypatch.setattr(FT, "_look_up", lambda d, cols, shares, name, spread=None: keys.append(spread) or was(d, cols, shares, name, spread))
    out = FT._join_share(FT._join_share(df, ["seg"], tables["one"], "one", "row_id"), ["seg", "n"], tables["two"], "two", "row_id").toPandas()
    out = out.set_index("row_id").sort_index()
    text = segs.fillna("-")
    assert np.allclose(out["one"], text.map(text.value_counts(normalize=True)))
    both = text + "|" + (pdf["row_id"] % 5).astype(str)
    assert np.allclose(out["two"], both.map(both.value_counts(normalize=True)))
    assert len(out) == len(pdf) and keys[0] is None and keys[1] is not None


def test_counting_distinct_texts_moves_digests_and_reports_take_two_scans(spark, tmp_path):
    rows = [(k, f"text {k % 40}", f"2024-01-{k % 28 + 1:02d}" if k % 9 else "x") for k in range(300)]
    spark.createDataFrame(rows, "row_id long, a string, b string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    stats = PF.column_stats(df, ["a", "b"])
    assert {r["column"]: r["n_distinct"] for r in stats.collect()} == {"a": 40, "b": 29}
    assert "xxhash64(a" in stats._jdf.queryExecution().optimizedPlan().toString()
    one, two = [KD.coerce_datetime(df.select("row_id", "b", *[F.col("b").alias(f"b{i}") for i in range(n)]),
                                   ["b", *[f"b{i}" for i in range(n)]])[1] for n in (0, 6)]
    scans = [r._jdf.queryExecution().executedPlan().toString().count("FileScan") for r in (one, two)]
    assert scans == [2, 2] and two.count() == 7 and {r["failed"] for r in two.collect()} == {34}
