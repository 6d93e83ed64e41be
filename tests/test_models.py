import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddity.operators import ensemble as EN
from oddity.operators import features as FT
from oddity.operators import models as MD
from tests.fixtures import planted_calls, planted_finance


def brute_lof(X: np.ndarray, k: int) -> np.ndarray:
    """Reference LOF by brute force; ties broken by the smaller index (identical points included)."""
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2))
    nbrs = []
    for i in range(n):
        order = sorted((D[i, j], j) for j in range(n) if j != i)
        nbrs.append([j for _, j in order[:k]])
    kd = np.array([D[i, nbrs[i][-1]] for i in range(n)])
    lrd = np.array([1.0 / (np.mean([max(kd[j], D[i, j]) for j in nbrs[i]]) + 1e-10) for i in range(n)])
    return np.array([np.mean([lrd[j] for j in nbrs[i]]) / lrd[i] for i in range(n)])


def _features(spark, pdf):
    df = spark.createDataFrame(pdf)
    cols = [c for c in pdf.columns if c != "row_id" and pdf[c].dtype != object]
    return FT.build_features(df, cols)


def test_lof_exact_with_duplicates_and_outliers(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 2))
    X[:40] = [0.5, 0.5]                               # a hot point holding many rows
    X[40:46] = [-1.2, 0.3]                            # a small group of copies (fewer than k)
    X[-3:] = [[6, 6], [-7, 5], [8, -6]]
    pdf = pd.DataFrame({"row_id": np.arange(300), "a": X[:, 0], "b": X[:, 1]})
    df = spark.createDataFrame(pdf)
    got = MD.lof(df, ["a", "b"], k=10).toPandas().sort_values("row_id")["score"].to_numpy()
    exp = brute_lof(X, 10)
    # copies of a point are interchangeable neighbours, so the exact values agree everywhere
    assert np.allclose(got, exp, rtol=1e-6)


def test_lof_scores_every_row_in_higher_dimensions(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(200, 6))
    pdf = pd.DataFrame(X, columns=[f"f{i}" for i in range(6)])
    pdf.insert(0, "row_id", np.arange(200))
    got = MD.lof(spark.createDataFrame(pdf), [f"f{i}" for i in range(6)], k=8).toPandas().sort_values("row_id")
    assert np.allclose(got["score"].to_numpy(), brute_lof(X, 8), rtol=1e-6)


def test_isolation_forest_invariants(spark):
    pdf, planted = planted_finance()
    feats, spec = _features(spark, pdf)
    a = MD.isolation_forest(feats, spec.names, 0.05).toPandas().set_index("row_id").sort_index()
    b = MD.isolation_forest(feats.repartition(3), spec.names, 0.05).toPandas().set_index("row_id").sort_index()
    assert len(a) == len(pdf) and a["score"].notna().all()
    assert np.allclose(a["score"], b["score"])                       # same seed, any partitioning
    assert set(planted) <= set(a["score"].nlargest(5).index)         # planted rows in the top 5 %
    assert (a["score"] >= 0).sum() == pytest.approx(0.05 * len(pdf), abs=2)


def test_isolation_forest_constant_data(spark):
    pdf = pd.DataFrame({"row_id": np.arange(50), "x": np.ones(50)})
    s = MD.isolation_forest(spark.createDataFrame(pdf), ["x"], 0.05).toPandas()
    assert s["score"].nunique() == 1


def test_ocsvm_ranks_planted_rows_high(spark):
    pdf, planted = planted_calls()
    feats, spec = _features(spark, pdf)
    s = MD.ocsvm(feats, spec.names, nu=0.05).toPandas().set_index("row_id")
    assert len(s) == len(pdf) and s["score"].notna().all()
    X = feats.toPandas().sort_values("row_id")[spec.names].to_numpy(float)
    exact = pd.Series(_exact_ocsvm_scores(X, 0.05, 1.0 / (X.shape[1] * X.var())))
    # of the planted rows those that the exact dual has among its first eight; the third is a support vector there too
    first = set(exact.nlargest(8).index)
    assert len(set(planted) & first) >= 2 and set(planted) & first <= set(s["score"].nlargest(8).index)
    assert s["score"].sort_index().rank().corr(exact.rank()) > 0.9


def test_semi_supervised_keeps_confirmed_on_top(spark):
    pdf, planted = planted_finance()
    feats, spec = _features(spark, pdf)
    labels = spark.createDataFrame([(i, 1) for i in planted] + [(0, 0), (1, 0)], "row_id long, label int")
    s = MD.semi_supervised(feats, spec.names, labels, 0.05).toPandas().set_index("row_id")
    assert len(s) == len(pdf)
    assert set(planted) <= set(s["score"].nlargest(5).index)


def test_lof_with_far_outliers_looks_into_few_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(150, 4))
    X[3], X[70] = 1e6, [-4e7, 0, 1e5, 3]
    pdf = pd.DataFrame(X, columns=list("abcd")).assign(row_id=np.arange(len(X)))
    cells, was = [], F.sequence
    monkeypatch.setattr(MD.F, "sequence", lambda lo, hi, *step: cells.append(1) or F.slice(was(lo, hi, *step), 1, 4))
    got = MD.lof(spark.createDataFrame(pdf), list("abcd"), k=5).toPandas().sort_values("row_id")["score"].to_numpy()
    assert cells and np.allclose(got, brute_lof(X, 5), rtol=1e-6)


def test_silhouette_matches_numpy(spark):
    rng = np.random.default_rng(9)
    X = np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(5, 1, (40, 2))])
    y = np.array([0] * 60 + [1] * 40)
    pdf = pd.DataFrame({"row_id": np.arange(100), "a": X[:, 0], "b": X[:, 1]})
    feats = spark.createDataFrame(pdf)
    labels = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(100), "label": y}))
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    s = []
    for i in range(100):
        same, other = y == y[i], y != y[i]
        a = D[i, same].sum() / (same.sum() - 1)
        b = D[i, other].mean()
        s.append((b - a) / max(a, b))
    assert MD.silhouette(feats, ["a", "b"], labels) == round(float(np.mean(s)), 4)
    one = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(100), "label": 0}))
    assert MD.silhouette(feats, ["a", "b"], one) == -1.0


def test_silhouette_of_a_sample_and_of_labels_with_one_row(spark, monkeypatch):
    monkeypatch.setattr(MD, "_SILHOUETTE_BLOCK", 7)
    rng = np.random.default_rng(4)
    X, y = rng.normal(size=(90, 3)), np.array(["a", "b", "c"] * 30)
    y[5] = "alone"
    feats = spark.createDataFrame(pd.DataFrame(X, columns=list("uvw")).assign(row_id=np.arange(90)))
    labels = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(90), "label": y}))

    def plain(keep):
        D, s = np.sqrt(((X[keep][:, None] - X[keep][None]) ** 2).sum(-1)), []
        for i, own in enumerate(y[keep]):
            same = y[keep] == own
            a, b = D[i, same].sum() / max(1, same.sum() - 1), min(D[i, y[keep] == k].mean() for k in set(y[keep]) - {own})
            s.append((b - a) / max(a, b) if same.sum() > 1 else 0.0)
        return round(float(np.mean(s)), 4)

    assert MD.silhouette(feats, list("uvw"), labels) == plain(np.arange(90))
    kept = np.array(sorted(sorted(range(90), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:40]))
    assert MD.silhouette(feats, list("uvw"), labels, sample=40) == plain(kept)


def test_select_model_weights_and_ties(spark):
    bench = spark.createDataFrame([("isolation_forest", 0.5, True), ("lof", 0.5, True), ("ocsvm", 0.9, False)],
                                  "model_key string, silhouette double, success boolean")
    assert MD.select_model(bench).first()["best_key"] == "isolation_forest"      # first key wins a tie
    assert MD.select_model(bench, {"lof": 1.3}).first()["best_key"] == "lof"
    none = bench.filter("false")
    assert MD.select_model(none).first()["best_key"] == "isolation_forest"


def test_ensemble_matches_pandas(spark):
    rng = np.random.default_rng(12)
    n = 500
    a, b = rng.integers(0, 40, n).astype(float), rng.normal(size=n)
    long = pd.concat([pd.DataFrame({"row_id": np.arange(n), "model_key": "isolation_forest", "score": a}),
                      pd.DataFrame({"row_id": np.arange(n), "model_key": "lof", "score": b})])
    w = {"isolation_forest": 1.1, "lof": 1.3}
    e = EN.ensemble(spark.createDataFrame(long), 0.05, w).toPandas().set_index("row_id").sort_index()
    pa, pb = pd.Series(a).rank(pct=True), pd.Series(b).rank(pct=True)
    assert np.allclose(e["ensemble_score"], (1.1 * pa + 1.3 * pb) / 2.4)
    top = (a >= np.quantile(a, 0.95)) | (b >= np.quantile(b, 0.95))
    assert e["any_top"].tolist() == top.tolist()


def _exact_ocsvm_scores(X: np.ndarray, nu: float, gamma: float, iters: int = 3000) -> np.ndarray:
    """-sum_i a_i K(x_i, x) of the exact nu one-class SVM dual (projected gradient)."""
    n = len(X)
    K = np.exp(-gamma * ((X[:, None] - X[None]) ** 2).sum(-1))
    C = 1.0 / (nu * n)
    a = np.full(n, 1.0 / n)

    def project(v):
        lo, hi = v.min() - C, v.max()
        for _ in range(100):
            tau = (lo + hi) / 2
            if np.clip(v - tau, 0, C).sum() > 1:
                lo = tau
            else:
                hi = tau
        return np.clip(v - (lo + hi) / 2, 0, C)

    step = 1.0 / np.linalg.eigvalsh(K)[-1]
    for _ in range(iters):
        a = project(a - step * (K @ a))
    return -(K @ a)


def test_ocsvm_agrees_with_exact_dual_ranking(spark):
    rng = np.random.default_rng(17)
    X = np.vstack([rng.normal(0, 1, (190, 2)), rng.normal(0, 1, (10, 2)) * 4])
    X = (X - X.mean(0)) / X.std(0)
    pdf = pd.DataFrame({"row_id": np.arange(200), "a": X[:, 0], "b": X[:, 1]})
    s = MD.ocsvm(spark.createDataFrame(pdf), ["a", "b"], nu=0.1).toPandas().sort_values("row_id")
    exact = _exact_ocsvm_scores(X, 0.1, 1.0 / (2 * X.var()))
    # The exact decision function is not monotone inside the inlier bulk (centre points lie far
    # from the boundary support vectors), so compare what the review uses: the top 10 %.
    top_ours = set(np.argsort(-s["score"].to_numpy())[:20])
    top_exact = set(np.argsort(-exact)[:20])
    assert len(top_ours & top_exact) >= 15


def test_certificate_bounds_the_distance_to_the_optimum(spark):
    rng = np.random.default_rng(8)
    X = rng.normal(size=(400, 3))
    feats = spark.createDataFrame(pd.DataFrame(X, columns=list("abc")).assign(row_id=np.arange(400)))
    model = MD.fit_ocsvm(feats, list("abc"), nu=0.1)
    c = MD.ocsvm_certificate(feats, list("abc"), model)
    assert -1e-9 <= c["gap"] < 1e-3 * abs(c["dual"]) and c["excess"] < 1e-6 and c["n"] == 400
    assert c["bounded_share"] <= 0.1 + 1 / 400 and c["support_share"] >= 0.1 - 1 / 400 and 5 < c["passes"] < 130
    # the same sums with numpy
    Z = model.scale * np.cos(X @ model.W + model.bias)
    m = Z @ model.w
    a = np.clip((model.offset - m) / model.band, 0, 1)
    rho = np.quantile(m, 0.1)
    primal = 0.5 * model.w @ model.w - rho + np.maximum(rho - m, 0).sum() / 40
    assert c["primal"] == pytest.approx(primal) and c["dual"] == pytest.approx(-0.5 * ((a @ Z / a.sum()) ** 2).sum())
    # any other feasible dual solution is no better, any other weights are no better
    other = rng.permutation(a) / a.sum()
    assert -0.5 * ((other @ Z) ** 2).sum() <= c["primal"] + 1e-12
    model.w = model.w * 1.05
    assert MD.ocsvm_certificate(feats, list("abc"), model)["primal"] > c["dual"]


def test_forest_paths_follow_the_nodes(spark):
    """Trees filled up to one depth give the path of every row through the grown nodes, missing values to the right."""
    rng = np.random.default_rng(3)
    feats = spark.createDataFrame(pd.DataFrame(rng.normal(size=(300, 3)), columns=list("abc")).assign(row_id=np.arange(300)))
    forest = MD.fit_isolation_forest(feats, list("abc"), n_trees=7, max_samples=64)
    X = rng.normal(size=(1200, 3)) * 2
    X[5, 1] = np.nan
    X[6] = np.nan

    def path(root, x):
        at = root
        while forest["feature"][at] >= 0:
            at = forest["left" if x[forest["feature"][at]] <= forest["threshold"][at] else "right"][at]
        return forest["leaf_value"][at]

    want = np.array([np.mean([path(r, x) for r in forest["roots"]]) for x in X])
    assert np.allclose(MD._path_lengths(forest, X), want, rtol=1e-12)
    assert max(f.size for f, _ in MD._heaps(forest)[0]) <= 7 * 64


def test_lof_in_many_dimensions_by_pairs_of_blocks(spark, monkeypatch):
    """Neighbours come from pairs of blocks; copies, ties and blocks of fewer than k points included."""
    assert MD._GRID_DIMS < 10
    monkeypatch.setattr(MD, "_BLOCK_ROWS", 16)
    monkeypatch.setattr(MD, "_grid_candidates", None)  # a grid of projections parts little here
    rng = np.random.default_rng(21)
    X = np.vstack([rng.normal(size=(90, 10)), 50 + rng.normal(size=(40, 10)), rng.integers(0, 2, (60, 10)) - 30.0])
    X[:4] = X[7]
    names = [f"e{i}" for i in range(10)]
    for rows, k in ((X, 5), (X[:9], 20)):
        feats = spark.createDataFrame(pd.DataFrame(rows, columns=names).assign(row_id=np.arange(len(rows))))
        got = MD.lof(feats, names, k=k).toPandas().sort_values("row_id")["score"].to_numpy()
        D = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1))
        k = max(min(k, len(rows) - 1), 2)
        kd, nn = np.empty(len(rows)), []
        _, rep = np.unique(rows, axis=0, return_inverse=True)
        ids = np.array([np.flatnonzero(rep == r).min() for r in rep.ravel()])
        for i in range(len(rows)):
            others = [j for j in range(len(rows)) if j != i]
            others.sort(key=lambda j: (D[i, j], ids[i] != ids[j], ids[j]))
            nn.append(others[:k])
            kd[i] = D[i, others[k - 1]]
        lrd = np.array([1 / (np.mean([max(kd[j], D[i, j]) for j in nn[i]]) + 1e-10) for i in range(len(rows))])
        want = np.array([np.mean(lrd[nn[i]]) / lrd[i] for i in range(len(rows))])
        assert np.allclose(got, want, rtol=1e-6)


def test_ocsvm_of_many_rows_starts_on_some_and_ends_on_all(spark, monkeypatch):
    rng = np.random.default_rng(8)
    feats = spark.createDataFrame(pd.DataFrame(rng.normal(size=(900, 2)), columns=list("ab")).assign(row_id=np.arange(900)))
    whole = MD.fit_ocsvm(feats, ["a", "b"], 0.1, n_components=32)
    sizes, was = [], MD._row_sums

    def row_sums(data, names, model, of):
        sizes.append(model.n)
        return was(data, names, model, of)

    monkeypatch.setattr(MD, "_row_sums", row_sums)
    monkeypatch.setattr(MD, "_START_ROWS", 200)
    short = MD.fit_ocsvm(feats, ["a", "b"], 0.1, n_components=32)
    assert short.n == 900 and np.allclose(short.w, whole.w, atol=1e-8) and abs(short.offset - whole.offset) < 1e-8
    assert sizes[-1] == 900 and sum(s == 900 for s in sizes) < whole.passes


def test_lof_in_many_dimensions_leaves_out_points_with_missing_coordinates(spark, monkeypatch):
    monkeypatch.setattr(MD, "_BLOCK_ROWS", 16)
    rng = np.random.default_rng(22)
    names = [f"e{i}" for i in range(10)]
    known = pd.DataFrame(rng.normal(size=(60, 10)), columns=names).assign(row_id=np.arange(60))
    schema = ", ".join([f"{c} double" for c in names] + ["row_id long"])
    rows = known.astype(object).values.tolist()
    odd = [[None] * 10 + [60], [1.0] * 9 + [None, 61]]
    want = MD.lof(spark.createDataFrame(rows, schema), names, k=5).toPandas().set_index("row_id")["score"]
    got = MD.lof(spark.createDataFrame(rows + odd, schema), names, k=5).toPandas().set_index("row_id")["score"]
    assert np.allclose(got.loc[range(60)], want.loc[range(60)], rtol=1e-9)


def test_silhouettes_take_all_rows_whatever_their_number(spark, monkeypatch):
    monkeypatch.setattr(MD, "_SILHOUETTE_BLOCK", 512)
    rng = np.random.default_rng(6)
    X = np.vstack([rng.normal(0, 1, (5600, 2)), rng.normal(3, 1, (400, 2))]).round(2)
    X[:50] = X[60]  # one point many times
    one, two = (X[:, 0] > 2.5).astype(int), np.where(X[:, 1] > 2, "u", np.where(X[:, 1] < -1, "v", "w"))
    feats = spark.createDataFrame(pd.DataFrame(X, columns=list("ab")).assign(row_id=np.arange(6000)))
    labels = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(6000), "one": one, "two": two, "all": 1}))

    def plain(y):
        D, s, kinds = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)), [], sorted(set(y))
        means = np.array([D[:, y == c].sum(axis=1) for c in kinds])
        for i, own in enumerate(y):
            a = means[kinds.index(own), i] / (np.sum(y == own) - 1)
            b = min(means[c, i] / np.sum(y == kinds[c]) for c in range(len(kinds)) if kinds[c] != own)
            s.append((b - a) / max(a, b))
        return round(float(np.mean(s)), 4)

    assert MD.silhouettes(feats, ["a", "b"], labels, ["one", "two", "all"]) == {"one": plain(one), "two": plain(two), "all": -1.0}
    assert MD.silhouette(feats, ["a", "b"], labels, label="one") == plain(one)


def _on_lines(rng, n=1200):
    """Points on 15 lines, two of them close, with copies, far points and labels of one row."""
    X = np.column_stack([rng.choice([0.0, 1.0, 2.5], n), rng.lognormal(0, 1, n).round(2), rng.choice([0.0, 1e-3, 1.0, 2.0, 4.0], n)])
    X[:40] = X[50]
    X[7, 1] = 5e3
    one, two = (X[:, 1] > 3).astype(int), rng.choice(["u", "v", "w"], n)
    two[9] = "alone"
    return X, pd.DataFrame({"row_id": np.arange(n), "one": one, "two": two, "all": 1})


def _plain_silhouette(X, y):
    D, s, kinds = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)), [], sorted(set(y))
    for i, own in enumerate(y):
        same = y == own
        a, b = D[i, same].sum() / max(1, same.sum() - 1), min(D[i, y == k].mean() for k in kinds if k != own)
        s.append((b - a) / max(a, b) if same.sum() > 1 else 0.0)
    return float(np.mean(s))


def test_silhouettes_of_points_on_lines_without_pairs_of_blocks(spark, monkeypatch):
    X, labels = _on_lines(np.random.default_rng(11))
    monkeypatch.setattr(MD, "_LINE_POINTS", 100, raising=False)
    monkeypatch.setattr(MD, "_SEGMENT_POINTS", 8, raising=False)
    monkeypatch.setattr(MD, "_paired", lambda *a: pytest.fail("all pairs of blocks were worked"))
    found, was = [], getattr(MD, "_silhouettes_on_lines", None)
    monkeypatch.setattr(MD, "_silhouettes_on_lines", lambda *a: found.append(was(*a)) or found[-1], raising=False)
    feats = spark.createDataFrame(pd.DataFrame(X, columns=list("abc")).assign(row_id=np.arange(len(X))))
    want = {c: _plain_silhouette(X, labels[c].to_numpy()) for c in ("one", "two")}
    got = MD.silhouettes(feats, list("abc"), spark.createDataFrame(labels), ["one", "two", "all"])
    assert got == {**{c: round(v, 4) for c, v in want.items()}, "all": -1.0}
    assert np.allclose(found[0][:2], list(want.values()), rtol=0, atol=1e-9)


def test_silhouettes_in_doubt_or_off_lines_come_from_pairs_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    X, labels = _on_lines(rng, 400)
    monkeypatch.setattr(MD, "_LINE_POINTS", 100)
    found, was = [], MD._silhouettes_on_lines
    monkeypatch.setattr(MD, "_silhouettes_on_lines", lambda *a: found.append(was(*a)) or found[-1])
    lab = spark.createDataFrame(labels)

    def both(X):
        feats = spark.createDataFrame(pd.DataFrame(X, columns=list("abc")).assign(row_id=np.arange(len(X))))
        assert MD.silhouettes(feats, list("abc"), lab, ["one", "two"]) == {
            c: round(_plain_silhouette(X, labels[c].to_numpy()), 4) for c in ("one", "two")}

    both(rng.normal(size=(400, 3)))                  # every point a line of its own
    monkeypatch.setattr(MD, "_LINE_ERRORS", (1e-1, 1e-2))
    monkeypatch.setattr(MD, "_POINTS_A_LINE", 10)
    both(X)                                          # a bound too wide to round by
    assert found == [None, None]


def test_sums_at_nodes_keep_their_bound(spark):
    from oddity.operators import line_sums as LS
    rng = np.random.default_rng(13)
    for p, apart, half, other in ((0.5, 2.0, 0.7, 0.3), (3.0, 0.0, 1.5, 1.5), (0.0, 4.0, 1.0, 1.0), (0.2, 1.0, 0.4, 0.0), (1.0, 0.0, 1.0, 1.0)):
        x, y = rng.uniform(-half, half, 200), apart + rng.uniform(-other, other, 200)
        d = np.sqrt(p * p + (half * LS._PLACES[:, None] - (apart + other * LS._PLACES)) ** 2)
        got = LS.basis(LS.within(x, -half, half)) @ d @ LS.basis(LS.within(y, apart - other, apart + other)).T
        worst = np.abs(got - np.sqrt(p * p + (x[:, None] - y) ** 2)).max()
        assert worst <= LS.error_bound(*np.array([apart, p, half, other])) + 1e-12
    y, w = np.sort(rng.normal(size=50).round(1)), rng.integers(0, 3, (50, 2)).astype(float)
    assert np.allclose(LS.sums_on_segment(y, w), np.abs(y[:, None] - y) @ w)


def test_model_selection_sums_along_lines_of_customers(spark, tmp_path, monkeypatch):
    from oddity.plans import registry
    rng = np.random.default_rng(14)
    n = 900
    pd.DataFrame({"c_custkey": np.arange(n), "c_name": [f"Customer#{i}" for i in range(n)], "c_nationkey": rng.integers(0, 9, n).astype("int32"),
                  "c_acctbal": rng.uniform(-999, 9999, n).round(2), "c_mktsegment": "A"}).to_parquet(tmp_path / "customer.parquet")
    run = lambda: sorted(tuple(r) for r in registry.QUERIES["model_selection"](spark, str(tmp_path)).collect())
    want = run()
    monkeypatch.setattr(MD, "_LINE_POINTS", 100, raising=False)
    monkeypatch.setattr(MD, "_SEGMENT_POINTS", 16, raising=False)
    monkeypatch.setattr(MD, "_paired", lambda *a: pytest.fail("all pairs of blocks were worked"))
    assert run() == want


def test_silhouettes_of_mixed_columns_sum_along_lines_for_three_models(spark, monkeypatch):
    rng = np.random.default_rng(15)
    n = 2500
    pdf = pd.DataFrame({"row_id": np.arange(n), "balance": rng.normal(5e3, 3e3, n).round(2), "nation": rng.integers(0, 5, n),
                        "segment": rng.choice(["a", "b", "c"], n, p=[.6, .3, .1]), "currency": rng.choice(["x", "y"], n)})
    feats, spec = FT.build_features(spark.createDataFrame(pdf), ["balance", "nation", "segment", "currency"])
    assert len(spec.names) > 3
    X = feats.toPandas().sort_values("row_id")[spec.names].to_numpy(float)
    labels = pd.DataFrame({"row_id": np.arange(n), "isolation_forest": (np.abs(X).max(axis=1) > 2.2).astype(int),
                           "lof": (rng.random(n) < 0.05).astype(int), "ocsvm": (pdf["balance"] > 9e3).astype(int)})
    monkeypatch.setattr(MD, "_LINE_POINTS", 100, raising=False)
    monkeypatch.setattr(MD, "_SEGMENT_POINTS", 16, raising=False)
    monkeypatch.setattr(MD, "_paired", lambda *a: pytest.fail("all pairs of blocks were worked"))
    keys = ["isolation_forest", "lof", "ocsvm"]
    assert MD.silhouettes(feats, spec.names, spark.createDataFrame(labels), keys) == {
        c: round(_plain_silhouette(X, labels[c].to_numpy()), 4) for c in keys}
