"""Outlier models.

* Isolation forest: per-tree samples are picked by smallest hash (no driver
  sampling), splits are drawn from digests of seed, tree and node, trees are grown in parallel with ``groupBy(tree).applyInPandas``,
  and the forest (bounded by trees x (2 psi - 1) nodes, independent of the
  data size) is broadcast to a vectorised ``pandas_udf`` that scores every row.
* LOF: exact k nearest neighbours without a cross join. Identical points are
  collapsed first (a hot value becomes one row with a multiplicity), an upper
  bound on each k-distance comes from the 2k neighbours in a random-projection
  order, and the exact neighbours are then found by an equi-join on grid cells of
  the projections, at most 27 cells a point, in grids whose widths double.
* One-class SVM: random Fourier features of the RBF kernel and Newton steps on the
  smoothed nu one-class objective; each step is one pass of partial sums.
* Silhouette: Euclidean, over all pairs of rows: by sums along lines where many points share all coordinates
  but one, with a bound that leaves the rounded result in no doubt, else by pairs of blocks of points.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..session import checkpoint
from . import line_sums as LS
from .order import exact_quantile, row_number_global

EULER_GAMMA = 0.5772156649015329


def average_path_length(n):
    """c(n) of Liu, Ting and Zhou (2008): 0 for n <= 1, 1 for n == 2."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


_HASH_RANGE = 1 << 32


def _row_hashes(row_id: str, seed: int):
    """Two 32-bit numbers of a row, from an MD5 digest that other engines compute alike."""
    digest = F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed))).cast("binary"))
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(2)]


def _node_draws(seed: int, tree: int, node: int) -> tuple[float, float]:
    """Two uniform numbers of a node of a tree, from an MD5 digest of their names."""
    digest = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
    return int(digest[:8], 16) / 2 ** 32, int(digest[8:21], 16) / 2 ** 52


# --------------------------------------------------------------------------- M1
def _grow_tree_fn(names, psi, seed):
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        X = pdf[names].to_numpy(dtype=float)
        rows = []  # node, feature, threshold, left, right, leaf_value

        def build(idx, depth, name):
            # ``name`` numbers the nodes as in a heap: the root is 1, the children of k are 2k and 2k + 1
            node = len(rows)
            rows.append(None)
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            candidates = np.flatnonzero(hi > lo)
            if depth >= max_depth or len(candidates) == 0:
                rows[node] = (node, -1, 0.0, -1, -1, depth + float(average_path_length([len(idx)])[0]))
                return node
            which, where = _node_draws(seed, tree, name)
            f = int(candidates[int(which * len(candidates))])
            thr = float(lo[f] + where * (hi[f] - lo[f]))
            go_left = sub[:, f] <= thr
            left = build(idx[go_left], depth + 1, 2 * name)
            right = build(idx[~go_left], depth + 1, 2 * name + 1)
            rows[node] = (node, f, thr, left, right, 0.0)
            return node

        build(np.arange(len(X)), 0, 1)
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "leaf_value"])
        out.insert(0, "tree", tree)
        return out
    return grow


NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "leaf_value double")


def forest_samples(features: DataFrame, names: list[str], n_trees: int, psi: int, seed: int,
                   row_id: str = "row_id", n: int | None = None) -> DataFrame:
    """(row_id, features, tree): ``psi`` rows drawn without replacement for every tree."""
    n = features.count() if n is None else n
    # Every tree samples on its own: it takes the psi rows with the smallest hash (a + tree b) mod 2^32
    # of the row's two numbers. A row is expanded only for the trees whose hash is small enough to be
    # among them (about 4 psi rows per tree), so the sort of a tree is short at any table size.
    def sample(q):
        a, b = _row_hashes(row_id, seed)
        hashed = features.select(row_id, *names, a.alias("_a"), b.alias("_b"))
        each = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.struct(
            t.alias("tree"), ((F.col("_a") + t * F.col("_b")) % F.lit(_HASH_RANGE)).alias("h")))
        if q < 1.0:
            each = F.filter(each, lambda s: s["h"] < int(q * _HASH_RANGE))
        tagged = hashed.withColumn("_t", F.explode(each)).select(row_id, *names, "_t.tree", F.col("_t.h").alias("_h"))
        w = Window.partitionBy("tree").orderBy("_h", row_id)
        return tagged.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi).drop("_r", "_h")

    q = min(1.0, 4.0 * psi / max(n, 1))
    samples = sample(q)
    if q < 1.0:
        short = samples.groupBy("tree").count().filter(F.col("count") < psi).limit(1).count()
        if short:  # an unlucky draw left a tree short: take every row as a candidate (exact)
            samples = sample(1.0)
    return samples


def fit_isolation_forest(features: DataFrame, names: list[str], n_trees: int = 100,
                         max_samples: int = 256, seed: int = 42, row_id: str = "row_id") -> dict:
    """Grow the forest; returns flat node arrays (bounded by n_trees x (2 psi - 1))."""
    n = features.count()
    psi = int(min(max_samples, n))
    samples = forest_samples(features, names, n_trees, psi, seed, row_id, n)
    nodes = samples.groupBy("tree").applyInPandas(_grow_tree_fn(names, psi, seed), NODE_SCHEMA)
    pdf = nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    offsets = pdf.groupby("tree").cumcount().to_numpy()
    base = pdf.index.to_numpy() - offsets  # global index of each tree's root
    left = np.where(pdf["left"].to_numpy() >= 0, base + pdf["left"].to_numpy(), -1)
    right = np.where(pdf["right"].to_numpy() >= 0, base + pdf["right"].to_numpy(), -1)
    roots = np.unique(base)
    return {"feature": pdf["feature"].to_numpy(np.int64), "threshold": pdf["threshold"].to_numpy(),
            "left": left.astype(np.int64), "right": right.astype(np.int64),
            "leaf_value": pdf["leaf_value"].to_numpy(), "roots": roots.astype(np.int64),
            "psi": psi, "n_trees": n_trees}


_FOREST_ROWS = 512


def _heaps(forest: dict) -> tuple[list, np.ndarray, int]:
    """(feature, threshold) of each level, leaf values and the number of trees, the trees filled up to one depth.

    Below a leaf both children are the leaf itself, so every row takes as many steps in every tree.
    """
    node, levels = forest["roots"][:, None], []
    while (forest["feature"][node] >= 0).any():
        f = forest["feature"][node]
        inner = f >= 0
        levels.append((np.where(inner, f, 0).astype(np.int32), np.where(inner, forest["threshold"][node], np.inf)))
        node = np.stack([np.where(inner, forest["left"][node], node), np.where(inner, forest["right"][node], node)],
                        axis=2).reshape(len(node), -1)
    return [(f.ravel(), t.ravel()) for f, t in levels], forest["leaf_value"][node].ravel(), len(node)


def _path_lengths(forest: dict, X: np.ndarray) -> np.ndarray:
    levels, leaf, trees = _heaps(forest)
    out = np.empty(len(X))
    tree = np.arange(trees, dtype=np.int32)
    for first in range(0, len(X), _FOREST_ROWS):
        part = np.ascontiguousarray(X[first:first + _FOREST_ROWS])
        flat, start = part.ravel(), (np.arange(len(part), dtype=np.int32) * part.shape[1])[:, None]
        at = np.tile(tree, (len(part), 1))  # place of the node in its level, trees one after the other
        for feature, threshold in levels:
            right = ~(flat[feature[at] + start] <= threshold[at])
            at = 2 * at + right
        out[first:first + _FOREST_ROWS] = leaf[at].mean(axis=1)
    return out


def isolation_scores(features: DataFrame, names: list[str], forest: dict,
                     row_id: str = "row_id", out: str = "raw_score") -> DataFrame:
    """2^(-E[h(x)] / c(psi)) for every row (higher = more anomalous)."""
    bc = features.sparkSession.sparkContext.broadcast(forest)
    c_psi = float(average_path_length([forest["psi"]])[0]) or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        X = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(np.power(2.0, -_path_lengths(bc.value, X) / c_psi))

    return features.select(row_id, score(*[F.col(c) for c in names]).alias(out))


def shift_by_quantile(scores: DataFrame, contamination: float, raw: str = "raw_score",
                      out: str = "score") -> DataFrame:
    """Sign convention of ``-decision_function``: raw score minus its (1 - c) quantile."""
    q = exact_quantile(scores, raw, 1.0 - contamination)
    return scores.withColumn(out, F.col(raw) - F.lit(q)).drop(raw)


def isolation_forest(features: DataFrame, names: list[str], contamination: float = 0.05,
                     n_trees: int = 100, seed: int = 42, row_id: str = "row_id",
                     train: DataFrame | None = None) -> DataFrame:
    """M1: (row_id, score). ``train`` (default: all rows) is the fitting set."""
    forest = fit_isolation_forest(train if train is not None else features, names, n_trees, 256, seed, row_id)
    raw = isolation_scores(features, names, forest, row_id)
    return shift_by_quantile(raw, contamination)


def semi_supervised(features: DataFrame, names: list[str], labels: DataFrame,
                    contamination: float = 0.05, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Fit a 150-tree forest on rows not confirmed as anomalies; score all rows."""
    confirmed = labels.filter(F.col("label") == 1).select(row_id)
    train = features.join(confirmed, row_id, "left_anti")
    return isolation_forest(features, names, contamination, 150, seed, row_id, train=train)


# --------------------------------------------------------------------------- M2
def _projection_basis(d: int, m: int, seed: int) -> np.ndarray:
    """d x m matrix with orthonormal columns (random rotation, fixed seed)."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q[:, :m]


_Z_BITS = 10
#: Dimensions up to which neighbours are found by cells of three projections; beyond, by blocks of points.
_GRID_DIMS = 8
_BLOCK_ROWS, _BLOCK_PARTS = 2048, 8


def _z_value(points: DataFrame, pcols: list[str]):
    """Morton (Z-order) code of the projections quantised to 2^10 levels each."""
    ext = points.agg(*[F.min(c).alias(f"lo{j}") for j, c in enumerate(pcols)],
                     *[F.max(c).alias(f"hi{j}") for j, c in enumerate(pcols)]).first()
    levels = 1 << _Z_BITS
    qs = []
    for j, c in enumerate(pcols):
        lo, hi = ext[f"lo{j}"], ext[f"hi{j}"]
        span = (hi - lo) or 1.0
        qs.append(F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(span) * levels), F.lit(levels - 1)).cast("long"))
    z = F.lit(0).cast("long")
    for bit in range(_Z_BITS):
        for j, q in enumerate(qs):
            z = z + F.shiftleft(F.shiftright(q, bit).bitwiseAND(F.lit(1)), bit * len(pcols) + j)
    return z


def _dist(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda acc, v: acc + v))


def lof(features: DataFrame, names: list[str], k: int = 20, seed: int = 42,
        row_id: str = "row_id") -> DataFrame:
    """M2: exact local outlier factor (Breunig et al. 2000), (row_id, score).

    k = max(min(k, n - 1), 2). Ties at equal distance are broken by the smaller
    row id (of the representative of a group of identical points).
    """
    n = features.count()
    k = max(min(k, n - 1), 2)
    d = len(names)
    m_dims = min(d, 3)
    basis = _projection_basis(d, m_dims, seed)
    pcols = [f"p{j}" for j in range(m_dims)]
    vec = F.array(*[F.col(c).cast("double") for c in names])
    projs = [reduce(lambda a, b: a + b, [F.col(c).cast("double") * F.lit(float(basis[i, j]))
                                         for i, c in enumerate(names)]) for j in range(m_dims)]
    # 1. collapse identical points: (x, pid, m, p*) with pid = smallest row id, m = copies
    points = checkpoint(
        features.select(row_id, vec.alias("x"), *[p.alias(c) for p, c in zip(projs, pcols)])
        .groupBy("x").agg(F.min(row_id).alias("pid"), F.count(F.lit(1)).alias("m"),
                          *[F.first(c).alias(c) for c in pcols]))
    members = features.select(row_id, vec.alias("x"))
    own_pts = points.select(F.col("pid").alias("a"), F.col("m").alias("ma"))
    if d > _GRID_DIMS:
        cand = _block_candidates(points, _z_value(points, pcols), k)
    else:
        cand = _grid_candidates(points, own_pts, pcols, k)
    nbrs = checkpoint(_weighted_neighbours(cand, own_pts, k))  # (a, b, w, d) with b == a for own copies; read three times
    kd = nbrs.groupBy("a").agg(F.max("d").alias("kd"))
    kd_b = kd.select(F.col("a").alias("b"), F.col("kd").alias("kd_b"))
    reach = nbrs.join(kd_b, "b").withColumn("reach", F.greatest(F.col("kd_b"), F.col("d")))
    lrd = reach.groupBy("a").agg((F.lit(1.0) / (F.sum(F.col("w") * F.col("reach")) / k + 1e-10)).alias("lrd"))
    lrd_b = lrd.select(F.col("a").alias("b"), F.col("lrd").alias("lrd_b"))
    lof_pts = (nbrs.join(lrd_b, "b").groupBy("a").agg((F.sum(F.col("w") * F.col("lrd_b")) / k).alias("_m"))
               .join(lrd, "a").select(F.col("a").alias("pid"), (F.col("_m") / F.col("lrd")).alias("score")))
    # 4. every row gets the score of its point
    rep = points.select("x", "pid")
    return members.join(rep, "x").join(lof_pts, "pid").select(row_id, "score")


def _grid_candidates(points: DataFrame, own_pts: DataFrame, pcols: list[str], k: int) -> DataFrame:
    """(a, ma, b, mb, d): pairs of points with all neighbours of each, by cells of the projections."""
    # 2. upper bound of every k-distance: the 2k neighbours along a Z-order curve of the projections
    ranked = row_number_global(points.withColumn("z", _z_value(points, pcols)), [F.col("z"), F.col("pid")], "rn")
    offs = [o for o in range(-k, k + 1) if o != 0]
    a = ranked.select(F.col("pid").alias("a"), F.col("x").alias("xa"), F.col("m").alias("ma"),
                      F.explode(F.array(*[F.col("rn") + o for o in offs])).alias("rn"))
    b = ranked.select("rn", F.col("pid").alias("b"), F.col("x").alias("xb"), F.col("m").alias("mb"))
    win = a.join(b, "rn").select("a", "ma", "b", "mb", _dist("xa", "xb").alias("d"))
    bound = checkpoint(_kth_weighted(win, own_pts, k).select("a", F.col("kd").alias("r")))
    # 3. exact neighbours: every point within r of a in each projection (|u.(a - b)| <= |a - b|),
    #    found by an equi-join on grid cells of the projections, then filtered. Cells of a point are
    #    at least as wide as its bound, so it looks into 3 cells a dimension however far out it lies;
    #    all points are entered once for every width in use, and widths double.
    width = exact_quantile(bound, "r", 0.9) or 0.0
    width = width if width > 0 else 1.0
    slack = 1e-9
    reach_r = F.col("r") * (1 + slack) + slack
    level = F.greatest(F.ceil(F.log2(reach_r / width)), F.lit(0)).cast("int")
    cell = lambda x, lv: F.floor(x / (F.lit(width) * F.pow(F.lit(2.0), lv))).cast("long")
    bound = checkpoint(bound.withColumn("level", level))
    levels = sorted(r["level"] for r in bound.select("level").distinct().collect())  # doublings of one width
    qa = bound.join(points.select(F.col("pid").alias("a"), F.col("x").alias("xa"), F.col("m").alias("ma"),
                                  *[F.col(c).alias(f"a{c}") for c in pcols]), "a")
    for j, c in enumerate(pcols):
        qa = qa.withColumn(f"cell{j}", F.explode(F.sequence(cell(F.col(f"a{c}") - reach_r, F.col("level")),
                                                            cell(F.col(f"a{c}") + reach_r, F.col("level")))))
    pb = points.select(F.col("pid").alias("b"), F.col("x").alias("xb"), F.col("m").alias("mb"),
                       *[F.col(c).alias(f"b{c}") for c in pcols],
                       F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")).alias("level"))
    pb = pb.select("*", *[cell(F.col(f"b{c}"), F.col("level")).alias(f"cell{j}") for j, c in enumerate(pcols)])
    near = reduce(lambda x, y: x & y, [F.abs(F.col(f"a{c}") - F.col(f"b{c}")) <= reach_r for c in pcols])
    cand = (qa.join(pb, ["level", *[f"cell{j}" for j in range(len(pcols))]])
            .filter((F.col("a") != F.col("b")) & near)
            .select("a", "ma", "b", "mb", _dist("xa", "xb").alias("d")))
    return cand


def _packed(points: DataFrame, order, k: int) -> DataFrame:
    """Points in blocks that follow ``order``: ids, copies, coordinates and k-distance bounds as bytes, with their box.

    The bound of a point is its k-distance among the points of its block.
    """
    size = _BLOCK_ROWS

    def pack(batches):
        held = []

        def block():
            t = pa.concat_tables(held).combine_chunks()
            ids, m = t["pid"].to_numpy().astype(np.int64), t["m"].to_numpy().astype(np.int64)
            X = np.array(t["x"].to_pylist(), dtype=float)
            r = np.empty(len(X))
            for f in range(0, len(X), 256):
                D = _squares(X[f:f + 256], X)
                D[np.arange(len(D)), f + np.arange(len(D))] = 0.0
                # the copies counted point by point from the nearest on: k other rows are within the bound
                nearest = np.argpartition(D, min(k, len(X) - 1), axis=1)[:, :k + 1]
                found = np.sort(np.take_along_axis(D, nearest, axis=1), axis=1)
                r[f:f + 256] = np.sqrt(np.maximum(found[:, k], 0.0)) if len(X) > k else np.inf
            r[m > k] = 0.0
            r = r * (1 + 1e-6) + 1e-6
            return pa.RecordBatch.from_arrays(
                [pa.array([int(ids[0])]), *[pa.array([v.tobytes()], pa.binary()) for v in (ids, m, X, r)],
                 pa.array([X.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([X.max(axis=0).tolist()], pa.list_(pa.float64())),
                 pa.array([float(r.max())])], names=["block", "ids", "m", "x", "r", "lo", "hi", "most"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            while t.num_rows:
                room = size - sum(h.num_rows for h in held)
                held.append(t.slice(0, room))
                t = t.slice(room)
                if sum(h.num_rows for h in held) == size:
                    yield block()
                    held = []
        if sum(h.num_rows for h in held):
            yield block()

    ordered = points.withColumn("z", order).repartitionByRange("z", "pid").sortWithinPartitions("z", "pid")
    return checkpoint(ordered.select("pid", "m", "x").mapInArrow(
        pack, "block long, ids binary, m binary, x binary, r binary, lo array<double>, hi array<double>, most double"))


def _squares(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of A and B (A.A + B.B - 2 A.B: tiny ones may be off, even below 0)."""
    return np.column_stack([A, (A ** 2).sum(axis=1), np.ones(len(A))]) @ np.column_stack([-2 * B, np.ones(len(B)), (B ** 2).sum(axis=1)]).T


def _each(batch: pa.RecordBatch):
    """The rows of a batch as dicts, one at a time: they hold whole blocks."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _paired(blocks: DataFrame, left: list[str], right: list[str], condition=None) -> DataFrame:
    """Every block (columns a_*) with every block (b_*); a task reads a part of the blocks for either side.

    The right side is dealt to a few tasks' worth of parts however large the table is, so partial results
    of a left block come from so many tasks, and parts are read from disk block by block.
    """
    n = blocks.count()
    a = blocks.select(*[F.col(c).alias(f"a_{c}") for c in left]).repartition(max(_BLOCK_PARTS, -(-n // 16)))
    b = blocks.select(*[F.col(c).alias(f"b_{c}") for c in right]).repartition(_BLOCK_PARTS)
    pairs = a.hint("shuffle_replicate_nl").join(b, condition) if condition is not None else a.hint("shuffle_replicate_nl").crossJoin(b)
    return pairs


def _block_candidates(points: DataFrame, order, k: int) -> DataFrame:
    """(a, ma, b, mb, d): pairs of points with all neighbours of each, from all pairs of blocks whose boxes are near enough.

    For many dimensions, where cells do not part neighbours from other points: distances come from
    one matrix product for two blocks, a point skips blocks whose box is beyond its bound, and a
    bound shrinks as nearer points turn up. Pairs within a bound get their distance as plain sums.
    """
    known = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))  # a point with a missing coordinate is nobody's neighbour
    blocks = _packed(points.where(known), order, k)
    gap = F.aggregate(F.zip_with(F.zip_with("a_lo", "b_hi", lambda x, y: x - y), F.zip_with("b_lo", "a_hi", lambda x, y: x - y),
                                 lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v * v)
    pairs = _paired(blocks, ["block", "ids", "m", "x", "r", "lo", "hi", "most"], ["ids", "m", "x", "lo", "hi"],
                    gap <= F.col("a_most") * F.col("a_most")).drop("a_lo", "a_hi", "a_most")

    def search(batches):
        now, found = None, None

        def out():
            row, b, mb, d = found
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(m[row]), pa.array(b), pa.array(mb), pa.array(d)],
                                             names=["a", "ma", "b", "mb", "d"])

        for batch in batches:
            for p in _each(batch):
                if p["a_block"] != now:
                    if now is not None:
                        yield from out()
                    now = p["a_block"]
                    ids, m, r = np.frombuffer(p["a_ids"], np.int64), np.frombuffer(p["a_m"], np.int64), np.frombuffer(p["a_r"]).copy()
                    X = np.frombuffer(p["a_x"]).reshape(len(ids), -1)
                    found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
                bid, bm, lo, hi = np.frombuffer(p["b_ids"], np.int64), np.frombuffer(p["b_m"], np.int64), np.array(p["b_lo"]), np.array(p["b_hi"])
                Y = np.frombuffer(p["b_x"]).reshape(len(bid), -1)
                parts = [found]
                near = np.flatnonzero((np.maximum(np.maximum(lo - X, X - hi), 0.0) ** 2).sum(axis=1) <= r ** 2)
                for f in range(0, len(near), 256):
                    rows = near[f:f + 256]
                    scale = 1e-9 * ((X[rows] ** 2).sum(axis=1) + (Y ** 2).sum(axis=1).max())
                    i, j = np.nonzero(_squares(X[rows], Y) <= (r[rows] ** 2 + scale)[:, None])
                    i = rows[i]
                    other = ids[i] != bid[j]
                    i, j = i[other], j[other]
                    d = np.zeros(len(i))
                    for c in range(X.shape[1]):
                        step = X[i, c] - Y[j, c]
                        d += step * step
                    parts.append((i, bid[j], bm[j], np.sqrt(d)))
                row, b, mb, d = (np.concatenate(v) for v in zip(*parts))
                order = np.lexsort((b, d, row))
                row = row[order]
                first = np.searchsorted(row, row)  # each point's nearest k, then their bound
                kept = np.arange(len(row)) - first < k
                order, row, first = order[kept], row[kept], first[kept]
                found = (row, b[order], mb[order], d[order])
                begins, many = np.unique(row, return_index=True, return_counts=True)[1:]
                full = many == k
                last = begins[full] + k - 1
                r[row[last]] = np.minimum(r[row[last]], found[3][last] * (1 + 1e-6) + 1e-6)
        if now is not None:
            yield from out()

    return pairs.mapInArrow(search, "a long, ma long, b long, mb long, d double")


def _kth_weighted(pairs: DataFrame, own_pts: DataFrame, k: int) -> DataFrame:
    """Weighted k-th smallest distance per ``a`` counting own copies (ma - 1) at distance 0."""
    own = own_pts.select("a", F.lit(0.0).alias("d"),
                                                    (F.col("ma") - 1).alias("wt"), F.lit(-1).cast("long").alias("b"))
    allp = own.unionByName(pairs.select("a", "d", F.col("mb").alias("wt"), "b"))
    w = Window.partitionBy("a").orderBy("d", "b").rowsBetween(Window.unboundedPreceding, 0)
    return (allp.withColumn("cum", F.sum("wt").over(w)).filter(F.col("cum") >= k)
            .groupBy("a").agg(F.min("d").alias("kd")))


def _weighted_neighbours(cand: DataFrame, own_pts: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each point, as (a, b, w, d) with w copies of point b.

    Own copies come first (distance 0), then other points by (distance, id).
    """
    own = own_pts.select(
        "a", F.col("a").alias("b"), F.lit(0.0).alias("d"), (F.col("ma") - 1).alias("mb"),
        F.lit(0).alias("_own_rank"))
    others = cand.select("a", "b", "d", "mb", F.lit(1).alias("_own_rank"))
    allp = own.unionByName(others).filter(F.col("mb") > 0)
    w = Window.partitionBy("a").orderBy("_own_rank", "d", "b")
    allp = allp.withColumn("_before", F.coalesce(
        F.sum("mb").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    take = F.least(F.col("mb"), F.lit(k) - F.col("_before"))
    return allp.withColumn("w", take).filter(F.col("w") > 0).select("a", "b", "w", "d")


# --------------------------------------------------------------------------- M3
#: Rows, and tasks, of the first steps of a fit to many rows.
_START_ROWS, _START_PARTS = 20_000, 8


@dataclass
class SvmModel:
    """Random features and weights of a fitted one-class SVM, and how it was fitted."""
    W: np.ndarray
    bias: np.ndarray
    scale: float
    w: np.ndarray
    offset: float  # of the objective whose hinge is rounded over ``band``
    band: float
    nu: float
    n: int
    passes: int = 0


def fit_ocsvm(features: DataFrame, names: list[str], nu: float = 0.05, n_components: int = 256,
              rounds: int = 30, seed: int = 42, tol: float = 1e-10) -> SvmModel:
    """One-class SVM with an RBF kernel, gamma = 1 / (d Var(X)).

    Random Fourier features (Rahimi and Recht 2007) make the model linear. The nu
    objective (Schoelkopf et al. 2001) with its hinge rounded over a narrow band is
    minimised by Newton steps on all rows: each pass adds up loss, gradient and Hessian
    per task over Arrow batches and merges them as a tree, so the result depends neither
    on the partitioning nor on a task holding its rows. :func:`ocsvm_certificate` says how
    far the result is from the best one.
    """
    d = len(names)
    # Var(X) over all entries = E[x^2] - E[x]^2 pooled across columns
    agg = features.agg(*[F.avg(F.col(c)).alias(f"m{i}") for i, c in enumerate(names)],
                       *[F.avg(F.col(c) * F.col(c)).alias(f"q{i}") for i, c in enumerate(names)],
                       F.count(F.lit(1)).alias("n")).first()
    mean_all = sum(agg[f"m{i}"] for i in range(d)) / d
    sq_all = sum(agg[f"q{i}"] for i in range(d)) / d
    var = max(sq_all - mean_all ** 2, 0.0)
    gamma = 1.0 / (d * var) if var > 0 else 1.0
    rng = np.random.default_rng(seed)
    W = rng.normal(scale=math.sqrt(2.0 * gamma), size=(d, n_components))
    model = SvmModel(W, rng.uniform(0, 2 * math.pi, size=n_components), math.sqrt(2.0 / n_components), np.zeros(n_components), 0.0,
                     0.0, nu, agg["n"])
    data = features.select(*[F.col(c).cast("double").alias(c) for c in names]).persist()
    try:
        # the mean embedding (the nu -> 1 solution) is the starting point
        model.w = _row_sums(data, names, model, lambda Z: Z.sum(axis=0)) / model.n
        start = _margins(data, names, model)
        spread = start.agg(F.stddev_pop("margin")).first()[0] or 1.0
        model.offset = exact_quantile(start, "margin", nu)
        # The way to the narrow band is taken on some of the rows, then on eight times as many, and so on:
        # they give the start, all rows the result.
        n, shares = model.n, (0.3, 0.1, 0.03, 0.01)
        stride = n // _START_ROWS
        while stride > 1:
            near = data.where(F.pmod(F.xxhash64(*names), F.lit(stride)) == 0).coalesce(_START_PARTS).persist()
            try:
                model.n = near.count()
                if model.n >= _START_ROWS // 2:  # equal rows are taken together
                    for share in shares:
                        model.band = share * spread
                        _newton(near, names, model, rounds, max(tol, 1e-6))
                    shares = shares[-1:]
            finally:
                model.n = n
                near.unpersist()
            stride //= 8
        for share in shares:
            model.band = share * spread
            _newton(data, names, model, rounds, tol)
    finally:
        data.unpersist()
    return model


def _random_features(X: np.ndarray, W: np.ndarray, bias: np.ndarray, scale: float) -> np.ndarray:
    Z = X @ W
    Z += bias
    np.cos(Z, out=Z)
    Z *= scale
    return Z


def _margins(data: DataFrame, names: list[str], model: SvmModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and the margin w.z of every row."""
    shared = data.sparkSession.sparkContext.broadcast((model.W, model.bias, model.scale, model.w))

    @F.pandas_udf(T.DoubleType())
    def margin(*cols: pd.Series) -> pd.Series:
        W, bias, scale, w = shared.value
        X = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(np.concatenate([_random_features(X[s:s + 1024], W, bias, scale) @ w for s in range(0, len(X), 1024)] or [np.empty(0)]))

    return data.select(*keep, margin(*[F.col(c).cast("double") for c in names]).alias("margin"))


def ocsvm_scores(features: DataFrame, names: list[str], model: SvmModel, row_id: str = "row_id") -> DataFrame:
    """(row_id, score = rho - w.z); rho is the exact nu-quantile of the margins, as the dual solution satisfies."""
    found = checkpoint(_margins(features, names, model, (row_id,)))
    rho = exact_quantile(found, "margin", model.nu)
    return found.select(row_id, (F.lit(rho) - F.col("margin")).alias("score"))


def ocsvm(features: DataFrame, names: list[str], nu: float = 0.05, n_components: int = 256,
          rounds: int = 30, seed: int = 42, row_id: str = "row_id", tol: float = 1e-10) -> DataFrame:
    """M3: (row_id, score) of a one-class SVM fitted to all rows."""
    return ocsvm_scores(features, names, fit_ocsvm(features, names, nu, n_components, rounds, seed, tol), row_id)


def ocsvm_certificate(features: DataFrame, names: list[str], model: SvmModel) -> dict:
    """How good a fitted model is, from one pass: primal and dual value, their gap, and the shares of the nu-property.

    The slopes of the rounded hinge at the margins are the dual variables. Scaled to a sum of 1 they
    are a solution of the dual problem (up to ``excess`` above its box), whose value bounds the best
    primal value from below. Rows with a full slope are bounded, rows with any slope are support rows.
    """
    data = features.select(*[F.col(c).cast("double").alias(c) for c in names])
    rho = exact_quantile(_margins(data, names, model), "margin", model.nu)

    def of(Z):
        m = Z @ model.w
        slope = np.clip((model.offset - m) / model.band, 0, 1)
        return np.concatenate([slope @ Z, [slope.sum(), np.maximum(rho - m, 0).sum(), (slope >= 1).sum(), (slope > 0).sum()]])

    sums = _row_sums(data, names, model, of)
    weight, hinge, bounded, support = sums[-4:]
    primal = 0.5 * model.w @ model.w - rho + hinge / (model.nu * model.n)
    dual = -0.5 * float(np.sum((sums[:-4] / weight) ** 2))
    return {"n": model.n, "passes": model.passes, "primal": float(primal), "dual": dual, "gap": float(primal - dual),
            "excess": max(0.0, model.nu * model.n / weight - 1), "bounded_share": bounded / model.n, "support_share": support / model.n}


def _row_sums(data: DataFrame, names, model: SvmModel, of) -> np.ndarray:
    """Sum over all rows of ``of`` (random features of a batch -> array), one array per task merged as a tree."""
    shared = data.sparkSession.sparkContext.broadcast((model.W, model.bias, model.scale))

    def part(batches):
        W, bias, scale = shared.value
        total = None
        for b in batches:
            X = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(b.num_columns)])
            for s in range(0, len(X), 1024):
                v = of(_random_features(X[s:s + 1024], W, bias, scale))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total, float).tobytes()], pa.binary())], names=["v"])

    model.passes += 1
    parts = data.select(*names).mapInArrow(part, "v binary").rdd.map(lambda r: np.frombuffer(r[0]))
    return parts.treeReduce(lambda a, b: a + b)


def _newton(data: DataFrame, names, model: SvmModel, rounds: int, tol: float) -> None:
    """Minimise |w|^2 / 2 - rho + sum h(rho - w.z) / (nu n), h the hinge rounded over the model's band, from its w and offset."""
    x, D, band = np.append(model.w, model.offset), len(model.w), model.band
    best, step, value = None, None, None
    for _ in range(rounds):
        w, rho = x[:D], x[D]

        def of(Z, w=w, rho=rho):
            t = rho - Z @ w
            inside = (t > 0) & (t < band)
            slope = np.clip(t / band, 0, 1)
            loss = np.where(t >= band, t - band / 2, np.where(t > 0, t * t / (2 * band), 0.0)).sum()
            some = slope > 0
            gradient = -(slope[some] @ Z[some])
            Y = np.column_stack([Z[inside], np.full(np.count_nonzero(inside), -1.0)])
            return np.concatenate([[loss], gradient, [slope.sum()], (Y.T @ Y / band).ravel()])

        sums = _row_sums(data, names, model, of) / (model.nu * model.n)
        now = 0.5 * w @ w - rho + sums[0]
        if value is not None and now > value + 1e-12 * abs(value):  # too far: half the step
            step = step / 2
            if np.linalg.norm(step) <= tol * max(np.linalg.norm(best), 1e-12):
                break
            x = best + step
            continue
        best, value = x, now
        gradient = np.append(w, -1.0) + sums[1:D + 2]
        hessian = np.diag(np.append(np.ones(D), 1e-6)) + sums[D + 2:].reshape(D + 1, D + 1)
        step = -np.linalg.solve(hessian, gradient)
        x = best + step
        if np.linalg.norm(step) <= tol * max(np.linalg.norm(best), 1e-12):
            best = x
            break
    model.w, model.offset = best[:D], float(best[D])


# --------------------------------------------------------------------------- M4-M6
_SILHOUETTE_BLOCK = 2048
#: Distinct points from which sums along lines are tried, points a line must have on average and aimed at in a segment,
#: the most lines and halvings, room for the weights of all segments, errors allowed a pair (of the points' spread),
#: each tried if the one before leaves doubt.
_LINE_POINTS, _POINTS_A_LINE, _SEGMENT_POINTS = 20_000, 40, 64
_MOST_LINES, _MOST_HALVINGS, _WEIGHT_BYTES, _LINE_ERRORS = 50_000, 11, 1 << 27, (1e-8, 1e-12)


def quantile_labels(scores: DataFrame, contamination: float, score: str = "score",
                    out: str = "label") -> tuple[DataFrame, float]:
    """M4: label = score >= linear-interpolated (1 - c) quantile."""
    thr = exact_quantile(scores, score, 1.0 - contamination)
    return scores.withColumn(out, (F.col(score) >= F.lit(thr)).cast("int")), thr


def silhouette(features: DataFrame, names: list[str], labels: DataFrame, row_id: str = "row_id",
               label: str = "label", sample: int | None = None) -> float:
    """M5: mean Euclidean silhouette; -1 unless 2 label values and more than 10 rows. See :func:`silhouettes`."""
    return silhouettes(features, names, labels, [label], row_id, sample)[label]


def silhouettes(features: DataFrame, names: list[str], labels: DataFrame, columns: list[str],
                row_id: str = "row_id", sample: int | None = None) -> dict[str, float]:
    """M5 for each of several label columns, from one pass over all rows.

    Equal rows are one point with a multiplicity. Where many points lie on few lines (all coordinates but one
    equal), distances are summed segment by segment (:mod:`line_sums`) with a bound on the error; the result
    stands if the bound leaves its rounding in no doubt. Otherwise points are packed into blocks, and tasks take
    pairs of blocks, a part of all blocks on either side, and add up each point's distances by label: all
    pairs are worked, and a task holds two blocks and what the join keeps of its part. With ``sample``
    only so many rows are taken, those with the smallest MD5 of their id.
    """
    data = (features.select(row_id, F.array(*[F.col(c).cast("double") for c in names]).alias("_x"))
            .join(labels.select(row_id, *[F.col(c).cast("string").alias(f"_l{i}") for i, c in enumerate(columns)]), row_id))
    marks = [f"_l{i}" for i in range(len(columns))]
    counts = [{r[m]: r["n"] for r in data.groupBy(m).agg(F.count(F.lit(1)).alias("n")).collect()} for m in marks]  # a row per label
    n = sum(counts[0].values())
    apart = [len(c) >= 2 and n > 10 for c in counts]
    if sample is not None and n > sample and any(apart):
        data = checkpoint(data.orderBy(F.md5(F.col(row_id).cast("string").cast("binary")), row_id).limit(sample))
        counts = [{r[m]: r["n"] for r in data.groupBy(m).agg(F.count(F.lit(1)).alias("n")).collect()} for m in marks]
        n = sum(counts[0].values())
        apart = [a and len(c) >= 2 for a, c in zip(apart, counts)]
    if not any(apart):
        return dict.fromkeys(columns, -1.0)
    codes = [{v: i for i, v in enumerate(sorted(c, key=lambda v: (v is not None, v)))} for c in counts]
    sizes = [np.array([c[v] for v in code], float) for c, code in zip(counts, codes)]
    ends = np.cumsum([0, *[len(c) for c in codes]])
    points = checkpoint(data.groupBy("_x", *marks).agg(F.count(F.lit(1)).alias("_m")).select("_x", "_m", *marks))
    kinds = _Kinds(codes, sizes, ends)
    found = _silhouettes_on_lines(points, len(names), marks, kinds, n)
    if found is None:
        centre = data.agg(*[F.avg(F.col("_x")[i]).alias(f"c{i}") for i in range(len(names))]).first()
        found = _silhouettes_by_blocks(points, np.array(centre, dtype=float), marks, kinds) / n
    return {c: round(float(t), 4) if a else -1.0 for c, t, a in zip(columns, found, apart)}


@dataclass
class _Kinds:
    """The labels of several columns: a number for each, its rows, and where the labels of a column begin among all."""
    codes: list[dict]
    sizes: list[np.ndarray]
    ends: np.ndarray

    def of(self, columns) -> np.ndarray:
        return np.array([[code[v] for v in c.to_pylist()] for code, c in zip(self.codes, columns)], np.int32)

    def weights(self, m: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Point x label: its copies where the label is its own."""
        out = np.zeros((len(m), self.ends[-1]))
        for i, o in enumerate(own):
            out[np.arange(len(m)), self.ends[i] + o] = m
        return out

    def add_up(self, sums: np.ndarray, m: np.ndarray, own: np.ndarray, error: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Per column the sum of the points' silhouettes, from their distances by label, and what an error of a mean distance makes of it."""
        total, doubt = np.zeros(len(own)), np.zeros(len(own))
        at = np.arange(len(m))
        for i, o in enumerate(own):
            mine, many = sums[:, self.ends[i]:self.ends[i + 1]], self.sizes[i]
            within = mine[at, o] / np.maximum(many[o] - 1, 1)
            others = mine / many
            others[at, o] = np.inf
            nearest = others.min(axis=1)
            most = np.maximum(nearest, within)
            some = (many[o] > 1) & (most > 0) & np.isfinite(nearest)
            total[i] = float(m @ np.where(some, (np.where(some, nearest, 0.0) - within) / np.where(some, most, 1.0), 0.0))
            if error:
                # a mean to n - 1 rows carries up to twice the error; two values of -1 to 1 are 2 apart at most
                sure = most > 6 * error
                each = np.where(sure, 3 * error / np.where(sure, most - 2 * error, 1.0), 2.0)
                doubt[i] = float(m @ np.where((many[o] > 1) & np.isfinite(nearest), each, 0.0))
        return total, doubt


def _silhouettes_by_blocks(points: DataFrame, centre: np.ndarray, marks: list[str], kinds: _Kinds) -> np.ndarray:
    """Per label column the sum of all silhouettes, by pairs of blocks of points."""
    size, ends, dims = _SILHOUETTE_BLOCK, kinds.ends, len(centre)

    def pack(batches):
        seq = 0
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                t = batch.slice(first, size)
                x = np.array(t.column(0).to_pylist(), dtype=float) - centre
                own = kinds.of(t.columns[2:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seq]), *[pa.array([v.tobytes()], pa.binary()) for v in (x, t.column(1).to_numpy().astype(float), own)]],
                    names=["seq", "x", "m", "own"])
                seq += 1

    blocks = checkpoint(points.mapInArrow(pack, "seq long, x binary, m binary, own binary")
                        .withColumn("block", F.monotonically_increasing_id()))

    def unpacked(p, side):
        m = np.frombuffer(p[f"{side}_m"])
        return np.frombuffer(p[f"{side}_x"]).reshape(len(m), -1), m, np.frombuffer(p[f"{side}_own"], np.int32).reshape(-1, len(m))

    def add_up(batches):
        now, sums = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sums.tobytes()], pa.binary())], names=["block", "sums"])
        for batch in batches:
            for p in _each(batch):
                if p["a_block"] != now:
                    if now is not None:
                        yield out()
                    now, x = p["a_block"], np.frombuffer(p["a_x"]).reshape(-1, dims)
                    sums = np.zeros((len(x), ends[-1]))
                y, m, own = unpacked(p, "b")
                weights = kinds.weights(m, own)
                for f in range(0, len(x), 256):
                    d = _squares(x[f:f + 256], y)
                    np.sqrt(np.maximum(d, 0.0, out=d), out=d)
                    if p["b_block"] == now:
                        d[np.arange(len(d)), f + np.arange(len(d))] = 0.0
                    sums[f:f + 256] += d @ weights
        if now is not None:
            yield out()

    def finish(batches):
        for batch in batches:
            total = np.zeros(len(marks))
            for p in _each(batch):
                x, m, own = unpacked(p, "a")
                total += kinds.add_up(sum(np.frombuffer(v) for v in p["sums"]).reshape(len(x), -1), m, own)[0]
            yield pa.RecordBatch.from_arrays([pa.array([t]) for t in total], names=marks)

    sums = (_paired(blocks, ["block", "x"], ["block", "x", "m", "own"]).mapInArrow(add_up, "block long, sums binary")
            .groupBy("block").agg(F.collect_list("sums").alias("sums")))  # one per part of the blocks
    whole = sums.join(blocks.select("block", F.col("x").alias("a_x"), F.col("m").alias("a_m"), F.col("own").alias("a_own")), "block")
    return np.array(whole.mapInArrow(finish, ", ".join(f"{m} double" for m in marks)).agg(*[F.sum(m) for m in marks]).first(), float)


def _silhouettes_on_lines(points: DataFrame, dims: int, marks: list[str], kinds: _Kinds, n: int) -> np.ndarray | None:
    """Per label column the mean silhouette by sums along lines; None if points are few or lie on too many lines,
    if a coordinate is missing or infinite, or if the error bound leaves the rounding in doubt."""
    at = [F.col("_x")[i] for i in range(dims)]
    odd = reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in at])
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.max(odd).alias("odd"), *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(at)],
                       *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(at)]).first()
    if facts["n"] < _LINE_POINTS or facts["odd"]:
        return None
    axis = max(range(dims), key=lambda i: (facts[f"d{i}"], -i))
    spread = math.sqrt(sum(facts[f"v{i}"] for i in range(dims)))
    most = min(_MOST_LINES, facts["n"] // _POINTS_A_LINE)
    others = F.array(*[c for i, c in enumerate(at) if i != axis]).cast("array<double>")
    rest = points.select(others.alias("rest")).distinct().limit(most + 1).collect()
    if len(rest) > most or not 0 < spread < float("inf"):
        return None
    rest = np.array(sorted(tuple(r["rest"]) for r in rest), float).reshape(len(rest), dims - 1) + 0.0
    kept = 16 * LS.NODES * int(kinds.ends[-1]) * len(rest)  # for each segment of a line, with those above it
    depth = max(0, min(math.ceil(math.log2(facts["n"] / (len(rest) * _SEGMENT_POINTS))), int(math.log2(max(1, _WEIGHT_BYTES // kept))), _MOST_HALVINGS))
    parts = 1 << depth
    cuts = points.agg(F.percentile_approx(at[axis], F.array(*[F.lit(i / parts) for i in range(1, parts)]), 20 * parts)).first()[0] if depth else []
    sc = points.sparkSession.sparkContext
    lines = sc.broadcast((rest, np.array(cuts, float)))
    width = len(marks)

    def place(batches):
        known, cuts = lines.value
        number = {r.tobytes(): i for i, r in enumerate(known)}
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                line = np.fromiter((number[r.tobytes()] for r in np.delete(x, axis, axis=1) + 0.0), np.int64, len(x))
                y = np.ascontiguousarray(x[:, axis])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(line * parts + np.searchsorted(cuts, y, side="right")), pa.array(y), pa.array(batch.column(1).to_numpy().astype(float)),
                     *[pa.array(o) for o in kinds.of(batch.columns[2:])]], names=["leaf", "y", "m", *marks])

    def pack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column(1).slice(i, 1).flatten().flatten()
                y, m = (v.to_numpy(zero_copy_only=False).astype(float) for v in held[:2])
                order = np.argsort(y, kind="stable")
                y, m, own = y[order], m[order], np.array([v.to_numpy(zero_copy_only=False) for v in held[2:]], np.int32)[:, order]
                moved = LS.basis(LS.within(y, y[0], y[-1])).T @ kinds.weights(m, own)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *[pa.array([v.tobytes()], pa.binary()) for v in (y, m, own)],
                                                  pa.array([y[0]]), pa.array([y[-1]]), pa.array([moved.tobytes()], pa.binary())],
                                                 names=["leaf", "y", "m", "own", "lo", "hi", "moved"])

    placed = points.mapInArrow(place, "leaf long, y double, m double, " + ", ".join(f"{m} int" for m in marks))
    leaves = checkpoint(placed.groupBy("leaf").agg(F.collect_list(F.struct("y", "m", *marks)).alias("points"))
                        .mapInArrow(pack, "leaf long, y binary, m binary, own binary, lo double, hi double, moved binary"))
    ends = leaves.select("leaf", "lo", "hi", "moved").orderBy("leaf").toPandas()
    moved = np.frombuffer(b"".join(ends["moved"])).reshape(len(ends), LS.NODES, -1)
    tree = sc.broadcast(LS.build(rest, depth, ends["leaf"].to_numpy(np.int64), ends["lo"].to_numpy(float), ends["hi"].to_numpy(float), moved))
    del ends, moved

    def close(batches):
        now, sums = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sums.tobytes()], pa.binary())], names=["leaf", "sums"])
        for batch in batches:
            for q in _each(batch):
                y = np.frombuffer(q["y"])
                if q["leaf"] != now:
                    if now is not None:
                        yield out()
                    now, sums = q["leaf"], np.zeros((len(y), kinds.ends[-1]))
                z, m = np.frombuffer(q["b_y"]), np.frombuffer(q["b_m"])
                weights = kinds.weights(m, np.frombuffer(q["b_own"], np.int32).reshape(width, -1))
                if q["b"] == now:
                    sums += LS.sums_on_segment(z, weights)
                    continue
                p = lines.value[0][[now // parts, q["b"] // parts]]
                p = float(((p[0] - p[1]) ** 2).sum())
                for g in range(0, len(z), 8192):
                    for f in range(0, len(y), 256):
                        d = y[f:f + 256, None] - z[g:g + 8192]
                        d *= d
                        d += p
                        sums[f:f + 256] += np.sqrt(d, out=d) @ weights[g:g + 8192]
        if now is not None:
            yield out()

    def at_tolerance(tolerance):
        def far(batches):
            for batch in batches:
                for a in batch.column(0).to_pylist():
                    at, sums, near = LS.sums_at_line(tree.value, a, tolerance)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tree.value.leaf[at]), pa.array([v.tobytes() for v in sums], pa.binary()), pa.array(near, pa.list_(pa.int64()))],
                        names=["leaf", "far", "near"])

        def finish(batches):
            for batch in batches:
                total = np.zeros((2, width))
                for q in _each(batch):
                    y, m, own = np.frombuffer(q["y"]), np.frombuffer(q["m"]), np.frombuffer(q["own"], np.int32).reshape(width, -1)
                    sums = LS.basis(LS.within(y, q["lo"], q["hi"])) @ np.frombuffer(q["far"]).reshape(LS.NODES, -1)
                    for v in q["sums"] or ():  # none for a segment of one place, which is exact at its nodes
                        sums += np.frombuffer(v).reshape(len(y), -1)
                    total += kinds.add_up(sums, m, own, tolerance)
                yield pa.RecordBatch.from_arrays([pa.array([t]) for t in total.ravel()], names=[f"t{i}" for i in range(2 * width)])

        worked = checkpoint(points.sparkSession.range(0, len(rest), 1, min(len(rest), 1024))
                            .mapInArrow(far, "leaf long, far binary, near array<long>"))
        pairs = worked.select("leaf", F.explode("near").alias("b")).join(
            leaves.select(F.col("leaf").alias("b"), F.col("y").alias("b_y"), F.col("m").alias("b_m"), F.col("own").alias("b_own")), "b")
        sums = (pairs.join(leaves.select("leaf", "y"), "leaf").mapInArrow(close, "leaf long, sums binary")
                .groupBy("leaf").agg(F.collect_list("sums").alias("sums")))
        whole = leaves.drop("moved").join(worked.select("leaf", "far"), "leaf").join(sums, "leaf", "left")
        total = whole.mapInArrow(finish, ", ".join(f"t{i} double" for i in range(2 * width))).agg(*[F.sum(f"t{i}") for i in range(2 * width)]).first()
        return np.array(total, float).reshape(2, width) / n

    for error in _LINE_ERRORS:
        mean, doubt = at_tolerance(error * spread)
        if (np.round(mean - doubt - 1e-12, 4) == np.round(mean + doubt + 1e-12, 4)).all():
            return mean
    return None


def select_model(bench: DataFrame, weights: dict | None = None, order=K.MODEL_KEYS) -> DataFrame:
    """M6: best = max((silhouette + 1) / 2 * weight) over successful models, first key wins a tie.

    ``bench`` has (model_key, silhouette, success). Returns one row (best_key);
    with no successful model the first key of ``order`` is returned.
    """
    spark = bench.sparkSession
    wt = spark.createDataFrame([(k, float((weights or {}).get(k, 1.0)), i) for i, k in enumerate(order)],
                               "model_key string, weight double, ord int")
    scored = (bench.filter("success").join(wt, "model_key", "left")
              .withColumn("weight", F.coalesce("weight", F.lit(1.0)))
              .withColumn("ord", F.coalesce("ord", F.lit(99)))
              .withColumn("weighted", (F.col("silhouette") + 1) / 2 * F.col("weight")))
    best = scored.agg(F.max_by("model_key", F.struct("weighted", (-F.col("ord")).alias("o"))).alias("best_key"))
    return best.select(F.coalesce("best_key", F.lit(order[0])).alias("best_key"))
