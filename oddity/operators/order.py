"""Distributed order operators: global row number, prefix sums, average
percentile rank and exact quantiles.

A global ``row_number()`` or running sum without ``PARTITION BY`` runs in one
task. Here the data is range-partitioned and sorted inside each partition, the
per-partition counts (one row per partition, so bounded by the partition
count) give each partition its starting offset, and the offset is added back
through a broadcast join. Range sampling is not stable across recomputation,
so the sorted frame is checkpointed before partition ids are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def _offsets(frame: DataFrame, pid: str, weight: str) -> DataFrame:
    """Exclusive running total of ``weight`` per partition id (one row per partition)."""
    per_part = frame.groupBy(pid).agg(F.sum(weight).alias("_part_total"))
    w = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(pid, F.coalesce(F.sum("_part_total").over(w), F.lit(0)).alias("_offset"))


def row_number_global(df: DataFrame, order_cols: list[Column], out: str = "rn") -> DataFrame:
    """1-based row number of every row in ``order_cols`` order, computed in parallel.

    ``order_cols`` must make the order total (end with a unique key) so that
    equal sort keys are split between partitions instead of landing in one.
    """
    ordered = (df.repartitionByRange(*order_cols)
               .sortWithinPartitions(*order_cols)
               .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = checkpoint(ordered)
    ordered = (ordered
               .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
               .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
               .withColumn("_one", F.lit(1)))
    offsets = _offsets(ordered, "_pid", "_one")
    return (ordered.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_offset") + F.col("_local") + 1)
            .drop("_mid", "_pid", "_local", "_one", "_offset"))


def dense_index(df: DataFrame, out: str = "row_id") -> DataFrame:
    """0-based position of each row in the frame's current partition order.

    For a file scan that order is file order, which is what "the first n rows"
    means in the reference. The frame is checkpointed so the ids never change.
    """
    tagged = checkpoint(df.withColumn("_mid", F.monotonically_increasing_id()))
    tagged = (tagged
              .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
              .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
              .withColumn("_one", F.lit(1)))
    offsets = _offsets(tagged, "_pid", "_one")
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_offset") + F.col("_local")).cast("long"))
            .drop("_mid", "_pid", "_local", "_one", "_offset"))


def prefix_sum(df: DataFrame, order_cols: list[str], weight: str, out: str = "before") -> DataFrame:
    """Exclusive running total of the integer column ``weight`` in ``order_cols`` order.

    ``order_cols`` must be unique in ``df`` (used on grouped frames, e.g. one row
    per distinct score). Totals run inside range partitions, whose own totals are added.
    """
    ranged = checkpoint(df.repartitionByRange(*order_cols).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn(out, F.coalesce(F.sum(weight).over(w), F.lit(0)))
    return (local.join(F.broadcast(_offsets(ranged, "_pid", weight)), "_pid")  # one row per partition
            .withColumn(out, F.col(out) + F.col("_offset"))
            .drop("_pid", "_offset"))


def known_scores(df: DataFrame, score: str) -> DataFrame:
    """Rows whose score is neither null nor NaN."""
    return df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def score_distribution(df: DataFrame, score: str) -> DataFrame:
    """One row per distinct known score: ``cnt`` rows hold it, ``before`` rows are smaller.

    The count is combined map-side, so a score held by a third of the rows is
    one row here.
    """
    counts = known_scores(df, score).groupBy(score).agg(F.count(F.lit(1)).alias("cnt"))
    return prefix_sum(counts, [score], "cnt", "before")


def percentile_rank(df: DataFrame, score: str, out: str = "pct",
                    dist: DataFrame | None = None) -> DataFrame:
    """pandas ``rank(pct=True, method="average")``: average 1-based rank over the number of known scores.

    Rows without a score stay, with a null rank.
    """
    dist = dist if dist is not None else score_distribution(df, score)
    total = dist.agg(F.sum("cnt")).first()[0]  # one scalar
    ranked = dist.select(score, ((F.col("before") + (F.col("cnt") + 1) / 2.0) / F.lit(total)).alias(out))
    return df.join(ranked, score, "left")


def quantile_from_distribution(dist: DataFrame, p: float) -> float | None:
    """Exact linear-interpolated quantile (numpy default) read from a score distribution.

    Only the one or two distinct scores that hold order statistics floor(h)
    and floor(h)+1 (h = (n-1)p) are brought to the driver.
    """
    n = dist.agg(F.sum("cnt")).first()[0]
    if not n:
        return None
    h = (n - 1) * p
    lo = int(h)
    hi = min(lo + 1, n - 1)
    score = dist.columns[0]
    rows = (dist.filter(((F.col("before") <= lo) & (F.col("before") + F.col("cnt") > lo))
                        | ((F.col("before") <= hi) & (F.col("before") + F.col("cnt") > hi)))
            .select(score, "before", "cnt").collect())
    def at(i):
        for r in rows:
            if r["before"] <= i < r["before"] + r["cnt"]:
                return float(r[score])
        raise AssertionError("order statistic not found")
    x_lo, x_hi = at(lo), at(hi)
    return x_lo + (h - lo) * (x_hi - x_lo)


def select_quantiles(values: DataFrame, p: float, group: str, value: str, most: int = 1 << 16) -> dict:
    """Exact linear-interpolated quantile of every group, by selection: nothing is sorted or shuffled but counts.

    A sketch brackets the two order statistics of each group; one pass counts the values below the
    bracket and each distinct value inside it. Brackets with more than ``most`` distinct values are
    narrowed by a sketch of their inside, and one that missed is widened. The groups are columns or
    models: a row of each, and at most ``most`` values, reach the driver. Groups without a known
    value are left out.
    """
    data = known_scores(values.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")), "v").persist()
    try:
        slack, found, todo = 2.5e-4, {}, None
        rows = data.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
            "v", [max(0.0, p - slack), min(1.0, p + slack)], 10_000).alias("b")).collect()
        todo = {r["g"]: {"n": r["n"], "lo": r["b"][0], "hi": r["b"][1], "h": (r["n"] - 1) * p, "slack": slack} for r in rows}
        for state in todo.values():  # the sketch places ranks within 1e-4 of n, and a rank is a whole number
            if state["n"] * slack < 2:
                state["lo"], state["hi"] = -math.inf, math.inf
        while todo:
            bound = lambda side: F.element_at(F.create_map(*[x for g, s in todo.items() for x in (F.lit(g), F.lit(s[side]))]), F.col("g"))
            rest = data.where(F.col("g").isin(list(todo))).withColumn("lo", bound("lo")).where(F.col("v") <= bound("hi"))
            inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))
            counts = rest.groupBy("g", inside.alias("x")).agg(F.count(F.lit(1)).alias("c")).limit(most + len(todo) + 1).collect()
            if len(counts) > most + len(todo):
                _narrow(rest, todo)
                continue
            for g, s in list(todo.items()):
                below = sum(r["c"] for r in counts if r["g"] == g and r["x"] is None)
                held = sorted((r["x"], r["c"]) for r in counts if r["g"] == g and r["x"] is not None)
                first = int(s["h"])
                last = min(first + 1, s["n"] - 1)
                if below > first or below + sum(c for _, c in held) <= last:
                    s["lo"], s["hi"], s["slack"] = -math.inf, math.inf, 4 * s["slack"]
                    continue
                at, ends = below, {}
                for x, c in held:
                    for k in (first, last):
                        if at <= k < at + c:
                            ends[k] = x
                    at += c
                low, high = ends[first], ends[last]
                found[g] = low if low == high else low + (s["h"] - first) * (high - low)
                del todo[g]
        return found
    finally:
        data.unpersist()


def _narrow(rest: DataFrame, todo: dict) -> None:
    """Tighter brackets for groups with too many values inside theirs, from a sketch of these values."""
    inside = F.col("v") >= F.col("lo")
    sizes = {r["g"]: r for r in rest.groupBy("g").agg(F.count_if(~inside).alias("below"), F.count_if(inside).alias("m")).collect()}
    for g, s in todo.items():
        m = max(1, sizes[g]["m"])
        share = (s["h"] - sizes[g]["below"]) / m
        ends = [min(1.0, max(0.0, x)) for x in (share - s["slack"] - 1 / m, share + s["slack"] + 2 / m)]
        b = rest.where((F.col("g") == F.lit(g)) & inside).agg(F.percentile_approx("v", ends, 10_000)).first()[0]
        if b:
            s["lo"], s["hi"] = max(s["lo"], b[0]), min(s["hi"], b[1])


def exact_quantile(df: DataFrame, score: str, p: float) -> float | None:
    """Exact linear-interpolated quantile of the known scores; None without any."""
    return select_quantiles(df.select(F.lit(0).alias("g"), F.col(score).alias("v")), p, "g", "v").get(0)
