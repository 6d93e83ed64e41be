"""Feature matrix (F1-F12): imputation, one-hot / frequency encoding, rare and
combination frequencies, rule features, merge and standard scaling.

Two passes over the data: one aggregate pass for statistics (medians, modes,
category lists, frequencies, means and population std), then one projection.
All value frequencies are counted in one pass. Lookups are joins on these tables,
with values that hold many rows broadcast and kept out of the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.expressions import contains_any_token, nan_to_null
from ..session import checkpoint
from .order import select_quantiles
from .profile import is_numeric_type

UNKNOWN = "UNKNOWN"
#: Share of the rows from which a value counts as heavy, and the bytes of heavy values that are broadcast.
HEAVY, HEAVY_BYTES = 1e-4, 8 << 20
#: Stands for null among keys; no value begins so.
_NULL = "\x00null"


def _is_feature_numeric(dt) -> bool:
    # numpy "number" excludes booleans: a selected boolean column is dropped
    return is_numeric_type(dt) and not isinstance(dt, T.BooleanType)


def split_selected(df: DataFrame, selected: list[str]):
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in selected if _is_feature_numeric(types[c])]
    categorical = [c for c in selected if isinstance(types[c], T.StringType)]
    dropped = [c for c in selected if c not in numeric and c not in categorical]
    return numeric, categorical, dropped


def long_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of the numeric columns, as double."""
    return (df.select(*[F.col(c).cast("double").alias(c) for c in columns]).withColumn("_k", F.lit(0))
            .unpivot(["_k"], columns, "column", "value").select("column", "value"))


def medians(df: DataFrame, columns: list[str]) -> dict:
    """F1 statistics: exact (linear-interpolated) median per column; None when all missing."""
    if not columns:
        return {}
    found = select_quantiles(long_numbers(df, columns), 0.5, "column", "value")
    return {c: found.get(c) for c in columns}  # one row per column


def modes(df: DataFrame, columns: list[str]) -> dict:
    """F2 statistics: most frequent value, smallest on a tie; None when all null."""
    if not columns:
        return {}
    counts = (df.select(*columns).withColumn("_k", F.lit(0)).unpivot(["_k"], columns, "column", "value")
              .filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"))
    found = {r["column"]: r["b"]["value"] for r in best.collect()}  # one row per column
    return {c: found.get(c) for c in columns}


def impute_fills(df: DataFrame, numeric: list[str], categorical: list[str]) -> dict:
    """F1 + F2 statistics: median per numeric column, mode (or UNKNOWN) per text column."""
    fills = dict(medians(df, numeric))
    for c, v in modes(df, categorical).items():
        fills[c] = v if v is not None else UNKNOWN
    return fills


def apply_fills(df: DataFrame, fills: dict, numeric: list[str], categorical: list[str],
                row_id: str = "row_id", carry: list[Column] | None = None) -> DataFrame:
    """F1 + F2 in one projection with frozen fill values (``carry``: further columns to keep)."""
    out = [F.col(row_id), *(carry or [])]
    for c in numeric:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        out.append((F.coalesce(x, F.lit(fills[c])) if fills.get(c) is not None else x).alias(c))
    for c in categorical:
        out.append(F.coalesce(F.col(c), F.lit(fills[c])).alias(c))
    return df.select(*out)


def impute(df: DataFrame, numeric: list[str], categorical: list[str], row_id: str = "row_id") -> DataFrame:
    """F1 + F2 in one projection."""
    return apply_fills(df, impute_fills(df, numeric, categorical), numeric, categorical, row_id)


def share_tables(df: DataFrame, groups: dict[str, list[str]]) -> dict[str, DataFrame]:
    """For every name, the share of each value of its columns (as text, null included): (_k0, ..., name).

    All groups are counted in one pass, whatever their number; the counts, a row for each distinct
    value, are written once.
    """
    if not groups:
        return {}
    keys = [F.struct(F.lit(name).alias("t"), F.array(*[F.col(c).cast("string") for c in cols]).alias("k")) for name, cols in groups.items()]
    counts = checkpoint(df.select(F.explode(F.array(*keys)).alias("s")).groupBy("s.t", "s.k").agg(F.count(F.lit(1)).alias("_cnt")))
    first = next(iter(groups))
    total = counts.filter(F.col("t") == first).agg(F.sum("_cnt")).first()[0]  # one scalar
    return {name: counts.filter(F.col("t") == name).select(*[F.col("k")[i].alias(f"_k{i}") for i in range(len(cols))],
                                                           (F.col("_cnt") / F.lit(total)).alias(name))
            for name, cols in groups.items()}


def onehot_categories(imputed: DataFrame, columns: list[str], max_onehot: int) -> dict:
    """Sorted categories of each column with at most ``max_onehot`` distinct values.

    Only columns under the bound bring their categories to the driver, so the
    driver never holds more than columns x max_onehot values.
    """
    if not columns:
        return {}
    # distinct (column, value) pairs, combined map-side; then the columns under the bound
    distinct = (imputed.select(*[F.col(c).cast("string").alias(c) for c in columns])
                .withColumn("_k", F.lit(0)).unpivot(["_k"], columns, "column", "value")
                .groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n")))
    sizes = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("_d"))
    small = distinct.join(F.broadcast(sizes.filter(F.col("_d") <= max_onehot)), "column")  # one row per column
    cats: dict = {}
    for r in small.select("column", "value").collect():  # at most columns x max_onehot rows
        cats.setdefault(r["column"], []).append(r["value"])
    return {c: sorted(cats[c]) for c in columns if c in cats}


@dataclass
class FeatureSpec:
    """Everything learnt from the data that the projection needs (frozen statistics)."""
    numeric: list[str]
    categorical: list[str]
    dropped: list[str]
    onehot: dict
    freq_encoded: list[str]
    names: list[str] = field(default_factory=list)
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)
    fills: dict = field(default_factory=dict)
    shares: dict = field(default_factory=dict)  # column -> frozen value-share table
    row_level_only: bool = True


def rule_features(df: DataFrame, selected: list[str]) -> list[tuple[str, Column]]:
    """F7-F9 as 0/1 columns (numeric: negative / zero / extreme; text: name and branch rules)."""
    df = nan_to_null(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    num_cols = [c for c in selected if is_numeric_type(types[c])]
    stats = {}
    if num_cols:
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(num_cols)],
                     *[F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}")
                       for i, c in enumerate(num_cols)]).first()
        stats = {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(num_cols)}
    out = []
    for c in selected:
        if c in stats:
            x = F.col(c).cast("double")
            out.append((f"{c}_is_negative", F.coalesce(x < 0, F.lit(False)).cast("int")))
            out.append((f"{c}_is_zero", F.coalesce(x == 0, F.lit(False)).cast("int")))
            mu, sd = stats[c]
            if sd is not None and sd > 0:
                out.append((f"{c}_is_extreme",
                            F.coalesce(F.abs(x - F.lit(mu)) / F.lit(sd) > K.EXTREME_Z, F.lit(False)).cast("int")))
            else:
                out.append((f"{c}_is_extreme", F.lit(0)))
            continue
        cl = c.lower()
        s = F.coalesce(F.col(c).cast("string"), F.lit("None"))
        if any(h in cl for h in K.NAME_TOKENS):
            out.append((f"{c}_digits_only", s.rlike("(?U)" + K.DIGITS_ONLY_RE).cast("int")))
            out.append((f"{c}_has_control_char", s.rlike(K.CONTROL_CHAR_RE).cast("int")))
        if any(h in cl for h in K.BRANCH_TOKENS):
            out.append((f"{c}_country_in_branch", contains_any_token(s, K.COUNTRY_TOKENS).cast("int")))
    return out


def combo_name(cols: list[str]) -> str:
    return "combo_" + "__|__".join(cols)


def build_features(df: DataFrame, selected: list[str], max_onehot: int = 15,
                   rare_columns: list[str] | None = None, combo_columns: list[str] | None = None,
                   add_rule_features: bool = False, extra: DataFrame | None = None,
                   row_id: str = "row_id", scale: bool = True,
                   extra_columns: list[tuple[str, Column]] | None = None):
    """the full feature matrix. Returns (DataFrame(row_id, *features), FeatureSpec).

    Order of features: numeric, encoded, rare, combination, rule, extra; on equal
    names the first wins (F10). Scaling uses the population standard deviation
    and leaves zero-variance features centred only (F11).
    """
    df = nan_to_null(df)
    numeric, categorical, dropped = split_selected(df, selected)
    fills = impute_fills(df, numeric, categorical)
    # F5 / F6 read the original (not imputed) values; they, the rule features and the
    # extra flag expressions travel in the same projection as the imputed values, so
    # no step joins two row-level frames on row_id
    raw_needed = list(dict.fromkeys((rare_columns or []) + (combo_columns or [])))
    rule_cols = rule_features(df, selected) if add_rule_features else []
    extra_cols = list(extra_columns or [])
    carried = ([F.col(c).alias(f"_raw_{c}") for c in raw_needed] + [e.alias(n) for n, e in rule_cols]
               + [e.alias(f"_x{i}") for i, (_, e) in enumerate(extra_cols)])
    imputed = apply_fills(df, fills, numeric, categorical, row_id, carry=carried)
    onehot = onehot_categories(imputed, categorical, max_onehot)
    freq_encoded = [c for c in categorical if c not in onehot]
    combo = combo_columns if combo_columns and len(combo_columns) >= 2 else []
    groups = {f"_fe_{c}": [c] for c in freq_encoded} | {f"_rare_{c}": [f"_raw_{c}"] for c in rare_columns or []}
    groups |= {"_combo": [f"_raw_{c}" for c in combo]} if combo else {}
    tables = share_tables(imputed, groups)
    shares = {c: tables[f"_fe_{c}"] for c in freq_encoded}
    frame = imputed
    for name, table in tables.items():
        frame = _join_share(frame, groups[name], table, name, row_id)
    cols = _encoded_columns(numeric, categorical, onehot)
    for c in rare_columns or []:
        cols.append((f"{c}_freq", F.col(f"_rare_{c}")))
        cols.append((f"{c}_is_rare", (F.col(f"_rare_{c}") < K.RARE_FEATURE_THRESHOLD).cast("double")))
    if combo:
        name = combo_name(combo)
        cols.append((f"{name}_freq", F.col("_combo")))
        cols.append((f"{name}_is_rare", (F.col("_combo") < K.RARE_FEATURE_THRESHOLD).cast("double")))
    cols += [(n, F.col(n)) for n, _ in rule_cols]
    cols += [(n, F.coalesce(F.col(f"_x{i}").cast("double"), F.lit(0.0))) for i, (n, _) in enumerate(extra_cols)]
    if extra is not None:  # flags held in a separate frame: joined on row_id
        extra_cols = [c for c in extra.columns if c != row_id]
        frame = frame.join(extra, row_id, "left")
        cols += [(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in extra_cols]
    seen, merged = set(), []
    for name, e in cols:
        if name in seen:
            continue
        seen.add(name)
        merged.append((name, e.cast("double")))
    features = frame.select(row_id, *[e.alias(n) for n, e in merged])
    spec = FeatureSpec(numeric, categorical, dropped, onehot, freq_encoded, [n for n, _ in merged])
    spec.fills, spec.shares = fills, shares
    spec.row_level_only = not (raw_needed or rule_cols or extra is not None or extra_cols)
    if scale:
        features, spec = standard_scale(features, spec, row_id)
    return features, spec


def _encoded_columns(numeric, categorical, onehot) -> list[tuple[str, Column]]:
    """Numeric columns, then one-hot (sorted categories; a two-category column keeps the
    second only) or frequency encoding per text column."""
    cols: list[tuple[str, Column]] = [(c, F.col(c)) for c in numeric]
    for c in categorical:
        if c in onehot:
            cats = onehot[c]
            keep = cats[1:] if len(cats) == 2 else cats
            cols += [(f"{c}_{v}", (F.col(c) == F.lit(v)).cast("double")) for v in keep]
        else:
            cols.append((f"{c}_freq", F.col(f"_fe_{c}")))
    return cols


def _look_up(df: DataFrame, cols: list[str], shares: DataFrame, name: str, spread: Column | None = None) -> DataFrame:
    """``df`` with the share of its values; rows with ``spread`` look for a key of their own that nothing has."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit(_NULL)) for c in cols]
    if spread is not None:
        keys[0] = F.coalesce(spread, keys[0])
    left = df.select("*", *[k.alias(f"_l{i}") for i, k in enumerate(keys)])
    right = shares.select(*[F.coalesce(f"_k{i}", F.lit(_NULL)).alias(f"_l{i}") for i in range(len(cols))], F.col(name).alias("_share"))
    on = [f"_l{i}" for i in range(len(cols))]
    return left.join(right, on, "left").drop(*on)


def _join_share(df: DataFrame, cols: list[str], shares: DataFrame, name: str, row_id: str | None = None) -> DataFrame:
    """``df`` with the share of its values as ``name`` (0 for a value without one).

    Values that hold ``HEAVY`` of the rows or more, at most 1 / ``HEAVY`` of them, are broadcast if
    they are short enough; the others are joined by shuffle, in which rows with a heavy value are
    spread evenly. Without ``row_id`` (a stream, a frozen table) the planner chooses.
    """
    if row_id is not None:
        size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(f"_k{i}")), F.lit(0)) + 16 for i in range(len(cols))])
        heavy = F.col(name) >= HEAVY
        found = shares.agg(F.sum(F.when(heavy, size).otherwise(0)).alias("bytes"), F.count_if(~heavy).alias("rest")).first()
        if (found["bytes"] or 0) <= HEAVY_BYTES:
            df = _look_up(df, cols, F.broadcast(shares.filter(heavy)), name).withColumnRenamed("_share", name)
            if not found["rest"]:
                return df.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
            done = F.when(F.col(name).isNotNull(), F.concat(F.lit(_NULL + "row "), F.col(row_id).cast("string")))
            df = _look_up(df, cols, shares.filter(~heavy), name, done)
            return df.withColumn(name, F.coalesce(F.col(name), F.col("_share"), F.lit(0.0))).drop("_share")
    out = _look_up(df, cols, shares, name)
    return out.withColumn(name, F.coalesce(F.col("_share"), F.lit(0.0))).drop("_share")


def project_features(df: DataFrame, spec: FeatureSpec, row_id: str = "row_id") -> DataFrame:
    """Apply frozen statistics (fills, categories, value shares, means, stds) to new rows.

    Row-local apart from a join with the frozen share tables, so it also runs on a
    streaming DataFrame (stream-static join). Only specs without rare, combination,
    rule or extra features can be projected this way.
    """
    if not spec.row_level_only:
        raise ValueError("only numeric / one-hot / frequency features can be projected onto new rows")
    frame = apply_fills(df, spec.fills, spec.numeric, spec.categorical, row_id)
    for c in spec.freq_encoded:
        frame = _join_share(frame, [c], spec.shares[c], f"_fe_{c}")
    cols = dict(_encoded_columns(spec.numeric, spec.categorical, spec.onehot))
    raw = frame.select(row_id, *[cols[n].cast("double").alias(n) for n in spec.names])
    return apply_scaling(raw, spec, row_id) if spec.means else raw


def standard_scale(features: DataFrame, spec: FeatureSpec, row_id: str = "row_id"):
    """(x - mean) / population std; a zero-variance feature is only centred."""
    names = spec.names
    if not names:
        return features, spec
    features = nan_to_null(features)
    row = features.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
                       *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)]).first()
    spec.means = {c: row[f"m{i}"] for i, c in enumerate(names)}
    spec.stds = {c: row[f"s{i}"] for i, c in enumerate(names)}
    return apply_scaling(features, spec, row_id), spec


def apply_scaling(features: DataFrame, spec: FeatureSpec, row_id: str = "row_id") -> DataFrame:
    out = [F.col(row_id)]
    for c in spec.names:
        mu, sd = spec.means[c], spec.stds[c]
        centred = F.col(c) - F.lit(mu)
        out.append((centred / F.lit(sd) if sd and sd > 0 else centred).alias(c))
    return features.select(*out)
