"""End-to-end review of one table, as the application runs it, on Spark.

table -> kinds (T6) -> typed table (T7) -> column quality (P5) -> ID columns (P6)
-> balanced selection (P9) -> DQ flags with preset toggles (Q1-Q16)
-> feature matrix (F12) -> weights from feedback (B4) -> three models (M1-M3)
-> silhouettes and best model (M5, M6) -> ensemble (M7-M9) -> rank, top-N (R1, R2)
-> reasons for the top-N (E6).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import ensemble as EN
from ..operators import explain as EX
from ..operators import features as FT
from ..operators import feedback as FB
from ..operators import kinds as KD
from ..operators import models as MD
from ..operators import profile as PF
from ..operators import quality as QC
from ..operators import results as RS
from ..operators.order import exact_quantile


@dataclass
class Review:
    kinds: dict
    typed: DataFrame
    quality: DataFrame
    selected: list[str]
    dq_summary: DataFrame
    features: DataFrame
    feature_names: list[str]
    weights: dict
    bench: DataFrame
    best_key: str
    scores: DataFrame
    ensemble: DataFrame
    ranked: DataFrame
    top: DataFrame
    reasons: DataFrame
    errors: dict = field(default_factory=dict)
    held: list = field(default_factory=list)

    def release(self) -> None:
        """Drop the frames held for the results; call it when these have been read."""
        for frame in self.held:
            frame.unpersist()


def review(df: DataFrame, preset: str = K.DEFAULT_PRESET, contamination: float | None = None,
           top_n: int = 20, feedback: DataFrame | None = None, as_of: str | None = None,
           row_id: str = "row_id") -> Review:
    p = K.PRESETS[preset]
    c = contamination if contamination is not None else p["contamination_default"]
    kinds = {r["column"]: r["kind"] for r in KD.infer_kinds(df, row_id, p["numeric_hints"]).collect()}
    typed, _ = KD.apply_kinds(df, kinds, row_id)
    held = []

    def hold(frame):
        held.append(frame.cache())
        return held[-1]

    typed = hold(typed)
    quality = hold(PF.column_quality(typed, row_id=row_id))
    kind_ids = df.sparkSession.createDataFrame([(k, v) for k, v in kinds.items()], "column string, kind string")
    ids = PF.id_columns(quality, kind_ids)
    selection = PF.balanced_selection(quality, ids)
    selected = [r["column"] for r in selection.filter("included").orderBy("position").collect()]
    summ, frame, flag_cols = QC.quality_flags(typed, kinds, p["allowed_currencies"], as_of=as_of,
                                              row_id=row_id, preset=preset)
    flags = frame.select(row_id, *[e.alias(n) for n, e in flag_cols])
    text_sel = [s for s in selected if not PF.is_numeric_type(typed.schema[s].dataType)]
    distinct = {r["column"]: r["unique"] for r in quality.select("column", "unique").collect()}
    rare_cols = [s for s in text_sel if distinct.get(s, 0) <= K.MEDIUM_CARD_LIMIT]
    # DQ flags are evaluated in the feature projection itself (no join on row_id)
    feats, spec = FT.build_features(frame, selected, p["encoding"]["onehot_max_unique"], rare_columns=rare_cols,
                                    extra_columns=flag_cols, row_id=row_id)
    feats = hold(feats)
    weights = dict(p["model_weights"])
    if feedback is not None:
        weights = {r["model_key"]: r["weight"]
                   for r in FB.derived_weights(FB.model_stats(feedback), preset, weights).collect()}
    runners = {
        "isolation_forest": lambda: MD.isolation_forest(feats, spec.names, c, row_id=row_id),
        "lof": lambda: MD.lof(feats, spec.names, row_id=row_id),
        "ocsvm": lambda: MD.ocsvm(feats, spec.names, nu=c, row_id=row_id),
    }
    parts, found, errors = [], {}, {}
    for key in K.MODEL_KEYS:
        try:  # a failing model is recorded, not fatal
            s = hold(runners[key]())
            thr = exact_quantile(s, "score", 1.0 - c)
            lab = s.select(row_id, (F.col("score") >= F.lit(thr)).cast("int").alias(key))
            found[key] = (lab, int(lab.agg(F.sum(key)).first()[0]))
            parts.append(s.select(row_id, F.lit(key).alias("model_key"), "score"))
        except Exception as e:  # noqa: BLE001
            errors[key] = f"{type(e).__name__}: {e}"
    sils = {}
    if found:  # all pairs of rows are gone through once for all models
        labels = reduce(lambda a, b: a.join(b, row_id), [lab for lab, _ in found.values()])
        sils = MD.silhouettes(feats, spec.names, labels, list(found), row_id)
    bench_rows = [(key, sils[key], found[key][1], True) if key in found else (key, -1.0, 0, False) for key in K.MODEL_KEYS]
    spark = df.sparkSession
    bench = spark.createDataFrame(bench_rows, "model_key string, silhouette double, n_anomalies long, success boolean")
    best_key = MD.select_model(bench, weights).first()["best_key"]
    scores = spark.createDataFrame([], f"{row_id} long, model_key string, score double")
    for s in parts:
        scores = scores.unionByName(s)
    ens = EN.ensemble(scores, c, weights, row_id)
    ranked = RS.ranked(ens, "ensemble_score", row_id)
    top = ranked.filter(F.col("rank") <= top_n)
    rare_t = p["encoding"]["rare_threshold"]
    reasons = EX.explain(typed, top.select(row_id), selected, rare_t, None,
                         flags if len(flags.columns) > 1 else None, row_id=row_id)
    return Review(kinds, typed, quality, selected, summ, feats, spec.names, weights, bench, best_key, scores,
                  ens, ranked, top, reasons, errors, held)
