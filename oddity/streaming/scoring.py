"""Scoring a stream with a model fitted on a batch table.

The reference has no streaming; this is the narrow part of the batch flow that
is row-local once its statistics are frozen: feature projection (fills,
one-hot, value shares, scaling) and isolation-forest scoring. It runs on a
streaming DataFrame from ``readStream`` and writes through any sink.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import models as MD


@dataclass
class FrozenForest:
    """Everything needed to score new rows: feature spec, forest and the score shift."""
    spec: FT.FeatureSpec
    forest: dict
    shift: float  # the (1 - contamination) quantile of the training scores


def fit_frozen(batch: DataFrame, selected: list[str], contamination: float = 0.05, n_trees: int = 100,
               max_onehot: int = 15, seed: int = 42, row_id: str = "row_id") -> FrozenForest:
    """Fit features and an isolation forest on a batch table; freeze what scoring needs."""
    feats, spec = FT.build_features(batch, selected, max_onehot=max_onehot, row_id=row_id)
    forest = MD.fit_isolation_forest(feats, spec.names, n_trees, 256, seed, row_id)
    raw = MD.isolation_scores(feats, spec.names, forest, row_id)
    from ..operators.order import exact_quantile
    shift = exact_quantile(raw, "raw_score", 1.0 - contamination)
    return FrozenForest(spec, forest, shift)


def score_stream(stream: DataFrame, model: FrozenForest, row_id: str = "row_id") -> DataFrame:
    """(row_id, score, is_anomaly) for every row of a (streaming or batch) DataFrame.

    A row is flagged when its score is at or above 0, i.e. at or above the
    training data's (1 - contamination) quantile.
    """
    feats = FT.project_features(stream, model.spec, row_id)
    raw = MD.isolation_scores(feats, model.spec.names, model.forest, row_id)
    score = F.col("raw_score") - F.lit(model.shift)
    return raw.select(row_id, score.alias("score"), (score >= 0).alias("is_anomaly"))
