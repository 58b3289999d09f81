"""Excavators: readings to scored readings, episodes and their explanation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigpulse.config import EpisodeConfig, ForestConfig
from rigpulse.functions.columns import round_ts
from rigpulse.functions.quantiles import group_quantiles
from rigpulse.functions.series import number_rows
from rigpulse.operators.episodes import (assign_episode_id, episode_contributions, episode_examples, episode_summary)
from rigpulse.operators.forest import fit_isolation_forest, score_isolation_forest
from rigpulse.operators.impute import fill_forward_backward
from rigpulse.operators.quality import flag_technical_values
from rigpulse.operators.rolling import (EXCAVATOR, episode_score, healthy_proxy, label_regime, sampling_step,
                                        sliding_features, sliding_names)
from rigpulse.operators.scoring import (attach_thresholds, ensemble_score, flag_anomalies, normalized,
                                        reference_stats, regime_thresholds, robust_stat_score)
from rigpulse.operators.shaping import canonicalize, dedup_readings
from rigpulse.schemas import EXCAVATOR_NAMES, EXCAVATOR_SENSORS
from rigpulse.session import materialize

KEY = ["excavator_id"]
ROW_KEY = ["excavator_id", "timestamp"]


def load_telemetry(raw: DataFrame) -> DataFrame:
    """Canonical names, wanted columns, times rounded to half a second."""
    named = canonicalize(raw, EXCAVATOR_NAMES)
    return named.select("excavator_id", round_ts("timestamp").alias("timestamp"), *EXCAVATOR_SENSORS)


def clean_readings(raw: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Flag technical values, keep the first reading of each moment, fill gaps.

    Filling reads its rows twice, so the readings that are kept are written once.
    """
    known = raw.where(F.col("excavator_id").isNotNull() & F.col("timestamp").isNotNull())
    unique = materialize(dedup_readings(flag_technical_values(known), ROW_KEY, order))
    return fill_forward_backward(unique, EXCAVATOR, EXCAVATOR_SENSORS)


def feature_table(clean: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """Regimes, sampling step, training mark, window features."""
    labeled = healthy_proxy(label_regime(clean, cfg), cfg)
    stepped = materialize(number_rows(labeled.join(sampling_step(clean), KEY), EXCAVATOR), partition_by=("step",))
    return sliding_features(stepped, cfg)


def score_excavators(raw: DataFrame, cfg: EpisodeConfig = EpisodeConfig(), order: Sequence[str | Column] = ("timestamp",),
                     forest: ForestConfig | None = None, keep_features: bool = False) -> DataFrame:
    """Point and episode scores and labels of every reading, all machines in one job.

    Labelling works on the readings and scores alone; ``keep_features`` joins the window features back.
    """
    clean = materialize(clean_readings(raw, order))
    features = materialize(feature_table(clean, cfg))
    names = [*EXCAVATOR_SENSORS, *sliding_names(cfg)]
    train = F.col("is_train") == 1
    scored = features
    if cfg.forest_weight:
        shape = forest or ForestConfig(trees=cfg.trees, sample_fraction=cfg.sample_fraction,
                                       contamination=cfg.contamination, seed=cfg.seed)
        groups = [*KEY, "regime"]
        model = materialize(fit_isolation_forest(features.where(train), groups, names, ROW_KEY, shape,
                                                 cfg.min_regime_rows))
        scored = score_isolation_forest(features, model, groups, names, ROW_KEY, train, shape, "_if")
    else:
        scored = scored.withColumn("_if", F.lit(None).cast("double"))
    if cfg.stat_weight:
        scored = robust_stat_score(scored, KEY, names, {"anomaly_score_stat": F.lit(True), "_stat_train": train},
                                   cfg.mad_floor, [c for c in scored.columns if c not in sliding_names(cfg)])
    else:
        scored = scored.withColumns({c: F.lit(None).cast("double") for c in ("anomaly_score_stat", "_stat_train")})
    labelled = label_scores(materialize(scored.drop(*sliding_names(cfg))), cfg)
    if keep_features:
        labelled = labelled.join(features.select(*ROW_KEY, *sliding_names(cfg)), ROW_KEY)
    return labelled


def label_scores(scored: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """Normalize, combine, threshold and smooth the point scores."""
    train = F.col("is_train") == 1
    fills = None
    if cfg.forest_weight:
        known = F.col("_if")
        fills = materialize(group_quantiles(
            scored, KEY, {"_fill": (known, 0.5), "_fill_train": (F.when(train, known), 0.5)}))
    if fills is not None:
        scored = scored.join(fills, KEY, "left")
    else:
        scored = scored.withColumns({c: F.lit(None).cast("double") for c in ("_fill", "_fill_train")})
    scored = scored.select(
        "*", F.coalesce("_if", "_fill").alias("anomaly_score_if"),
        F.when(train, F.coalesce("_if", "_fill_train")).alias("_if_train")).drop("_if", "_fill", "_fill_train")
    used = [c for c, w in (("_if_train", cfg.forest_weight), ("_stat_train", cfg.stat_weight)) if w]
    stats = materialize(reference_stats(scored.where(train), KEY, used, cfg.mad_floor))
    scored = scored.join(stats, KEY, "left")

    def norm(column: str, reference: str) -> Column:
        return normalized(column, reference) if reference in used else F.lit(None).cast("double")

    def combined(a: str, b: str) -> Column:
        return ensemble_score([(cfg.forest_weight, F.col(a)), (cfg.stat_weight, F.col(b))])

    scored = scored.select(
        "*", norm("anomaly_score_if", "_if_train").alias("score_if_norm"),
        norm("anomaly_score_stat", "_stat_train").alias("score_stat_norm"),
        norm("_if_train", "_if_train").alias("_if_norm"), norm("_stat_train", "_stat_train").alias("_stat_norm"))
    scored = scored.select("*", combined("score_if_norm", "score_stat_norm").alias("anomaly_score"),
                           combined("_if_norm", "_stat_norm").alias("_train_score"))
    scored = scored.drop(*[c for c in scored.columns if c.endswith(("_ref_median", "_ref_mad", "_if_train", "_stat_train"))],
                         "_if_norm", "_stat_norm")
    local, overall = regime_thresholds(scored.where(train), KEY, "_train_score", cfg.score_quantile, cfg.min_regime_rows)
    pointed = flag_anomalies(attach_thresholds(scored, local, overall, KEY))
    smoothed = episode_score(pointed, cfg)
    return (flag_anomalies(smoothed, "anomaly_score_episode", "machine_threshold", "anomaly_episode")
            .drop("machine_threshold", "_train_score", "_row", "step"))


def explain_episodes(scored: DataFrame, min_points: int = 5, top: int = 3, examples: int = 2
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Episode summary, top contributions and example readings of all machines."""
    points = materialize(assign_episode_id(scored))
    episodes = materialize(episode_summary(points, min_points=min_points))
    contributions = materialize(episode_contributions(points, episodes, top=top))
    return episodes, contributions, episode_examples(points, contributions, k=top, examples=examples)
