"""Mining trucks: readings and failures to labelled windows, risk, alerts and their quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigpulse.config import ForestConfig, RiskConfig
from rigpulse.operators.evaluate import (alert_precision, average_precision, early_warning_report, lead_time_summary,
                                         pr_curve_at, roc_auc)
from rigpulse.operators.forest import fit_isolation_forest, outlier_label, score_isolation_forest
from rigpulse.operators.impute import impute_with_flags, medians_of
from rigpulse.operators.joins import WINDOW_KEYS, alert_rows, merge_window_features, next_event_asof
from rigpulse.operators.labels import label_windows
from rigpulse.operators.resample import steady_fuel_features, window_aggregate
from rigpulse.operators.risk import (alert_contributions, alert_text, domain_hints, predict_risk, top_factors,
                                     train_risk_model)
from rigpulse.operators.rolling import add_rail_features
from rigpulse.operators.shaping import feature_columns, prediction_table
from rigpulse.operators.stats import null_profile_row
from rigpulse.session import materialize

NOT_INPUTS = {"asset_id", "mdm_object_name", "timestamp", "event_dt", "days_to_event", "target"}


def seconds_of(window: str) -> int:
    amount, unit = window.split()
    return int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def window_features(tele: DataFrame, cfg: RiskConfig = RiskConfig(), dense: bool = True) -> DataFrame:
    """Pressure, temperature and steady-state fuel per machine and window."""
    derived = add_rail_features(tele)
    base = window_aggregate(derived, seconds_of(cfg.window), dense)
    return merge_window_features(base, steady_fuel_features(tele, seconds_of(cfg.fuel_window), dense))


def labelled_windows(tele: DataFrame, events: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Window features with the next failure and the target."""
    return label_windows(next_event_asof(window_features(tele, cfg), events), cfg.empty_days, cfg.target_days)


def add_outlier_feature(df: DataFrame, columns: list[str], cfg: RiskConfig, forest: ForestConfig | None = None
                        ) -> DataFrame:
    """+1 / -1 by an isolation forest over all windows, as the feature ``anomaly_score``."""
    shape = forest or ForestConfig(sample_rows=256, contamination=cfg.outlier_share, seed=cfg.seed)
    key = list(WINDOW_KEYS)
    model = materialize(fit_isolation_forest(df, [], columns, key, shape))
    scored = score_isolation_forest(df, model, [], columns, key, F.lit(True), shape, "_outlier")
    return scored.withColumn("anomaly_score", outlier_label("_outlier").cast("double")).drop("_outlier")


@dataclass(frozen=True)
class RiskRun:
    model: Model
    columns: list[str]
    features: DataFrame
    predictions: DataFrame

    def early_warning(self, threshold: float) -> DataFrame:
        return early_warning_report(self.predictions, threshold)

    def metrics(self, threshold: float) -> dict[str, DataFrame]:
        report = self.early_warning(threshold)
        return {
            "roc_auc": roc_auc(self.predictions), "average_precision": average_precision(self.predictions),
            "pr_curve_at": pr_curve_at(self.predictions), "alert_precision": alert_precision(self.predictions, threshold),
            "lead_time": lead_time_summary(report),
        }

    def explanations(self, threshold: float, n: int = 8) -> DataFrame:
        """Factors of the first alert of every detected event."""
        alerts = alert_rows(self.features.drop("event_dt"), self.predictions, self.early_warning(threshold))
        typical = medians_of(self.features, self.columns)
        keys = [*WINDOW_KEYS, "event_dt"]
        moved = alert_contributions(self.model, alerts, self.columns, typical, keys)
        return alert_text(domain_hints(top_factors(moved, keys, n)))


def run_risk(windows: DataFrame, cfg: RiskConfig = RiskConfig(), forest: ForestConfig | None = None,
             train: DataFrame | None = None) -> RiskRun:
    """Fit on the labelled windows (or on ``train``, a part of them) and score them all.

    Features without any value are left out.
    """
    stored = materialize(windows)
    rows = stored.count()
    nulls = null_profile_row(stored, feature_columns(stored, NOT_INPUTS))
    raw = [c for c, n in nulls.items() if n < rows]
    filled = impute_with_flags(stored.drop(*[c for c in nulls if c not in raw]), raw)
    inputs = [*raw, *[c for c in filled.columns if c.endswith("_is_missing")]]
    ready = materialize(add_outlier_feature(filled, inputs, cfg, forest))
    columns = [*inputs, "anomaly_score"]
    fitted_on = ready if train is None else ready.join(train.select(*WINDOW_KEYS), list(WINDOW_KEYS), "left_semi")
    model = train_risk_model(fitted_on, columns, cfg)
    predictions = materialize(prediction_table(predict_risk(model, ready, columns)))
    return RiskRun(model, columns, ready, predictions)
