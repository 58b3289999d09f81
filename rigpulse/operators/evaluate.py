"""Ranking metrics, alerts, lead time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rigpulse.functions.quantiles import group_quantiles
from rigpulse.operators.labels import in_horizon
from rigpulse.operators.stats import with_constants
from rigpulse.session import materialize

EVENT = ("asset_id", "event_dt")


def ranked_scores(df: DataFrame, score: str = "proba", target: str = "target") -> DataFrame:
    """One row per distinct score: positives and negatives at it (p, n) and from the top down to it (tp, fp).

    ``position`` counts distinct scores from the lowest; ``scores``, ``all_p`` and ``all_n`` are the totals. ``df`` is
    read once: its distinct scores are dealt into ranges, as many as the shuffle has partitions, and written with the
    number of their range. The totals of the ranges carry the running sums, and each range is ordered by itself.
    """
    groups = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n"))
    ranged = materialize(groups.repartitionByRange("score").withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy("range").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    # one row for each range: no more than the shuffle has partitions
    carried = totals.select(
        "range", F.coalesce(F.sum("p").over(after), zero).alias("p_above"),
        F.coalesce(F.sum("n").over(after), zero).alias("n_above"),
        F.coalesce(F.sum("m").over(before), zero).alias("m_below"),
        F.sum("p").over(everything).alias("all_p"), F.sum("n").over(everything).alias("all_n"),
        F.sum("m").over(everything).alias("scores"))
    up = Window.partitionBy("range").orderBy("score")
    down = Window.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.withColumn("_tp", F.sum("p").over(down)).withColumn("_fp", F.sum("n").over(down))
            .withColumn("_up", F.row_number().over(up)).join(carried, "range")
            .select("score", "p", "n", (F.col("p_above") + F.col("_tp")).alias("tp"),
                    (F.col("n_above") + F.col("_fp")).alias("fp"),
                    (F.col("m_below") + F.col("_up") - 1).alias("position"), "all_p", "all_n", "scores"))


def roc_auc(df: DataFrame, score: str = "proba", target: str = "target") -> DataFrame:
    """Share of (positive, negative) pairs in the right order; ties count one half."""
    ranked = ranked_scores(df, score, target)
    negatives_below = F.col("all_n") - F.col("fp")
    won = F.sum((negatives_below + F.col("n") / 2) * F.col("p"))
    pairs = F.max(F.col("all_p").cast("double") * F.col("all_n"))
    return ranked.agg(F.try_divide(won, pairs).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "proba", target: str = "target") -> DataFrame:
    """Sum over thresholds of recall gained times precision."""
    ranked = ranked_scores(df, score, target)
    step = F.try_divide(F.col("p").cast("double"), F.col("all_p"))
    return ranked.agg(F.sum(step * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def pr_curve(df: DataFrame, score: str = "proba", target: str = "target") -> DataFrame:
    """Precision and recall of every threshold, ``position`` 0 being the lowest."""
    return ranked_scores(df, score, target).select(
        "position", F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("all_p")).alias("recall"))


def pr_curve_at(df: DataFrame, shares: Sequence[float] = (0.01, 0.05, 0.1), score: str = "proba",
                target: str = "target") -> DataFrame:
    """Precision at curve index ``int(length * share)``, counted from the lowest threshold.

    The curve is one point longer than its thresholds.
    """
    curve = ranked_scores(df, score, target)
    wanted = F.array(*[F.struct(F.lit(k).alias("share"), F.floor((F.col("scores") + 1) * F.lit(k)).alias("at"))
                       for k in shares])
    hit = curve.withColumn("_hit", F.filter(wanted, lambda w: w["at"] == F.col("position")))
    return hit.select(F.inline("_hit"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision")).select(
        "share", "precision")


def precision_at_top(df: DataFrame, shares: Sequence[float] = (0.01, 0.05, 0.1), score: str = "proba",
                     target: str = "target") -> DataFrame:
    """Precision among the best-scored share of rows; rows tied with the last one count too."""
    curve = ranked_scores(df, score, target)
    taken = F.col("tp") + F.col("fp")
    rows = F.col("all_p") + F.col("all_n")
    best = [F.min_by(F.struct(F.lit(k).alias("share"), (F.col("tp") / taken).alias("precision")),
                     F.when(taken >= F.ceil(rows * F.lit(k)), taken)).alias(f"k{i}") for i, k in enumerate(shares)]
    return curve.agg(*best).select(F.inline(F.array(*[F.col(f"k{i}") for i in range(len(shares))])))


def precision_at_recall(df: DataFrame, recall: float = 0.8, score: str = "proba", target: str = "target") -> DataFrame:
    """Precision at the highest threshold that reaches the recall."""
    curve = pr_curve(df, score, target)
    return curve.agg(F.max_by("precision", F.when(F.col("recall") >= recall, F.col("threshold"))).alias("precision"),
                     F.max(F.when(F.col("recall") >= recall, F.col("threshold"))).alias("threshold"))


def event_alerts(pred: DataFrame, threshold: float = 0.6, first: float = 7, last: float = 30) -> DataFrame:
    """One row per event with a window in the horizon: alerted or not, and its windows by target."""
    inside = in_horizon(first, last)
    return (pred.where(F.col("asset_id").isNotNull() & F.col("event_dt").isNotNull()).groupBy(*EVENT).agg(
        F.bool_or(inside).alias("_inside"),
        F.bool_or(inside & (F.col("proba") >= threshold)).alias("alert"),
        F.count_if(F.col("target") == 1).alias("windows_1"),
        F.count_if(F.col("target") == 0).alias("windows_0"))
        .where("_inside").drop("_inside").withColumn("alert", F.coalesce("alert", F.lit(False))))


def alert_precision(pred: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Precision of alerts, where every window of an alerted event counts."""
    events = event_alerts(pred, threshold)
    def total(column: str, alert: bool):
        return F.coalesce(F.sum(F.when(F.col("alert") == alert, F.col(column))), F.lit(0))

    counts = events.agg(total("windows_1", True).alias("true_positive"),
                        total("windows_0", True).alias("false_positive"),
                        total("windows_1", False).alias("false_negative"))
    share = F.try_divide(F.col("true_positive").cast("double"), F.col("true_positive") + F.col("false_positive"))
    return counts.withColumn("precision", F.coalesce(share, F.lit(0.0)))


def event_recall(pred: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Share of events that were alerted, every event counting once."""
    return event_alerts(pred, threshold).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("alert").alias("alerted"),
        F.avg(F.col("alert").cast("double")).alias("recall"))


def early_warning_report(pred: DataFrame, threshold: float = 0.6, first: float = 7, last: float = 30) -> DataFrame:
    """One row per event: its earliest alert in the horizon and the days it came ahead."""
    inside = pred.where(in_horizon(first, last))
    fired = F.col("proba") >= threshold
    earliest = F.max_by(
        F.struct(F.col("timestamp").alias("ts"), F.col("days_to_event").alias("days"), F.col("proba").alias("p")),
        F.when(fired, F.struct(F.col("days_to_event"), F.col("proba"))))
    return (inside.groupBy(*EVENT).agg(earliest.alias("_a"), F.bool_or(F.col("target") == 1).alias("_real"))
            .where("_real")
            .select(*EVENT, F.col("_a.ts").alias("first_alert_ts"), F.col("_a.days").alias("lead_days"),
                    F.col("_a.p").alias("first_alert_proba"))
            .withColumn("detected", F.col("lead_days").isNotNull()))


def lead_time_summary(report: DataFrame) -> DataFrame:
    """Events, detection rate, mean and median lead of the detected ones."""
    medians = group_quantiles(report.where("detected"), [], {"median_lead_days": (F.col("lead_days"), 0.5)})
    counts = report.agg(
        F.count(F.lit(1)).alias("events"), F.count_if("detected").alias("detected"),
        F.avg(F.col("detected").cast("double")).alias("detection_rate"),
        F.avg("lead_days").alias("mean_lead_days"))
    return with_constants(counts, medians)
