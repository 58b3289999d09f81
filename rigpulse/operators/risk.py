"""Failure risk model and its explanation, on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigpulse.config import RiskConfig
from rigpulse.schemas import DOMAIN_HINTS
from rigpulse.session import materialize


def with_vector(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="error").transform(df)


def balanced_weights(df: DataFrame, target: str = "target", name: str = "weight") -> DataFrame:
    """``rows / (2 * rows of the class)``."""
    counts = {r[target]: r["n"] for r in df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.when(F.col(target) == 1, total / (2 * counts.get(1, total))).otherwise(
        total / (2 * counts.get(0, total)))
    return df.withColumn(name, weight)


def train_risk_model(df: DataFrame, columns: Sequence[str], cfg: RiskConfig = RiskConfig(),
                     target: str = "target") -> Model:
    """Boosted trees with balanced class weights."""
    data = balanced_weights(with_vector(df, columns), target).select("features", "weight", F.col(target).cast("double"))
    gbt = GBTClassifier(featuresCol="features", labelCol=target, weightCol="weight", maxIter=cfg.rounds,
                        stepSize=cfg.rate, maxDepth=cfg.depth, seed=cfg.seed, cacheNodeIds=True, checkpointInterval=10)
    return gbt.fit(data)


def predict_risk(model: Model, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    scored = model.transform(with_vector(df, columns))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("proba"))


def alert_contributions(model: Model, alerts: DataFrame, columns: Sequence[str], typical: Mapping[str, float],
                        keys: Sequence[str]) -> DataFrame:
    """How much each feature moves the log-odds of an alert away from what its typical value would give."""
    usual = F.array(*[F.lit(float(typical[c])) for c in columns])
    rows = alerts.select(*keys, F.array(*[F.col(c).cast("double") for c in columns]).alias("_values"))
    base = _log_odds(model, rows, "_values", "_base")
    replaced = base.select("*", F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("position", "feature"))
    replaced = replaced.withColumn("_other", F.transform(
        "_values", lambda v, i: F.when(i == F.col("position"), F.get(usual, i)).otherwise(v)))
    return _log_odds(model, replaced, "_other", "_without").select(
        *keys, "position", "feature", F.get("_values", F.col("position")).alias("value"),
        (F.col("_base") - F.col("_without")).alias("contribution"))


def _log_odds(model: Model, df: DataFrame, values: str, name: str) -> DataFrame:
    scored = model.transform(df.withColumn("features", array_to_vector(values)))
    return scored.select(*df.columns, (vector_to_array("rawPrediction")[1] * 2).alias(name))


def top_factors(contributions: DataFrame, keys: Sequence[str], n: int = 6) -> DataFrame:
    """The strongest factors of each alert, in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs("contribution").desc(), "position"))
    top = contributions.withColumn("rank", rank).where(F.col("rank") <= n)
    pick = F.sort_array(F.collect_list(F.struct("rank", "feature", "contribution")))
    return top.groupBy(*keys).agg(pick.alias("_top")).select(
        *keys, F.transform("_top", lambda t: t["feature"]).alias("factors"),
        F.transform("_top", lambda t: F.when(t["contribution"] > 0, "raises").otherwise("lowers")).alias("directions"))


def domain_hints(factors: DataFrame, column: str = "factors") -> DataFrame:
    """Sentences for the kinds of feature among the factors."""
    def hint(part: str, text: str) -> Column:
        return F.when(F.exists(column, lambda f: f.contains(part)), text)

    hints = [hint(part, text) for part, text in DOMAIN_HINTS.items()]
    return factors.withColumn("hints", F.concat_ws("; ", *hints))


def alert_text(factors: DataFrame) -> DataFrame:
    parts = F.zip_with("factors", "directions", lambda f, d: F.concat(f, F.lit(" ("), d, F.lit(")")))
    start = F.concat(F.lit("Main factors: "), F.array_join(parts, ", "))
    more = F.when(F.col("hints") != "", F.concat(F.lit("\nPossible reasons: "), "hints", F.lit(".")))
    return factors.withColumn("text", F.concat(start, F.coalesce(more, F.lit(""))))


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution of each feature."""
    return contributions.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("importance"), F.count(F.lit(1)).alias("n_alerts"))


def background_centroids(df: DataFrame, columns: Sequence[str], k: int = 100, seed: int = 42) -> DataFrame:
    """K-means summary of the data, one row per centre. The fit reads its rows several times, so they are written once."""
    rows = materialize(df.select(*columns))
    model = KMeans(k=k, seed=seed, featuresCol="features").fit(with_vector(rows, columns))
    rows = [(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())]
    fields = ", ".join(["cluster int", *[f"`{c}` double" for c in columns]])
    return df.sparkSession.createDataFrame(rows, fields)


def cluster_regimes(df: DataFrame, columns: Sequence[str], k: int = 6, seed: int = 42) -> DataFrame:
    """Operating regime of each row by K-means over the sensors; the rows are written once, as above."""
    data = with_vector(materialize(df), columns)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="regime_cluster").fit(data)
    return model.transform(data).drop("features")
