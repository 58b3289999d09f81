"""Robust scores, ensemble, thresholds, labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigpulse.functions.columns import sure
from rigpulse.functions.quantiles import group_quantiles
from rigpulse.functions.wide_quantiles import cells, numbers, packed, packed_quantile
from rigpulse.session import materialize


def robust_stat_score(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                      populations: dict[str, Column] | None = None, floor: float = 1e-9,
                      keep: Sequence[str] | None = None) -> DataFrame:
    """Mean of the largest robust deviations of each row, a tenth of the features but at least three.

    ``populations`` maps a score name to the rows it is about: their medians and MADs are its
    reference, and other rows get null. All populations share the two quantile passes. ``keep`` are the columns of ``df``
    to return, all by default. Rows are packed once, many of a group to a row; every later pass reads these.
    """
    wanted = populations or {"anomaly_score_stat": F.lit(True)}
    width, kept = len(columns), list(df.columns if keep is None else keep)
    k = max(3, int(0.1 * width))
    group = [f"_k{i}" for i in range(len(keys))]
    members, inputs, held = ([f"_{kind}{i}" for i in range(len(of))] for kind, of in (("in", wanted), ("f", columns), ("c", kept)))
    named = [F.col(c).alias(n) for n, c in (*zip(group, keys), *zip(held, kept))]
    rows = df.select(*named, *[sure(c).alias(m) for m, c in zip(members, wanted.values())],
                     *[F.col(c).cast("double").alias(n) for n, c in zip(inputs, columns)])

    def finite(batch: pa.RecordBatch) -> np.ndarray:
        x = np.stack([batch[c].fill_null(0.0).to_numpy(zero_copy_only=False) for c in inputs], axis=1)
        return np.where(np.isfinite(x), x, 0.0)

    def among(x: np.ndarray, batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
        return [np.where(batch[m][i].values.to_numpy(zero_copy_only=False)[:, None], x, np.nan) for m in members]

    def own(batch: pa.RecordBatch, i: int) -> np.ndarray:
        return np.concatenate(among(cells(batch, i, width), batch, i), axis=1)

    def away(batch: pa.RecordBatch, i: int) -> np.ndarray:
        return np.abs(own(batch, i) - numbers(batch["_med"][i]))

    total, scores = width * len(members), list(wanted)
    chunks = packed(rows, group, finite, width, [*members, *held])
    medians = packed_quantile(chunks, group, ["_x", *members], own, total, 0.5, "_med")
    centred = chunks.join(medians, group)
    mads = packed_quantile(centred, group, ["_x", *members, "_med"], away, total, 0.5, "_mad")
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in kept), *(T.StructField(n, T.DoubleType()) for n in scores)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x, med, mad = cells(batch, i, width), numbers(batch["_med"][i]), numbers(batch["_mad"][i])
                made = [batch[c][i].values for c in held]
                for p, member in enumerate(members):
                    part = slice(p * width, (p + 1) * width)
                    ratios = np.abs(x - med[part]) / (mad[part] + floor)
                    top = np.partition(ratios, width - k, axis=1)[:, width - k:] if k < width else ratios
                    made.append(pa.array(top.mean(axis=1), mask=~batch[member][i].values.to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays(made, names=[*kept, *scores])

    return centred.join(mads, group).mapInArrow(score, schema)


def reference_stats(df: DataFrame, keys: Sequence[str], columns: Sequence[str], floor: float = 1e-9) -> DataFrame:
    """``<column>_ref_median`` and ``<column>_ref_mad`` per group."""
    medians = materialize(group_quantiles(df, keys, {f"{c}_ref_median": (F.col(c), 0.5) for c in columns}))
    apart = df.select(*keys, *columns).join(medians, list(keys))
    mads = group_quantiles(apart, keys, {
        f"{c}_ref_mad": (F.abs(F.col(c) - F.col(f"{c}_ref_median")), 0.5) for c in columns})
    return medians.join(mads, list(keys)).select(
        *keys, *[F.col(f"{c}_ref_median") for c in columns],
        *[(F.col(f"{c}_ref_mad") + floor).alias(f"{c}_ref_mad") for c in columns])


def normalized(score: str | Column, reference: str) -> Column:
    value = F.col(score) if isinstance(score, str) else score
    return (value - F.col(f"{reference}_ref_median")) / F.col(f"{reference}_ref_mad")


def ensemble_score(parts: Sequence[tuple[float, Column]]) -> Column:
    total = None
    for weight, part in parts:
        if weight:
            term = F.lit(float(weight)) * part
            total = term if total is None else total + term
    return F.lit(None).cast("double") if total is None else total


def regime_thresholds(df: DataFrame, keys: Sequence[str], score: str, prob: float, min_rows: int,
                      regime: str = "regime") -> tuple[DataFrame, DataFrame]:
    """Quantiles of the training scores: per machine and regime (null below ``min_rows`` rows), and per machine."""
    value = F.col(score)
    groups = [*keys, regime]
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= min_rows).drop("_rows")
    local = group_quantiles(df, groups, {"regime_threshold": (value, prob)}).join(sizes, groups)
    overall = group_quantiles(df, keys, {"machine_threshold": (value, prob)})
    return local, overall


def attach_thresholds(df: DataFrame, local: DataFrame, overall: DataFrame, keys: Sequence[str],
                      regime: str = "regime") -> DataFrame:
    """``threshold`` of the regime, else of the machine; ``machine_threshold`` stays beside it."""
    return (df.join(local, [*keys, regime], "left").join(overall, list(keys), "left")
            .withColumn("threshold", F.coalesce("regime_threshold", "machine_threshold")).drop("regime_threshold"))


def flag_above(score: str, threshold: str) -> Column:
    """1 above the threshold; a null score is not anomalous."""
    return sure(F.col(score) > F.col(threshold)).cast("int")


def flag_anomalies(df: DataFrame, score: str = "anomaly_score", threshold: str = "threshold",
                   name: str = "anomaly_point") -> DataFrame:
    return df.withColumn(name, flag_above(score, threshold))
