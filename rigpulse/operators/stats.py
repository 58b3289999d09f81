"""Profiles, robust statistics, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigpulse.functions.columns import sure
from rigpulse.functions.quantiles import group_quantiles, quantile_array
from rigpulse.session import materialize

MAD_TO_SIGMA = 1.4826
FLOOR = 1e-9


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as a scalar subquery."""
    names = one_row.columns
    packed = one_row.select(F.struct(*names).alias("_c")).scalar()
    return df.withColumn("_c", packed).select(*df.columns, *[F.col(f"_c.{c}").alias(c) for c in names])


def attach_group(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics of its group beside each row; no keys means one group."""
    return df.join(stats, list(keys), "left") if keys else with_constants(df, stats)


def mode_min(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Most frequent value, the smallest of several; nulls ignored. Values are counted before groups meet."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(column))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def null_profile_row(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def _per_column(one_row: DataFrame, columns: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One row of ``<column>__<field>`` values to one row per column."""
    structs = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{f}").alias(out) for f, out in fields.items()])
               for c in columns]
    return one_row.select(F.inline(F.array(*structs)))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in columns])
    return _per_column(counts, columns, {"nulls": "nulls"})


def distinct_profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values and their share of the rows, per column.

    The exact form counts pairs (column, value), so no task holds the values of one column.
    """
    if approximate:
        one = df.agg(*[F.approx_count_distinct(c).alias(f"{c}__distinct") for c in columns],
                     *[F.count(F.lit(1)).alias(f"{c}__rows") for c in columns])
        table = _per_column(one, columns, {"distinct": "distinct", "rows": "rows"})
    else:
        pairs = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
        table = (pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
                 .groupBy("column").agg(F.count("value").alias("distinct"), F.sum("n").alias("rows")))
    return table.withColumn("ratio", F.col("distinct") / F.col("rows"))


def describe(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column: count, mean, std, min, percentiles, max."""
    fields = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[fn(F.col(c).cast("double") if f != "count" else F.col(c)).alias(f"{c}__{f}")
                   for c in columns for f, fn in fields.items()])
    values = F.array(*[F.col(c).cast("double") for c in columns])
    quantiles = quantile_array(df, [], values, len(columns), probs, "_q")
    one = with_constants(one, quantiles)
    names = {f: f for f in fields}
    marks = []
    for i, c in enumerate(columns):
        for j, p in enumerate(probs):
            marks.append(F.get("_q", F.lit(i * len(probs) + j)).alias(f"{c}__p{percent(p)}"))
    names |= {f"p{percent(p)}": f"p{percent(p)}" for p in probs}
    return _per_column(one.select("*", *marks), columns, names)


def percent(prob: float) -> str:
    return f"{prob * 100:g}".replace(".", "_")


def mad_stats(df: DataFrame, keys: Sequence[str], columns: Sequence[str], scaled: bool = False,
              floor: float = FLOOR) -> DataFrame:
    """``<column>_median`` and ``<column>_mad`` per group.

    Plain: MAD plus ``floor``. Scaled: 1.4826 * MAD, at least ``floor``. The medians, needed twice
    by the second pass, are written out.
    """
    medians = materialize(group_quantiles(df, keys, {f"{c}_median": (F.col(c), 0.5) for c in columns}))
    apart = attach_group(df.select(*keys, *columns), medians, keys)
    mads = group_quantiles(apart, keys, {f"{c}_mad": (F.abs(F.col(c) - F.col(f"{c}_median")), 0.5) for c in columns})
    joined = attach_group(medians, mads, keys)

    def spread(c: str) -> Column:
        return (F.greatest(F.col(f"{c}_mad") * MAD_TO_SIGMA, F.lit(floor)) if scaled
                else F.col(f"{c}_mad") + floor).alias(f"{c}_mad")

    return joined.select(*keys, *[x for c in columns for x in (F.col(f"{c}_median"), spread(c))])


def quantile_threshold(df: DataFrame, keys: Sequence[str], column: str, prob: float,
                       name: str = "threshold") -> DataFrame:
    return group_quantiles(df, keys, {name: (F.col(column), prob)})


def iqr_outliers(df: DataFrame, column: str, by: Sequence[str] = (), width: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences."""
    c = F.col(column)
    fences = group_quantiles(df, by, {"q1": (c, 0.25), "q3": (c, 0.75)})
    spread = F.col("q3") - F.col("q1")
    outside = (c < F.col("q1") - width * spread) | (c > F.col("q3") + width * spread)
    return attach_group(df, fences, by).where(sure(outside)).select(*df.columns)


def zscore_outliers(df: DataFrame, column: str, by: Sequence[str] = (), limit: float = 3.0) -> DataFrame:
    """Rows beyond ``limit`` population standard deviations, with the z-score."""
    stats = df.groupBy(*by).agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_std"))
    z = F.try_divide(F.col(column) - F.col("_mean"), F.col("_std"))
    return (attach_group(df, stats, by).withColumn(f"{column}_zscore", z)
            .where(sure(F.abs(F.col(f"{column}_zscore")) > limit)).select(*df.columns, f"{column}_zscore"))


def standardize(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean 0 and population standard deviation 1; a constant column becomes 0.

    All scalings read the rows for the statistics and again to rescale them, so they are written once.
    """
    df = materialize(df)
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns])
    return _rescaled(df, stats, columns, by, "m", "s")


def min_max_scale(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Smallest value to 0, largest to 1; a constant column becomes 0."""
    df = materialize(df)
    stats = df.groupBy(*by).agg(
        *[F.min(c).alias(f"{c}_m") for c in columns], *[(F.max(c) - F.min(c)).alias(f"{c}_s") for c in columns])
    return _rescaled(df, stats, columns, by, "m", "s")


def robust_scale(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median to 0, interquartile range to 1; a range of 0 divides by 1."""
    df = materialize(df)
    names = {}
    for c in columns:
        source = F.col(c)
        names |= {f"{c}_m": (source, 0.5), f"{c}_lo": (source, 0.25), f"{c}_hi": (source, 0.75)}
    stats = group_quantiles(df, by, names)
    stats = stats.select(*by, *[F.col(f"{c}_m") for c in columns],
                         *[(F.col(f"{c}_hi") - F.col(f"{c}_lo")).alias(f"{c}_s") for c in columns])
    return _rescaled(df, stats, columns, by, "m", "s")


def _rescaled(df: DataFrame, stats: DataFrame, columns: Sequence[str], by: Sequence[str], m: str, s: str) -> DataFrame:
    joined = attach_group(df, stats, by)
    new = {c: (F.col(c) - F.col(f"{c}_{m}")) / F.when(F.col(f"{c}_{s}") == 0, 1.0).otherwise(F.col(f"{c}_{s}"))
           for c in columns}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def robust_normalize(df: DataFrame, keys: Sequence[str], column: str, reference: Column, name: str,
                     floor: float = FLOOR) -> DataFrame:
    """``(x - median) / (MAD + floor)``, both statistics taken over ``reference`` (null where not part of it)."""
    stats = mad_stats(df.select(*keys, reference.alias("_ref")), keys, ["_ref"], floor=floor)
    return (attach_group(df, stats, keys)
            .withColumn(name, (F.col(column) - F.col("_ref_median")) / F.col("_ref_mad"))
            .drop("_ref_median", "_ref_mad"))


def correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Correlation of every column with the target."""
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"{c}__corr") for c in columns])
    return _per_column(one, columns, {"corr": "corr"})


def select_by_correlation(df: DataFrame, columns: Sequence[str], target: str, least: float) -> list[str]:
    """Columns whose absolute correlation with the target reaches ``least``."""
    rows = correlations(df, columns, target).where(F.abs("corr") >= least).collect()
    strong = {r["column"] for r in rows}
    return [c for c in columns if c in strong]
