"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here a mergeable sketch first
brackets the wanted rank, then only the values inside the bracket are counted and shuffled, and
the rank is looked up among them. The result is exact: ranks are checked against true counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
_MARGINS = [3 / SKETCH_ACCURACY * 2**j for j in range(13)]
_BELOW = float("-inf")


def quantile_array(df: DataFrame, keys: Sequence[str], values: Column, width: int, probs: Sequence[float],
                   name: str = "q") -> DataFrame:
    """``keys`` and an array of quantiles (linear interpolation, nulls ignored) of an array of ``width`` values.

    Entry ``i * len(probs) + p`` belongs to value ``i`` and probability ``p``; null without values.
    """
    per = len(probs)
    source = df.select(*keys, values.cast("array<double>").alias("_x"))
    brackets = _brackets(source, keys, width, probs)
    placed = _attach(source, brackets, keys)

    def inside(v: Column, i: Column, p: int) -> Column:
        slot = i * per + p
        kept = F.when(v < F.get("_lo", slot), F.lit(_BELOW)).otherwise(v)
        return F.when(v <= F.get("_hi", slot), F.struct(slot.alias("_slot"), kept.alias("_v"), F.get("_n", i).alias("_cnt")))

    def hits_of(p: int) -> Column:
        return F.transform("_x", lambda v, i: inside(v, i, p))

    hits = [hits_of(p) for p in range(per)]
    counted = (
        placed.select(*keys, F.inline(F.array_compact(F.concat(*hits) if per > 1 else hits[0])))
        .groupBy(*keys, "_slot", "_cnt", "_v").agg(F.count(F.lit(1)).alias("_m"))
    )
    ranked = counted.withColumn("_up_to", F.sum("_m").over(Window.partitionBy(*keys, "_slot", "_cnt").orderBy("_v")))
    prob = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("_slot") % per)
    picks = (
        ranked.withColumn("_place", prob * (F.col("_cnt") - 1))
        .groupBy(*keys, "_slot", "_cnt", "_place")
        .agg(
            F.min(F.when(F.col("_up_to") > F.floor("_place"), F.col("_v"))).alias("_a"),
            F.min(F.when(F.col("_up_to") > F.ceil("_place"), F.col("_v"))).alias("_b"),
        )
    )
    missed = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") == _BELOW)
    value = F.when(missed, F.raise_error(F.lit("quantile rank lies outside its bracket"))).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - F.floor("_place"))
    )
    return _by_slot(picks.select(*keys, "_slot", value.alias("_v")), keys, width * per, {name: "_v"})


def _brackets(source: DataFrame, keys: Sequence[str], width: int, probs: Sequence[float]) -> DataFrame:
    """Per group the count of each value and, for each probability, values around the wanted rank.

    The margin around the rank is the sketch error, or three ranks in small groups.
    """
    step, per = len(_MARGINS), len(probs)
    marks = [max(0.0, p - m) for p in probs for m in _MARGINS] + [min(1.0, p + m) for p in probs for m in _MARGINS]
    long = source.select(*keys, F.posexplode("_x").alias("_slot", "_v")).where(F.col("_v").isNotNull())
    sketch = long.groupBy(*keys, "_slot").agg(
        F.percentile_approx("_v", marks, SKETCH_ACCURACY).alias("_s"), F.count(F.lit(1)).alias("_cnt"))
    margin = F.ceil(F.log2(F.lit(3.0) / (F.lit(_MARGINS[0]) * F.col("_cnt"))))
    margin = F.greatest(F.lit(0), F.least(F.lit(step - 1), margin)).cast("int")
    edges = sketch.withColumn("_margin", margin)
    lows = F.array(*[F.get("_s", F.col("_margin") + p * step) for p in range(per)])
    highs = F.array(*[F.get("_s", F.col("_margin") + (per + p) * step) for p in range(per)])
    dense = _by_slot(edges.select(*keys, "_slot", "_cnt", lows.alias("_elo"), highs.alias("_ehi")), keys, width,
                     {"_n": "_cnt", "_lo": "_elo", "_hi": "_ehi"})
    if per == 1:
        flat = {c: F.transform(c, lambda a: F.get(a, F.lit(0))) for c in ("_lo", "_hi")}
    else:
        blank = F.array_repeat(F.lit(None).cast("double"), per)
        flat = {c: F.flatten(F.transform(c, lambda a: F.coalesce(a, blank))) for c in ("_lo", "_hi")}
    return dense.withColumns(flat)


def _by_slot(long: DataFrame, keys: Sequence[str], slots: int, names: dict[str, str]) -> DataFrame:
    """One row per group with dense arrays indexed by slot."""
    maps = [F.map_from_entries(F.collect_list(F.struct("_slot", c))).alias(name) for name, c in names.items()]

    def dense_of(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.try_element_at(name, s)).alias(name)

    dense = [dense_of(name) for name in names]
    return long.groupBy(*keys).agg(*maps).select(*keys, *dense)


def _attach(source: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return source.join(brackets, list(keys))
    packed = brackets.select(F.struct("_lo", "_hi", "_n").alias("_b")).scalar()
    return source.select("*", packed.alias("_b")).select("_x", "_b.*")


def group_quantiles(df: DataFrame, keys: Sequence[str], names: dict[str, tuple[Column, float]]) -> DataFrame:
    """``keys`` and one named column per (value, probability); groups without any value have no row."""
    per_prob: dict[float, list[str]] = {}
    for name, (_, prob) in names.items():
        per_prob.setdefault(prob, []).append(name)
    if len(per_prob) == 1:
        prob = next(iter(per_prob))
        arrays = quantile_array(df, keys, F.array(*[c.cast("double") for c, _ in names.values()]), len(names), [prob], "_q")
        return arrays.select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    columns: list[Column] = []
    for column, _ in names.values():
        if not any(column is c for c in columns):
            columns.append(column)
    probs = sorted(per_prob)
    arrays = quantile_array(df, keys, F.array(*[c.cast("double") for c in columns]), len(columns), probs, "_q")
    picked = []
    for name, (column, prob) in names.items():
        i = next(j for j, c in enumerate(columns) if c is column)
        picked.append(F.get("_q", F.lit(i * len(probs) + probs.index(prob))).alias(name))
    return arrays.select(*keys, *picked)
