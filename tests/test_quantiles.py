"""Exact quantiles: many groups, ties, nulls, small samples, refinement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigpulse.functions import wide_quantiles
from rigpulse.functions.quantiles import group_quantiles
from rigpulse.functions.wide_quantiles import wide_quantile
from rigpulse.operators.stats import mad_stats, mode_min


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(6000):
        group = "hot" if i % 3 else f"g{i % 7}"
        tied = float(rng.integers(0, 3))
        rows.append((group, float(rng.normal()), tied, None if i % 5 else float(rng.exponential()), 1.0))
    return spark.createDataFrame(rows, "g string, a double, b double, c double, d double").cache()


def expected(values, prob):
    frame = values.toPandas()
    return {g: part[["a", "b", "c", "d"]].quantile(prob).tolist() for g, part in frame.groupby("g")}


@pytest.mark.parametrize("prob", [0.0, 0.1, 0.5, 0.995, 1.0])
def test_group_quantiles(values, prob):
    got = group_quantiles(values, ["g"], {c: (F.col(c), prob) for c in "abcd"})
    want = expected(values, prob)
    rows = got.collect()
    assert {r["g"] for r in rows} == set(want)
    for r in rows:
        assert [r[c] for c in "abcd"] == pytest.approx(want[r["g"]])


def test_whole_table(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "x double")
    assert group_quantiles(df, [], {"q": (F.col("x"), 0.995)}).first()["q"] == pytest.approx(9.92)


@pytest.mark.parametrize("cells, refine", [(8_000_000, 10**9), (4000, 10**9), (4000, 100)])
@pytest.mark.parametrize("prob", [0.25, 0.5, 0.99])
def test_wide_quantile(values, monkeypatch, cells, refine, prob):
    monkeypatch.setattr(wide_quantiles, "SAMPLE_CELLS", cells)
    monkeypatch.setattr(wide_quantiles, "REFINE_ABOVE", refine)
    got = wide_quantile(values, ["g"], F.array("a", "b", "c", "d"), 4, prob).collect()
    want = expected(values, prob)
    assert {r["g"] for r in got} == set(want)
    for r in got:
        assert r["q"] == pytest.approx(want[r["g"]])


def test_constant_column_has_the_floor_as_mad(values):
    row = mad_stats(values, ["g"], ["d"], scaled=True).where("g = 'hot'").first()
    assert row["d_median"] == 1.0 and row["d_mad"] == 1e-9


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("a",), (None,)], "x string")
    assert mode_min(df, [], "x").first()["x"] == "a"


def test_robust_scores_read_their_rows_once(spark):
    """Passes read packed rows: what makes the rows is not run again, and no row carries the medians of its group."""
    from rigpulse.operators.scoring import robust_stat_score

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 4)).round(3)
    x[::50, 2] = np.nan
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", *map(float, v)) for i, v in enumerate(x)], "i long, g string, a double, b double, c double, d double")
    made = robust_stat_score(rows.withColumn("a", counted("a")), ["g"], list("abcd"),
                             {"whole": F.lit(True), "even": F.col("i") % 2 == 0}, 1e-3, ["i", "g"])
    assert made.columns == ["i", "g", "whole", "even"]
    got = {r["i"]: (r["whole"], r["even"]) for r in made.collect()}
    assert seen.value == 500 and len(got) == 500
    x = np.nan_to_num(x)
    number = np.arange(500)
    for group in (number % 3 > 0, number % 3 == 0):
        for place, member in enumerate((group, group & (number % 2 == 0))):
            middle = np.median(x[member], axis=0)
            spread = np.median(np.abs(x[member] - middle), axis=0) + 1e-3
            top = np.sort(np.abs(x - middle) / spread, axis=1)[:, -3:].mean(axis=1)
            for i in number[group]:
                assert got[i][place] == (pytest.approx(top[i]) if member[i] else None)
