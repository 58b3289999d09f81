"""Stored bundles and live episodes against plain versions."""

import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rigpulse.config import ForestConfig
from rigpulse.operators import forest
from rigpulse.plans import bundle
from rigpulse.streaming import episodes, live

T0 = datetime(2024, 1, 1)
COLUMNS = ["a", "b", "c", "d"]
SCHEMA = "m string, t timestamp, id long, " + ", ".join(f"{c} double" for c in COLUMNS)


def readings(n=400, seed=1):
    rng = np.random.default_rng(seed)
    return [(f"m{k % 2}", T0 + timedelta(minutes=k), k, *(None if v > 2.5 else float(v) for v in rng.normal(size=4))) for k in range(n)]


def plain_scores(rows, train, floor):
    made = {}
    for m in ("m0", "m1"):
        mine = np.array([[np.nan if v is None else v for v in r[3:]] for r in train if r[0] == m])
        med = np.nanmedian(mine, axis=0)
        mad = np.nanmedian(np.abs(mine - med), axis=0) + floor
        for r in rows:
            if r[0] == m:
                away = [0.0 if v is None else abs(v - a) / b for v, a, b in zip(r[3:], med, mad)]
                made[r[2]] = sum(sorted(away)[-3:]) / 3
    return made


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bundles"))
    train = spark.createDataFrame(readings(), SCHEMA)
    assert bundle.versions(spark, folder) == []
    assert bundle.fit_bundle(train, folder, ["m"], COLUMNS, 0.9, 1e-3) == 1
    return folder


def test_stored_limits_score_later_rows(spark, stored):
    held = bundle.load_bundle(spark, stored)
    later = [*readings(60, 2), ("new", T0, 99, 1.0, 1.0, 1.0, 1.0)]
    got = bundle.score_bundle(spark.createDataFrame(later, SCHEMA), held).collect()
    expected = plain_scores(later, readings(), 1e-3)
    assert {r["id"]: r["score"] for r in got if r["m"] != "new"} == pytest.approx(expected)
    assert [(r["score"], r["limit"]) for r in got if r["m"] == "new"] == [(None, None)]
    fitted = plain_scores(readings(), readings(), 1e-3)
    for m, shift in (("m0", 0), ("m1", 1)):
        limit = np.quantile([s for k, s in fitted.items() if k % 2 == shift], 0.9)
        assert [r["limit"] for r in got if r["m"] == m] == pytest.approx([limit] * 30)


def test_versions_appear_whole(spark, stored, tmp_path):
    folder = str(tmp_path)
    one, two = spark.range(3), spark.range(5)
    assert [bundle.save_bundle(spark, folder, {"t": t}, {"n": n}) for n, t in ((1, one), (2, two))] == [1, 2]
    (tmp_path / "manifests" / "_draft-broken").write_text("{")
    assert bundle.versions(spark, folder) == [1, 2]
    assert bundle.load_bundle(spark, folder).tables["t"].count() == 5
    assert bundle.load_bundle(spark, folder, 1).settings == {"n": 1}
    with pytest.raises(ValueError):
        bundle.load_bundle(spark, folder, 7)


def test_stored_forest_scores_as_fitted(spark, tmp_path):
    train = spark.createDataFrame(readings(), SCHEMA)
    cfg = ForestConfig(trees=10)
    bundle.fit_bundle(train, str(tmp_path), ["m"], COLUMNS, 0.9, 1e-3, cfg, ["id"])
    got = bundle.score_bundle(train, bundle.load_bundle(spark, str(tmp_path)), ["id"], cfg)
    model = forest.fit_isolation_forest(train, ["m"], COLUMNS, ["id"], cfg)
    wanted = forest.score_isolation_forest(train, model, ["m"], COLUMNS, ["id"], F.lit(True), cfg)
    expected = {r["id"]: r["anomaly_score_if"] for r in wanted.collect()}
    assert {r["id"]: r["anomaly_score_if"] for r in got.collect()} == pytest.approx(expected)


def plain_live(batches, config):
    """(points by id, episodes, late ids) when the batches come one after the other."""
    points, runs, late, settled = {}, [], set(), {}
    waiting, newest, order = {}, {}, {}
    for batch in [*batches, None]:
        for r in batch or []:
            if settled.get(r[0]) is not None and r[1] <= settled[r[0]]:
                late.add(r[2])
                continue
            waiting.setdefault(r[0], []).append(r)
            newest[r[0]] = max(newest.get(r[0], T0), r[1])
        for m in waiting:
            edge = newest[m] - timedelta(seconds=config.late_seconds)
            ready = sorted((r for r in waiting[m] if batch is None or r[1] < edge), key=lambda r: r[1:3])
            waiting[m] = [r for r in waiting[m] if r not in ready]
            order.setdefault(m, []).extend(ready)
            if ready:
                settled[m] = ready[-1][1]
    for m, rows in order.items():
        run = []
        for k, r in enumerate(rows):
            recent = [x[3] for x in rows[max(0, k - config.width + 1):k + 1]]
            smooth = sum(recent) / len(recent)
            points[r[2]] = (smooth, int(smooth > 0.5))
            if smooth > 0.5:
                run.append((r[1], smooth))
            if run and (smooth <= 0.5 or k == len(rows) - 1):
                runs.append((m, run[0][0], run[-1][0], len(run), max(s for _, s in run), smooth > 0.5))
                run = []
    return points, sorted(runs), late


def test_out_of_order_and_late_readings(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"m{k % 3}", T0 + timedelta(minutes=k), k, float(rng.random() + 0.4 * (k // 40 % 2))) for k in range(300)]
    first = [rows[k] for k in rng.permutation(180) if k not in (20, 170)]
    second = [rows[k] for k in (20, 170, *range(180, 300))]  # 20 comes too late, 170 just in time
    config = episodes.LiveConfig(width=4, late_seconds=1800)
    names = "machine string, t timestamp, id long, score double"
    schema = spark.createDataFrame(rows[:1], names).schema
    for batch in (first, second):
        spark.createDataFrame(batch, names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.open_stream(spark, str(tmp_path / "in"), schema)
        tracked = episodes.track(stream.withColumn("limit", F.lit(0.5)), "machine", "t", "id", config)
        found = episodes.run_live(tracked, config, str(tmp_path / "out"))
    points, runs, late = plain_live([first, second], config)
    assert late == {20} == {r["id"] for r in found.late.collect()}
    assert {r["id"]: (pytest.approx(r["smooth"]), r["flag"]) for r in found.points.collect()} == points
    got = sorted((r["machine"], r["start_ts"], r["end_ts"], r["points"], r["peak"], r["open"]) for r in found.episodes.collect())
    assert [g[:4] + g[5:] for g in got] == [r[:4] + r[5:] for r in runs]
    assert [g[4] for g in got] == pytest.approx([r[4] for r in runs])


def test_large_batch_in_parts():
    """A batch as large as a machine's history becomes frames of bounded size, equal to taking it whole."""
    class Held:
        text = None
        exists = lambda self: self.text is not None
        get = lambda self: self.text
        update = lambda self, text: setattr(self, "text", text)

    rng = np.random.default_rng(4)
    at = rng.permutation(35_000) * 1_000_000
    score, limit = rng.normal(size=35_000).round(3), np.where(rng.random(35_000) < 0.1, np.nan, 0.4)
    rows = pd.DataFrame({"at": at, "id": np.arange(35_000), "score": score, "limit": limit})
    tracker = episodes.Tracker(episodes.LiveConfig())
    tracker.held, plain = Held(), episodes.fresh()
    for batch in (rows[:30_000], rows[30_000:]):
        made = list(tracker.handleInputRows(("m",), iter([batch[:12_000], batch[12_000:]]), None))
        assert max(len(f) for f in made) < 25_000
        wanted = episodes.receive(plain, [(a, i, s, None if np.isnan(m) else m) for a, i, s, m in zip(*(batch[c].tolist() for c in batch))],
                                  episodes.LiveConfig())
        found = pd.concat(made).query("kind != 'state'")
        for kind, fields in (("point", ["at", "id", "score", "smooth", "limit", "flag"]), ("late", ["at", "id", "score", "limit"]),
                             ("episode", ["start", "at", "points", "peak"])):
            mine = found.loc[found.kind == kind, fields].astype(float).fillna(-9).to_numpy().tolist()
            assert mine == [[-9 if r[f] is None else r[f] for f in fields] for r in wanted if r["kind"] == kind]
        state = json.loads(tracker.held.text[0])
        assert [tuple(r) for r in state.pop("waiting")] == sorted(plain["waiting"])
        assert state == {k: list(v) if isinstance(v, tuple) else v for k, v in plain.items() if k != "waiting"}
