"""Live episodes: smoothed scores and runs of anomalous readings of a stream, with state per machine.

Readings may come out of order by up to ``late``. A machine's state holds the readings that are not settled yet, the last
scores that the smoothing needs, and the open episode. What is behind the newest reading by more than ``late`` is settled in
order of (time, id); a reading that comes for a time already settled is not lost but goes to the late table. Every batch also
leaves the state of the machines it touched, so the readings and episodes that are still open when a run ends can be read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rigpulse.session import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = ["kind", "machine", "at", "id", "score", "smooth", "limit", "flag", "start", "points", "peak", "state"]
_SCHEMA = ("kind string, machine string, at long, id long, score double, smooth double, limit double, flag int, start long, "
           "points long, peak double, state string")
_READING = {"at": np.int64, "id": np.int64, "score": np.float64, "limit": np.float64}
PART_ROWS = 10_000


@dataclass(frozen=True)
class LiveConfig:
    #: Readings that the smoothing averages, the one at hand included.
    width: int = 5
    late_seconds: int = 3600


def fresh() -> dict:
    """State of a machine without readings. Times are microseconds."""
    return {"newest": None, "settled": None, "recent": [], "open": None, "waiting": []}


def settle(state: dict, upto: int | None, width: int) -> list[dict]:
    """Take the waiting readings up to a time (all without one) in order; gives points and the episodes that ended."""
    ready = sorted(r for r in state["waiting"] if upto is None or r[0] <= upto)
    state["waiting"] = [r for r in state["waiting"] if upto is not None and r[0] > upto]
    out = []
    for at, number, score, limit in ready:
        recent = [*state["recent"], score][-width:]
        state["recent"], state["settled"] = recent, at
        smooth = sum(recent) / len(recent)
        flag = int(limit is not None and smooth > limit)
        out.append({"kind": "point", "at": at, "id": number, "score": score, "smooth": smooth, "limit": limit, "flag": flag})
        held = state["open"]
        if flag:
            start, _, points, peak = held or (at, at, 0, smooth)
            state["open"] = (start, at, points + 1, max(peak, smooth))
        elif held:
            out.append(_episode("episode", held))
            state["open"] = None
    return out


def _episode(kind: str, held) -> dict:
    start, last, points, peak = held
    return {"kind": kind, "start": start, "at": last, "points": points, "peak": peak}


def receive(state: dict, rows: list[tuple], config: LiveConfig) -> list[dict]:
    """Take new readings (at, id, score, limit) in any order; gives what they settle and the late ones."""
    out = []
    for row in rows:
        if state["settled"] is not None and row[0] <= state["settled"]:
            out.append({"kind": "late", "at": row[0], "id": row[1], "score": row[2], "limit": row[3]})
            continue
        state["waiting"].append(row)
        state["newest"] = row[0] if state["newest"] is None else max(state["newest"], row[0])
    if state["newest"] is not None:
        out += settle(state, state["newest"] - config.late_seconds * 1_000_000 - 1, config.width)
    return out


def receive_parts(state: dict, parts: Iterator[pd.DataFrame], config: LiveConfig) -> Iterator[list[dict]]:
    """As ``receive`` for a batch of any size: its readings stay in flat arrays, and ``PART_ROWS`` of them at a time become
    rows. Late readings come first."""
    taken = [_columns(state["waiting"])]
    for part in parts:
        new = [part[c].to_numpy(t, na_value=np.nan) if t is np.float64 else part[c].to_numpy(t) for c, t in _READING.items()]
        late = new[0] <= state["settled"] if state["settled"] is not None else np.zeros(len(part), bool)
        if late.any():
            yield [{"kind": "late", "at": r[0], "id": r[1], "score": r[2], "limit": r[3]} for r in _rows([c[late] for c in new])]
        taken.append([c[~late] for c in new])
    held = [np.concatenate(c) for c in zip(*taken)]
    taken.clear()
    if not len(held[0]):
        return
    newest = int(held[0].max())
    state["newest"] = newest if state["newest"] is None else max(state["newest"], newest)
    order = np.lexsort(held[2::-1])
    ready = int((held[0] <= state["newest"] - config.late_seconds * 1_000_000 - 1).sum())
    for start in range(0, ready, PART_ROWS):
        some = order[start:min(start + PART_ROWS, ready)]
        state["waiting"] = _rows([c[some] for c in held])
        yield settle(state, None, config.width)
    state["waiting"] = _rows([c[order[ready:]] for c in held])


def _columns(rows: list[tuple]) -> list[np.ndarray]:
    values = list(zip(*rows)) or [()] * len(_READING)
    return [np.array([np.nan if x is None else x for x in v], t) for v, t in zip(values, _READING.values())]


def _rows(columns: list[np.ndarray]) -> list[tuple]:
    return [(a, i, s, None if m != m else m) for a, i, s, m in zip(*[c.tolist() for c in columns])]


def _frame(machine: str, rows: list[dict]) -> pd.DataFrame:
    columns = {c: [r.get(c) for r in rows] for c in _FIELDS}
    columns["machine"] = [machine] * len(rows)
    kinds = {"at": "Int64", "id": "Int64", "start": "Int64", "points": "Int64", "flag": "Int32"}
    doubles = {c: "float64" for c in ("score", "smooth", "limit", "peak")}
    return pd.DataFrame(columns).astype(kinds | doubles)


class Tracker(StatefulProcessor):
    """State of a machine in the state store, as text of its parts."""

    def __init__(self, config: LiveConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("machine", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.held.get() if self.held.exists() else None
        state = json.loads(known[0]) if known else fresh()
        state["waiting"] = [tuple(r) for r in state["waiting"]]
        for out in receive_parts(state, rows, self.config):
            yield _frame(str(key[0]), out)
        text = json.dumps(state)
        self.held.update((text,))
        yield _frame(str(key[0]), [{"kind": "state", "state": text}])

    def close(self) -> None:
        pass


def track(scored: DataFrame, machine: str, at: str, number: str, config: LiveConfig = LiveConfig()) -> DataFrame:
    """Points, episodes, late readings and states of a stream of scored readings; readings without a score are left out."""
    scored.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = scored.where(F.col("score").isNotNull() & F.col(at).isNotNull()).select(
        F.col(machine).cast("string").alias("machine"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"),
        F.col(number).cast("long").alias("id"), "score", F.col("limit").cast("double").alias("limit"))
    return rows.groupBy("machine").transformWithStateInPandas(Tracker(config), _SCHEMA, "Append", "None")


@dataclass(frozen=True)
class LiveResult:
    points: DataFrame
    episodes: DataFrame
    late: DataFrame


def run_live(tracked: DataFrame, config: LiveConfig = LiveConfig(), path: str | None = None) -> LiveResult:
    """Run over all that is there now and read points, episodes (``open`` where the last reading is in it) and late readings.

    A batch writes under its own number, so a repeated one replaces itself; with the same ``path`` a later run goes on where
    this one ended. Readings that wait are settled in what is read, not in the state.
    """
    spark = tracked.sparkSession
    base = path or f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{base}/data/batch={number}")

    query = (tracked.writeStream.foreachBatch(keep).outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", f"{base}/checkpoint").start())
    query.awaitTermination()
    made = spark.read.schema(f"{_SCHEMA}, batch long").option("basePath", f"{base}/data").parquet(f"{base}/data")
    width = config.width

    def finish(key, table: pd.DataFrame) -> pd.DataFrame:
        state = json.loads(table["state"].iloc[0])
        state["waiting"] = [tuple(r) for r in state["waiting"]]
        out = settle(state, None, width)
        if state["open"]:
            out.append(_episode("open", state["open"]))
        return _frame(key[0], out)

    states = made.where("kind = 'state'").groupBy("machine").agg(F.max_by("state", "batch").alias("state"))
    rest = states.groupBy("machine").applyInPandas(finish, _SCHEMA)
    done = made.drop("batch").where("kind <> 'state'").select(*_FIELDS).unionByName(rest.select(*_FIELDS))
    time = lambda c: F.timestamp_micros(c).alias
    return LiveResult(
        done.where("kind = 'point'").select("machine", "id", time("at")("timestamp"), "score", "smooth", "limit", "flag"),
        done.where("kind IN ('episode', 'open')").select("machine", time("start")("start_ts"), time("at")("end_ts"), "points",
                                                         "peak", (F.col("kind") == "open").alias("open")),
        done.where("kind = 'late'").select("machine", "id", time("at")("timestamp"), "score"))
