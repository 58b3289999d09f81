"""Exact quantile of many values per row, for groups of any size.

Rows are packed: a row of the packed table holds the numbers of many rows of one group as bytes, so that what a pass needs
beside them (bounds, medians) comes once for all of these. A bounded random sample of each group brackets the wanted rank
of each value. One pass over all rows then counts what lies below and on the bracket and keeps only what lies strictly
inside. Ranks come from these exact counts, so the sample decides the cost, not the result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigpulse.functions.chance import uniform
from rigpulse.session import materialize

PACK_CELLS = 1 << 18
SAMPLE_CELLS = 8_000_000
MAX_SAMPLE = 100_000
REFINE_ABOVE = 50_000_000
#: Values of a group whose insides of the bracket meet in one task, and groups whose histograms a task holds.
_SLOTS, _HELD = 8, 64
_SIGMAS, _BINS = 7.0, 256
_LOW, _HIGH = float("-inf"), float("inf")
_COUNTS = "_g long, slot int, v double, m long"
#: The numbers, rows x values (nan: none), of a row of a packed table: a batch and the place in it.
View = Callable[[pa.RecordBatch, int], np.ndarray]


def wide_quantile(df: DataFrame, keys: Sequence[str], values: Column, width: int, prob: float,
                  name: str = "q") -> DataFrame:
    """``keys`` and an array with the quantile of each of the ``width`` values; null without values."""
    source = df.select(*keys, values.cast("array<double>").alias("_x"))
    rows = packed(source, keys, lambda batch: numbers(batch["_x"]).reshape(-1, width), width)
    return packed_quantile(rows, keys, ["_x"], lambda batch, i: cells(batch, i, width), width, prob, name)


def numbers(values: pa.ListArray | pa.ListScalar) -> np.ndarray:
    """The numbers of lists, one after the other; nan for null."""
    flat = values.flatten() if isinstance(values, pa.Array) else values.values
    return flat.to_numpy(zero_copy_only=False).astype(float, copy=False)


def cells(batch: pa.RecordBatch, i: int, width: int) -> np.ndarray:
    return np.frombuffer(batch["_x"][i].as_py(), np.float64).reshape(-1, width)


def packed(df: DataFrame, keys: Sequence[str], made: Callable[[pa.RecordBatch], np.ndarray], width: int,
           kept: Sequence[str] = ()) -> DataFrame:
    """``keys``, the number ``_n`` of rows, their numbers ``_x`` as bytes, and arrays of the ``kept`` columns. Written out.

    ``made`` gives the numbers of a batch, rows x ``width``.
    """
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("_n", T.LongType()), T.StructField("_x", T.BinaryType()),
                           *(T.StructField(c, T.ArrayType(df.schema[c].dataType)) for c in kept)])
    most = max(1, PACK_CELLS // width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            places = pa.table({k: batch[k] for k in keys} | {"_at": np.arange(len(batch))})
            groups = places.group_by(list(keys), use_threads=False).aggregate([("_at", "list")])
            members = [at.values.to_numpy() for at in groups["_at_list"]]
            parts = [(k, at[first:first + most]) for k, at in enumerate(members) for first in range(0, len(at), most)]
            x, order = made(batch), np.concatenate([at for _, at in parts])
            sizes = [len(at) for _, at in parts]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            owners = groups.select(list(keys)).take(pa.array([k for k, _ in parts])).combine_chunks()
            yield from pa.table(
                [*owners.columns, pa.array(sizes, pa.int64()), pa.array([np.ascontiguousarray(x[at]).tobytes() for _, at in parts], pa.binary()),
                 *(pa.ListArray.from_arrays(ends, batch[c].take(pa.array(order))) for c in kept)], [*keys, "_n", "_x", *kept]).to_batches()

    return materialize(df.mapInArrow(pack, schema))


def packed_quantile(rows: DataFrame, keys: Sequence[str], read: Sequence[str], view: View, width: int, prob: float,
                    name: str = "q") -> DataFrame:
    """As ``wide_quantile``, of the numbers that ``view`` sees in the columns ``read`` of packed rows.

    The result, one row per group, is written out: it is joined back more than once.
    """
    source = rows.select(*keys, "_n", *read)
    sample = max(1000, min(MAX_SAMPLE, SAMPLE_CELLS // width))
    brackets = materialize(_sampled_brackets(source, keys, view, width, prob, sample))
    largest = brackets.agg(F.max("_size")).first()[0]
    if largest and largest > REFINE_ABOVE:
        brackets = materialize(_refined(source, brackets, keys, view, width, prob))
    picks = _picked(_counted(source.join(brackets, list(keys)), view, width), prob)
    arrays = picks.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("part", "q"))).alias("_parts"))
    dense = F.flatten(F.transform("_parts", lambda p: p["q"]))
    return materialize(brackets.select(*keys, "_g").join(arrays, "_g").select(*keys, dense.alias(name)))


def _sampled_brackets(source: DataFrame, keys: Sequence[str], view: View, width: int, prob: float, rows: int) -> DataFrame:
    """Per group an id, its size and bounds of the wanted rank of each value."""
    sizes = materialize(source.groupBy(*keys).agg(F.sum("_n").alias("_size")))
    own = [source.schema[k] for k in keys]
    size = T.StructField("_size", T.LongType())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x, known = view(batch, i), batch["_size"][i].as_py()
                x = np.ascontiguousarray(x[uniform(7, zlib.crc32(x.tobytes()), np.arange(len(x))) * known < rows])
                yield pa.RecordBatch.from_arrays([*(batch[k].slice(i, 1) for k in keys), pa.array([known], pa.int64()),
                                                  pa.array([x.tobytes()], pa.binary())], names=[*keys, "_size", "_x"])

    def bracket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = np.sort(np.frombuffer(b"".join(table["_x"].to_pylist()), np.float64).reshape(-1, width), axis=0)
        size = table["_size"][0].as_py()
        low, high = np.full(width, _HIGH), np.full(width, _LOW)
        for i, known in enumerate(len(x) - np.isnan(x).sum(axis=0)):
            low[i], high[i] = _bounds(x[:known, i], prob, whole=size <= rows)
        columns = {k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key)}
        return pa.table({**columns, "_size": [size], "_lo": [low.tolist()], "_hi": [high.tolist()]})

    ends = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_lo", "_hi")]
    chosen = source.join(sizes, list(keys)).mapInArrow(choose, T.StructType([*own, size, T.StructField("_x", T.BinaryType())]))
    return chosen.groupBy(*keys).applyInArrow(bracket, T.StructType([*own, size, *ends])).withColumn("_g", F.monotonically_increasing_id())


def _bounds(known: np.ndarray, prob: float, whole: bool) -> tuple[float, float]:
    if not len(known):
        return (_HIGH, _LOW) if whole else (_LOW, _HIGH)
    place = prob * (len(known) - 1)
    if whole:
        return float(known[math.floor(place)]), float(known[math.ceil(place)])
    spread = _SIGMAS * math.sqrt(prob * (1 - prob) * len(known)) + 2
    first, last = math.floor(place - spread), math.ceil(place + spread)
    return (float(known[first]) if first >= 0 else _LOW), (float(known[last]) if last < len(known) else _HIGH)


def _counted(bracketed: DataFrame, view: View, width: int) -> DataFrame:
    """For each packed row and part of its values: numbers below the bracket, on its ends and known, and those inside."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x, low, high = view(batch, i), numbers(batch["_lo"][i]), numbers(batch["_hi"][i])
                inside = (x > low) & (x < high)
                counts = np.stack([(x < low).sum(axis=0), (x == low).sum(axis=0), ((x == high) & (low != high)).sum(axis=0),
                                   (~np.isnan(x)).sum(axis=0), inside.sum(axis=0)])
                found, ends = x.T[inside.T], np.concatenate([[0], np.cumsum(counts[4])])
                starts = range(0, width, _SLOTS)
                cut = [slice(a, min(width, a + _SLOTS)) for a in starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch["_g"][i].as_py()] * len(cut), pa.int64()), pa.array([a // _SLOTS for a in starts], pa.int32()),
                     pa.array([low[c] for c in cut]), pa.array([high[c] for c in cut]), pa.array([counts[:, c].reshape(-1) for c in cut]),
                     pa.array([found[ends[c.start]:ends[c.stop]].tobytes() for c in cut], pa.binary())],
                    names=["_g", "part", "lo", "hi", "counts", "found"])

    return bracketed.mapInArrow(count, "_g long, part int, lo array<double>, hi array<double>, counts array<long>, found binary")


def _picked(counted: DataFrame, prob: float) -> DataFrame:
    """The quantiles of each part of a group's values."""
    def pick(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high = (numbers(table[c][0]) for c in ("lo", "hi"))
        counts = np.stack([c.values.to_numpy() for c in table["counts"]]).reshape(len(table), 5, len(low))
        runs: list[list[np.ndarray]] = [[] for _ in low]
        for lengths, found in zip(counts[:, 4], table["found"]):
            for slot, run in zip(runs, np.split(np.frombuffer(found.as_py(), np.float64), np.cumsum(lengths)[:-1])):
                slot.append(run)
        made = []
        for slot, (below, on_low, on_high, known, _) in enumerate(counts.sum(axis=0).T):
            place = prob * (known - 1)
            wanted = [math.floor(place), math.ceil(place)]
            inside = np.concatenate(runs[slot])
            at = [k - below - on_low for k in wanted]
            if known and any(k < below or a >= len(inside) + on_high for k, a in zip(wanted, at)):
                raise ValueError("quantile rank lies outside its bracket")
            within = [a for a in at if 0 <= a < len(inside)]
            inside = np.partition(inside, within) if within else inside
            a, b = (low[slot] if a < 0 else inside[a] if a < len(inside) else high[slot] for a in at) if known else (0.0, 0.0)
            made.append(float(a + (b - a) * (place - wanted[0])) if known else None)
        return pa.table({"_g": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int32()),
                         "q": pa.array([made], pa.list_(pa.float64()))})

    return counted.groupBy("_g", "part").applyInArrow(pick, "_g long, part int, q array<double>")


def _refined(source: DataFrame, brackets: DataFrame, keys: Sequence[str], view: View, width: int, prob: float) -> DataFrame:
    """Narrower brackets for very large groups: a histogram of the bracket shows the bin of the rank."""
    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for g, counts in held.items():
                slot, v = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), g), pa.int64()), pa.array(slot, pa.int32()),
                                                  pa.array(v.astype(float)), pa.array(counts[slot, v], pa.int64())],
                                                 names=["_g", "slot", "v", "m"])
            held.clear()

        for batch in batches:
            for i in range(len(batch)):
                x, low, high, g = view(batch, i), numbers(batch["_lo"][i]), numbers(batch["_hi"][i]), batch["_g"][i].as_py()
                row, slot = np.nonzero(~np.isnan(x))
                places = slot * (_BINS + 2) + _bin_of(x, low, high)[row, slot]
                if g not in held and len(held) >= _HELD:
                    yield from told()
                held[g] = held.get(g, 0) + np.bincount(places, minlength=width * (_BINS + 2)).reshape(width, _BINS + 2)
        yield from told()

    counts = (source.join(brackets, list(keys)).mapInArrow(histogram, _COUNTS)
              .groupBy("_g", "slot", "v").agg(F.sum("m").alias("m")))
    slots = Window.partitionBy("_g", "slot")
    place = F.lit(prob) * (F.sum("m").over(slots) - 1)
    ranked = counts.withColumn("place", place).withColumn("up_to", F.sum("m").over(slots.orderBy("v")))
    chosen = ranked.groupBy("_g", "slot").agg(
        F.min(F.when(F.col("up_to") > F.floor("place"), F.col("v"))).cast("int").alias("first"),
        F.min(F.when(F.col("up_to") > F.ceil("place"), F.col("v"))).cast("int").alias("last"))
    bins = chosen.groupBy("_g").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("first", "last")))).alias("_bins"))
    low, high = F.get("_lo", F.col("_i")), F.get("_hi", F.col("_i"))
    narrowed = brackets.join(bins, "_g", "left").select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_i"))
    found = F.try_element_at("_bins", F.col("_i"))
    span = (high - low) / _BINS
    finite = (low > _LOW) & (high < _HIGH) & found.isNotNull()
    # one bin of slack on either side keeps the bounds safe from rounding
    new_low = F.when(finite, F.greatest(low, low + span * (found["first"] - 2))).otherwise(low)
    new_high = F.when(finite, F.least(high, low + span * (found["last"] + 1))).otherwise(high)
    pairs = narrowed.select(*keys, "_g", "_size", F.struct("_i", new_low.alias("lo"), new_high.alias("hi")).alias("_e"))
    packed = pairs.groupBy(*keys, "_g", "_size").agg(F.sort_array(F.collect_list("_e")).alias("_e"))
    return packed.select(*keys, "_g", "_size", F.transform("_e", lambda e: e["lo"]).alias("_lo"),
                         F.transform("_e", lambda e: e["hi"]).alias("_hi"))


def _bin_of(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """0 below the bracket, 1 to ``_BINS`` inside, ``_BINS + 1`` above."""
    finite = np.isfinite(low) & np.isfinite(high) & (high > low)
    span = np.where(finite, high - low, 1.0)
    base = np.where(finite, low, 0.0)
    with np.errstate(invalid="ignore"):
        bins = np.clip(np.floor((np.nan_to_num(x) - base) / span * _BINS), 0, _BINS - 1).astype(np.int64) + 1
    bins = np.where(finite, bins, 1)
    return np.where(x < low, 0, np.where(x > high, _BINS + 1, bins))
