"""Ordered computations on long time series without one task per machine.

A machine may hold a large share of all rows, so no window below is partitioned by the machine
alone. Rows are split by (machine, time chunk); what crosses a chunk edge travels through a summary
table with one row per (machine, chunk), which is as long as the time span, not as the data.
Sliding frames use blocks of a fixed number of rows, each with a copy of the rows before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

CHUNK, ROW, BLOCK, OWN = "_chunk", "_row", "_block", "_own"


@dataclass(frozen=True)
class Series:
    """How a table forms time series: machine keys, time column, columns that break equal times."""

    keys: tuple[str, ...]
    ts: str = "timestamp"
    ties: tuple[str, ...] = ()
    chunk_seconds: int = 86400
    block_rows: int = 16384

    @property
    def order(self) -> list[Column]:
        return [F.col(c) for c in (self.ts, *self.ties)]

    @property
    def rank(self) -> Column:
        """One comparable value for the position in time."""
        return F.struct(*self.order) if self.ties else F.col(self.ts)

    @property
    def chunk_keys(self) -> list[str]:
        return [*self.keys, CHUNK]

    @property
    def in_chunk(self) -> WindowSpec:
        return Window.partitionBy(*self.chunk_keys).orderBy(*self.order)

    @property
    def up_to_here(self) -> WindowSpec:
        return self.in_chunk.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def from_here(self) -> WindowSpec:
        """This row and all later ones, from the last row back: a frame that grows takes one step a row, one that shrinks
        is computed anew for each. The row next in time is the last of the frame."""
        return (Window.partitionBy(*self.chunk_keys).orderBy(*[c.desc() for c in self.order])
                .rowsBetween(Window.unboundedPreceding, 0))

    @property
    def chunks(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(CHUNK)

    @property
    def earlier_chunks(self) -> WindowSpec:
        return self.chunks.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def later_chunks(self) -> WindowSpec:
        """From the last chunk back, as ``from_here``."""
        return Window.partitionBy(*self.keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)

    def chunked(self, df: DataFrame, ts: str | None = None) -> DataFrame:
        return df.withColumn(CHUNK, self.chunk_of(ts or self.ts))

    def chunk_of(self, ts: str) -> Column:
        return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(self.chunk_seconds)).cast("long")

    def summary(self, chunked: DataFrame, *aggregates: Column) -> DataFrame:
        return chunked.groupBy(*self.chunk_keys).agg(*aggregates)


def beside(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows``, which already lie by ``keys``, and ``table`` with a row for each of them.

    A merge join shuffles only the table. Left to its size, a table that grows with the input is broadcast through
    the driver for as long as it stays below the planner's limit, which counts a fraction of what it takes in memory.
    """
    return rows.join(table.hint("merge"), list(keys), how)


def running_sum(df: DataFrame, series: Series, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` from the first row of the machine to this row."""
    rows = series.chunked(df).withColumn("_v", value)
    before = series.summary(rows, F.sum("_v").alias("_t")).select(
        *series.chunk_keys, F.coalesce(F.sum("_t").over(series.earlier_chunks), F.lit(0)).alias("_before")
    )
    return (
        beside(rows.withColumn("_inner", F.sum("_v").over(series.up_to_here)), before, series.chunk_keys)
        .withColumn(name, F.col("_before") + F.col("_inner"))
        .drop(CHUNK, "_v", "_inner", "_before")
    )


def number_rows(df: DataFrame, series: Series, name: str = ROW) -> DataFrame:
    """Position of each row in its machine's series, from 0."""
    return running_sum(df, series, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)


def with_previous(df: DataFrame, series: Series, columns: dict[str, str]) -> DataFrame:
    """Values of the row before, ``{column: name of its previous value}``; null on the first row."""
    rows = series.chunked(df)
    edge = series.summary(rows, *[F.max_by(c, series.rank).alias(c) for c in columns]).select(
        *series.chunk_keys, *[F.lag(c).over(series.chunks).alias(f"_edge_{new}") for c, new in columns.items()]
    )
    first = F.col("_n") == 1
    inner = [F.lag(c).over(series.in_chunk).alias(f"_lag_{new}") for c, new in columns.items()]
    return (
        beside(rows.select("*", F.row_number().over(series.in_chunk).alias("_n"), *inner), edge, series.chunk_keys)
        .select(
            *df.columns,
            *[
                F.when(first, F.col(f"_edge_{new}")).otherwise(F.col(f"_lag_{new}")).alias(new)
                for new in columns.values()
            ],
        )
    )


def nearest_known(df: DataFrame, series: Series, columns: dict[str, Column]) -> DataFrame:
    """For each named value: ``<name>_before`` and ``<name>_after``, the nearest non-null one, this row included."""
    rows = series.chunked(df)
    edges, carried, inner = [], [], []
    for name, value in columns.items():
        known = F.when(value.isNotNull(), series.rank)
        edges += [F.max_by(value, known).alias(f"_l_{name}"), F.min_by(value, known).alias(f"_f_{name}")]
        carried += [
            F.last(f"_l_{name}", True).over(series.earlier_chunks).alias(f"_p_{name}"),
            F.last(f"_f_{name}", True).over(series.later_chunks).alias(f"_n_{name}"),
        ]
        inner += [
            F.last(value, True).over(series.up_to_here).alias(f"_b_{name}"),
            F.last(value, True).over(series.from_here).alias(f"_a_{name}"),
        ]
    edge = series.summary(rows, *edges).select(*series.chunk_keys, *carried)
    nearest = []
    for name in columns:
        nearest += [
            F.coalesce(f"_b_{name}", f"_p_{name}").alias(f"{name}_before"),
            F.coalesce(f"_a_{name}", f"_n_{name}").alias(f"{name}_after"),
        ]
    return beside(rows.select("*", *inner), edge, series.chunk_keys).select(*df.columns, *nearest)


def over_rows(
    df: DataFrame, series: Series, rows_before: int, build: Callable[[WindowSpec], list[Column]]
) -> DataFrame:
    """Add window columns whose frames reach at most ``rows_before`` rows back.

    ``build`` gets a window ordered by row number and may call it in several frames.
    """
    return staged_over_rows(df, series, rows_before, [build])


def staged_over_rows(
    df: DataFrame, series: Series, rows_before: int, stages: list[Callable[[WindowSpec], list[Column]]]
) -> DataFrame:
    """As ``over_rows``; a later stage may use the columns of an earlier one. The reaches add up."""
    blocks = _blocks(df, series, rows_before)
    window = Window.partitionBy(*series.keys, BLOCK).orderBy(ROW)
    for build in stages:
        blocks = blocks.select("*", *build(window))
    result = blocks.where(F.col(BLOCK) == F.col("_home")).drop(BLOCK, "_home")
    return result if ROW in df.columns else result.drop(ROW)


def _blocks(df: DataFrame, series: Series, rows_before: int) -> DataFrame:
    """Numbered rows in their blocks, each with a copy of the rows before it."""
    numbered = df if ROW in df.columns else number_rows(df, series)
    length = max(series.block_rows, rows_before)
    home = F.floor(F.col(ROW) / F.lit(length)).cast("long")
    copied = F.col(ROW) % length >= length - rows_before
    return numbered.withColumn("_home", home).withColumn(
        BLOCK, F.explode(F.when(copied, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
    )


def map_blocks(
    df: DataFrame, series: Series, rows_before: int, names: Sequence[str],
    task: Callable[[pa.Table, np.ndarray], Sequence[pa.Array]], rows_at_once: int = 1 << 15
) -> DataFrame:
    """Add columns of doubles that ``task`` makes from whole blocks, about ``rows_at_once`` rows of them at a time.

    It gets the rows of some blocks in order and the place of each row in its block, from 0.
    """
    window = Window.partitionBy(*series.keys, BLOCK).orderBy(ROW)
    placed = (_blocks(df, series, rows_before).repartition(*series.keys, BLOCK).withColumn("_place", F.row_number().over(window) - 1)
              .sortWithinPartitions(*series.keys, BLOCK, "_place"))
    given = df.columns
    schema = StructType([*df.schema, *[StructField(name, DoubleType()) for name in names]])

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        own = pa.array(table[BLOCK].to_numpy() == table["_home"].to_numpy())
        made = pa.table([*table.select(given).columns, *task(table, table["_place"].to_numpy())], [*given, *names])
        yield from made.filter(own).to_batches(max_chunksize=1 << 13)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough = [], 0, rows_at_once
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= enough:
                table = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(table["_place"].to_numpy() == 0)[-1])  # the last block may go on
                if cut:
                    yield from whole(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), len(table) - cut
                enough = max(rows_at_once, 2 * rows)
        if rows:
            yield from whole(pa.Table.from_batches(held))

    return placed.mapInArrow(run, schema)


def gated(aggregate: Column, counted: Column, window: WindowSpec, least: int | Column) -> Column:
    """``aggregate`` over the frame, null while the frame holds fewer than ``least`` known values."""
    return F.when(F.count(counted).over(window) >= least, aggregate.over(window))
