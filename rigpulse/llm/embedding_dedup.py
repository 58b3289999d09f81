"""Near-duplicate vectors by sorted projection passes.

A pass orders the distinct vectors by the concatenated signs of random projections and compares each with the
``window`` vectors after it; verified pairs of all passes are united to components. Signs are taken of the vectors less
their mean, so that a direction which all share does not leave most of them with the same signs; pairs are verified on
the vectors themselves.

The number of passes is measured. What a window spans in the first passes tells how many signs two vectors must share
to meet in it, the length of the mean tells how far apart a pair at the threshold lies without it, and passes are added
until such a pair is found with probability ``recall``. Where the vectors at both ends of a window are themselves closer
than the threshold, links run through it and no more passes are needed. The stronger the common direction, the less is
left to tell vectors apart and the more passes it takes.

Windows bound only the search. Links are then counted exactly among the vectors of each component, in blocks whose
tasks are bounded; that count is quadratic in the size of a component of different vectors, as its links are. Equal
vectors are one row from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rigpulse.llm.common import Workspace, components


@dataclass(frozen=True)
class ProjectionConfig:
    threshold: float = 0.9
    window: int = 32
    recall: float = 0.98
    least_passes: int = 16
    #: The smallest cosine without the mean that passes are made for; below it the mean alone nearly makes a link.
    least_cosine: float = 0.4
    bits: int = 60
    seed: int = 11
    #: Rows of a sorted block, and of a block of a component.
    block: int = 1024

    def apart(self, shared: float) -> float:
        """Share of signs in which two vectors at the threshold differ, once a mean of squared length ``shared`` is gone."""
        left = (self.threshold - shared) / max(1e-9, 1 - shared)
        return math.acos(max(self.least_cosine, left)) / math.pi

    def passes(self, spans: list[tuple[float, int, int]]) -> int:
        """Passes that find a pair at the threshold with probability ``recall``.

        ``spans`` are (squared length of the mean, signs to share or 0 where none are needed, number of vectors).
        """
        total = sum(n for _, _, n in spans)

        def missed(passes: int) -> float:
            return sum(n * (1 - (1 - self.apart(shared)) ** signs) ** passes for shared, signs, n in spans)

        enough = self.least_passes
        while missed(enough) > (1 - self.recall) * total:
            enough += max(1, enough // 8)
        return enough


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, data): components as doubles; dim and data are null for vectors that link with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                data, dims = [], []
                for v in part.column(1):
                    x = np.array(v.as_py(), "<f8") if v.is_valid and all(c.is_valid for c in v) else np.zeros(0)
                    good = len(x) and np.isfinite(x).all() and x.any()
                    data.append((x + 0.0).tobytes() if good else None)
                    dims.append(len(x) if good else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(dims, pa.int32()), pa.array(data, pa.binary())],
                                                 names=["vec_id", "dim", "data"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")
                          ).mapInArrow(run, "vec_id long, dim int, data binary")


def _centres(ws: Workspace, distinct: DataFrame) -> DataFrame:
    """(dim, centre, shared): mean of the unit vectors of each length and its squared length, from sums of batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                x = _unit(batch.column(1).take(pa.array(np.flatnonzero(dims == dim))).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(x)], pa.int64()),
                                                  pa.array([x.sum(0).tolist()], pa.list_(pa.float64()))], names=["dim", "n", "total"])

    sums = distinct.select("dim", "data").mapInArrow(run, "dim int, n long, total array<double>")
    means = (sums.select("dim", "n", F.posexplode("total").alias("at", "part")).groupBy("dim", "at")
             .agg((F.sum("part") / F.sum("n")).alias("mean")))
    centres = means.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "mean"))).alias("all"),
                                       F.sum(F.col("mean") * F.col("mean")).alias("shared"))
    return ws.table(centres.select("dim", F.transform("all", lambda e: e["mean"]).alias("centre"), "shared"), "centres")


def _keys(distinct: DataFrame, centres: DataFrame, config: ProjectionConfig, first: int, last: int) -> DataFrame:
    """(pass, dim, key, node) for every vector and the passes from ``first`` to below ``last``."""
    weights = 1 << np.arange(config.bits - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                centre = np.array(batch.column(3)[int(rows[0])].as_py())
                for at in range(0, len(rows), 2048):
                    some = pa.array(rows[at:at + 2048])
                    x, node = _unit(batch.column(2).take(some).to_pylist()) - centre, batch.column(0).take(some)
                    for p in range(first, last):
                        if (dim, p) not in planes and len(planes) < 512:
                            planes[dim, p] = np.random.default_rng([config.seed, p, dim]).standard_normal((dim, config.bits))
                        plane = planes.get((dim, p))
                        if plane is None:
                            plane = np.random.default_rng([config.seed, p, dim]).standard_normal((dim, config.bits))
                        key = (x @ plane > 0) @ weights
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(key), p, np.int32)), pa.array(np.full(len(key), dim, np.int32)),
                             pa.array(key), node], names=["pass", "dim", "key", "node"])

    return (distinct.select("node", "dim", "data").join(centres.select("dim", "centre"), "dim")
            .select("node", "dim", "data", "centre").mapInArrow(run, "pass int, dim int, key long, node long"))


def _spans(ranged: DataFrame, centres: DataFrame, config: ProjectionConfig) -> list[tuple[float, int, int]]:
    """How many signs the ends of windows share, counted: at most a hundred squared lengths times the bits of a key."""
    inside = Window.partitionBy("part", "pass", "dim").orderBy("key", "node")
    other = F.col("key").bitwiseXOR(F.lead("key", config.window).over(inside))
    same = F.lit(config.bits) - F.when(other == 0, 0).otherwise(F.length(F.bin(other)))
    ends = (ranged.select("dim", F.bit_count(other).alias("differ"), same.alias("same")).where("same IS NOT NULL")
            .groupBy("dim", "differ", "same").agg(F.count("*").alias("n")))
    counted = (ends.join(centres.select("dim", F.round("shared", 2).alias("shared")), "dim")
               .groupBy("shared", "differ", "same").agg(F.sum("n").alias("n")).collect())
    return [(r["shared"], 0 if r["differ"] < config.bits * config.apart(r["shared"]) else r["same"] + 1, r["n"]) for r in counted]


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs that hold the same places together as all ``pairs`` do."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            root[x] = y
            kept.append((a, b))
    return kept


def _ranged_keys(ws: Workspace, distinct: DataFrame, centres: DataFrame, config: ProjectionConfig, first: int,
                 last: int) -> DataFrame:
    parts = max(1, int(ws.spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = (_keys(distinct, centres, config, first, last).repartitionByRange(parts, "pass", "dim", "key", "node")
              .withColumn("part", F.spark_partition_id()))
    return ws.table(ranged, "keys")


def _pass_links(ws: Workspace, distinct: DataFrame, ranged: DataFrame, config: ProjectionConfig) -> DataFrame:
    """(a, b): verified pairs that hold together what the windows of the passes in ``ranged`` link."""
    inside = Window.partitionBy("part", "pass", "dim").orderBy("key", "node")
    before = (ranged.groupBy("part", "pass", "dim").agg(F.count("*").alias("n"))
              .withColumn("base", F.sum("n").over(Window.partitionBy("pass", "dim").orderBy("part")) - F.col("n")).drop("n"))
    placed = (ranged.withColumn("rn", F.row_number().over(inside) - 1).join(before, ["part", "pass", "dim"])
              .select("pass", "dim", "node", (F.col("base") + F.col("rn")).alias("at")))
    block = F.floor(F.col("at") / config.block)
    near = F.when((F.col("at") % config.block < config.window) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    dealt = (placed.select("pass", "dim", "node", "at", F.explode(near).alias("block"))
             .join(distinct.select("node", "data"), "node"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        x, node = _unit(table["data"].to_pylist()), table["node"].to_numpy()
        own = table["at"].to_numpy() // config.block == table["block"][0].as_py()
        pairs = []
        for step in range(1, min(config.window, len(x) - 1) + 1):
            hit = np.flatnonzero((np.einsum("ij,ij->i", x[:-step], x[step:]) >= config.threshold) & own[:-step])
            pairs.append(np.stack([hit, hit + step], 1))
        kept = _forest(np.concatenate(pairs), len(x)) if pairs else []
        return pa.table({"a": pa.array([node[a] for a, _ in kept], pa.int64()), "b": pa.array([node[b] for _, b in kept], pa.int64())})

    return ws.table(dealt.groupBy("pass", "dim", "block").applyInArrow(compare, "a long, b long"), "links")


def _count_links(ws: Workspace, members: DataFrame, config: ProjectionConfig) -> DataFrame:
    """(node, others): copies of other vectors that each node of a component (component, node, data, n) links with.

    Components of one block are dealt many to a task; larger ones are cut into chunks, and each pair of chunks is a
    task of its own that returns sums.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    chunks = F.ceil(F.col("size") / config.block).cast("int")
    total = members.count()
    marked = members.join(sizes, "component").withColumn("chunks", chunks)
    small = marked.where("chunks = 1").select(
        F.pmod(F.xxhash64("component"), F.lit(max(1, -(-total // (2 * config.block))))).alias("g"), F.lit(-1).alias("i"),
        F.lit(-1).alias("j"), F.lit(-1).alias("chunk"), "component", "node", "data", "n")
    chunk = F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int")
    large = (marked.where("chunks > 1").withColumn("chunk", chunk)
             .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select(F.col("component").alias("g"), F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"),
                     "chunk", "component", "node", "data", "n"))

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("chunk", "ascending"), ("node", "ascending")])
        component, chunk, n = (table[c].to_numpy() for c in ("component", "chunk", "n"))
        others = np.zeros(len(component), np.int64)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        x = _unit(table["data"].to_pylist())
        cuts = np.flatnonzero(np.append(True, component[1:] != component[:-1])).tolist() + [len(component)]
        for low, high in zip(cuts, cuts[1:]):
            if i == j:
                linked = x[low:high] @ x[low:high].T >= config.threshold
                np.fill_diagonal(linked, False)
                others[low:high] = linked @ n[low:high]
            else:
                left, right = (np.flatnonzero(chunk == c) for c in (i, j))
                linked = x[left] @ x[right].T >= config.threshold
                others[left], others[right] = linked @ n[right], linked.T @ n[left]
        return pa.table({"node": table["node"], "others": pa.array(others)})

    return (small.union(large).groupBy("g", "i", "j").applyInArrow(count, "node long, others long")
            .groupBy("node").agg(F.sum("others").alias("others")))


def near_vectors(vectors: DataFrame, config: ProjectionConfig = ProjectionConfig()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different length. Repeated rows are links of each other. A row without an id counts as a link, is nobody's smallest
    and is kept only if its component has no id. An empty table gives an empty table; other columns are not read.
    """
    ws = Workspace(vectors.sparkSession, "vectors")
    rows = ws.table(_packed(vectors).withColumn("digest", F.sha2("data", 256)), "rows")
    distinct = ws.table(
        rows.where("digest IS NOT NULL").groupBy("digest")
        .agg(F.min("vec_id").alias("least"), F.first("dim").alias("dim"), F.first("data").alias("data"), F.count("*").alias("n"))
        .withColumn("node", F.monotonically_increasing_id()), "distinct")
    centres = _centres(ws, distinct)
    ranged = _ranged_keys(ws, distinct, centres, config, 0, config.least_passes)
    passes = config.passes(_spans(ranged, centres, config))
    found = [_pass_links(ws, distinct, ranged, config)]
    ws.drop(ranged)
    if passes > config.least_passes:
        ranged = _ranged_keys(ws, distinct, centres, config, config.least_passes, passes)
        found.append(_pass_links(ws, distinct, ranged, config))
        ws.drop(ranged)
    links = found[0] if len(found) == 1 else found[0].union(found[1])
    labels = ws.table(components(ws, links), "labels")
    members = labels.join(distinct, "node").select("component", "node", "data", "n", "least")
    others = _count_links(ws, members.drop("least"), config)
    smallest = members.groupBy("component").agg(F.min("least").alias("first"))
    named = labels.join(smallest, "component").select("node", "first").join(others, "node")
    groups = ws.table(distinct.join(named, "node", "left").select(
        "digest", F.coalesce("first", "least").alias("component_id"),
        (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")), "groups")
    ws.drop(*found)
    return rows.select("vec_id", "digest").join(groups, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.when(F.col("digest").isNull(), F.col("vec_id"))).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
