r"""Importance resampling towards a target: weights from hashed features, a drawn share, ranks.

A feature is a run of 1 to ``orders`` consecutive words (``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are put in lower
case), joined by one blank; its bucket is the CRC-32 of its bytes modulo ``buckets``. The gain of a bucket compares its share
in the target with its share in the corpus, the weight of a document is the mean gain of its features, and its score is the
weight with Gumbel noise that follows from its id, so the highest scores are a draw without replacement.

The scores are written once. A cutoff is found by bisection: jobs that count exactly how many scores, then how many ids
among those tied at the last score, lie beyond a few thresholds, until one value is left. Only the rows beyond the cutoff are
dealt into ranges and numbered.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rigpulse.llm.common import Workspace, slices
from rigpulse.llm.decontamination import GAPS, LOWER, NORMAL, UPPER

#: Bytes of a text that are split into words at a time, distinct features a task remembers, and the longest of them.
_PIECE, _REMEMBERED, _LONGEST = 1 << 20, 500_000, 64
#: Thresholds that one counting job tries.
_WAYS = 15


@dataclass(frozen=True)
class DrawConfig:
    orders: int = 1
    buckets: int = 10_000
    seed: int = 2024
    min_words: int = 20
    #: Per cent of the documents of ``min_words`` words that are drawn.
    percent: int = 10


class Buckets(dict):
    """Feature to bucket; remembers short ones."""

    def __init__(self, count: int):
        super().__init__()
        self.count = count

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.count
        if len(feature) <= _LONGEST:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[feature] = found
        return found


def text_buckets(raw: bytes, memory: Buckets, orders: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) for one piece of the text after the other."""
    flat, start, before = raw.translate(NORMAL), 0, []
    while start < len(flat):
        stop = flat.find(b" ", start + _PIECE)
        stop = len(flat) if stop < 0 else stop
        new = flat[start:stop].split()
        start = stop
        words, old = before + new, len(before)
        features = [new] + [[b" ".join(words[k - n:k]) for k in range(max(n, old + 1), len(words) + 1)]
                            for n in range(2, orders + 1)]
        yield len(new), np.fromiter((memory[f] for part in features for f in part), np.int64)
        before = words[len(words) - min(len(words), orders - 1):]


def _raw(df: DataFrame, text_column: str, *others: Column) -> DataFrame:
    return df.select(*others, F.col(f"`{text_column}`").cast("string").cast("binary").alias("raw"))


def bucket_counts(df: DataFrame, config: DrawConfig = DrawConfig(), text_column: str = "text") -> np.ndarray:
    """Features of all texts by bucket. A task sends one row for each bucket; the driver gets ``buckets`` sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, total = Buckets(config.buckets), np.zeros(config.buckets, np.int64)
        for batch in slices(batches, "raw", 8 << 20):
            for x in batch.column(0):
                for _, found in text_buckets(x.as_py() or b"", memory, config.orders):
                    total += np.bincount(found, minlength=config.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counts = np.zeros(config.buckets, np.int64)
    for row in _raw(df, text_column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    size = len(corpus)
    all_corpus, all_target = float(corpus.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(id_column: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise that follows from the id; a null id counts as empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, config: DrawConfig = DrawConfig(), id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row."""
    kinds = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_features", "weight")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Buckets(config.buckets)
        for batch in slices(batches, "raw", 8 << 20):
            rows = []
            for x in batch.column(1):
                words = features = total = 0
                for n, found in text_buckets(x.as_py() or b"", memory, config.orders):
                    words, features, total = words + n, features + len(found), total + int(gain[found].sum())
                rows.append((words, features, total // features if features else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], schema=kinds)

    ids = F.col(f"`{id_column}`").cast("long").alias("doc_id")
    made = _raw(docs, text_column, ids).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return made.withColumn("score", F.col("weight") + noise(F.col("doc_id"), config.seed))


def smallest_with(df: DataFrame, value: Column, wanted: int) -> int | None:
    """The smallest v such that at least ``wanted`` rows have a value <= v; None where fewer rows have a value at all.

    Each job halves the range as often as ``_WAYS`` thresholds can; nothing but counts reaches the driver.
    """
    low, high, known = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if known < wanted:
        return None
    while low < high:
        cuts = sorted({low + (high - low) * k // (_WAYS + 1) for k in range(1, _WAYS + 1)} - {high})
        below = df.agg(*(F.count(F.when(value <= F.lit(c), 1)) for c in cuts)).first()
        enough = [c for c, n in zip(cuts, below) if n >= wanted]
        few = [c for c, n in zip(cuts, below) if n < wanted]
        low, high = (few[-1] + 1 if few else low), (enough[0] if enough else high)
    return low


def draw(docs: DataFrame, target: DataFrame, config: DrawConfig = DrawConfig(), id_column: str = "doc_id",
         text_column: str = "text", target_text: str = "text") -> DataFrame:
    """Each row of ``docs`` with doc_id, n_features, weight, score, rank; rank (1, 2, ...) is null where it is not drawn.

    Drawn are ``percent`` per cent, rounded down, of the rows with at least ``min_words`` words: the highest scores, among
    equals the smaller id, rows without an id last, then fewer features; rows equal in all of these are interchangeable.
    Null and empty texts have no features and weight 0. Repeated rows take part once each. Empty tables: no rows, or
    target shares that come from smoothing alone. Very long texts are split piece by piece. Other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "draw")
    gain = gains(bucket_counts(docs, config, text_column), bucket_counts(target, config, target_text))
    rows = ws.table(scored(docs, gain, config, id_column, text_column).withColumn("row", F.monotonically_increasing_id()), "scores")
    able = rows.where(F.col("n_words") >= config.min_words)
    wanted = able.count() * config.percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.select(*out, undrawn)
    cut = -smallest_with(able, -F.col("score"), wanted)
    tied = able.where(F.col("score") == cut)
    last = smallest_with(tied, F.col("doc_id"), wanted - able.where(F.col("score") > cut).count())
    # only null ids can be beyond an id that is needed: they come last
    within = F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= last, F.lit(False))
    beyond = (F.col("n_words") >= config.min_words) & ((F.col("score") > cut) | ((F.col("score") == cut) & within))
    ranked = number(ws, rows.where(beyond), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("row")])
    drawn = ranked.select(*out, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return drawn.union(rows.where(~beyond).select(*out, undrawn))


def number(ws: Workspace, rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with rank, 1 for the first in ``order``: ranges are sorted apart, then shifted by the sizes of those before."""
    parts = max(1, int(ws.spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id()
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = ws.table(sorted_rows.select("*", place.alias("_place")), "ranges")
    part = F.shiftright("_place", 33)
    bases = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    bases = bases.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_base"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (held.withColumn("_part", part).join(bases, "_part")
            .withColumn("rank", F.col("_base") + inside + 1).drop("_part", "_base", "_place"))


def draw_sql(config: DrawConfig = DrawConfig()) -> str:
    """The draw from table ``documents`` towards table ``benchmark`` as SQL, for features of one word."""
    if config.orders != 1:
        raise ValueError("the SQL is for features of one word")
    words = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAPS}'), lambda w: w <> '')"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
u AS (SELECT r, unnest(words) AS w FROM d), v AS (SELECT unnest({words}) AS w FROM benchmark),
tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
w AS (SELECT DISTINCT w FROM (SELECT w FROM u UNION ALL SELECT w FROM v)),
x AS (SELECT w, hex(encode(w)) AS h FROM w),
c AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2),
  lambda k: CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))),
  lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % {config.buckets} AS bucket FROM x, tab),
s AS (SELECT bucket, count(*) AS n FROM u JOIN c USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM v JOIN c USING (w) GROUP BY bucket),
a AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) + {config.buckets} AS ds, (SELECT coalesce(sum(n), 0) FROM t) + {config.buckets} AS dt),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * CAST(ds AS DOUBLE) / ((s.n + 1) * CAST(dt AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), a),
f AS (SELECT r, count(*) AS n, sum(gain) AS total FROM u JOIN c USING (w) JOIN g USING (bucket) GROUP BY r),
k AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('{config.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN f USING (r)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM k),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features) AS rank, count(*) OVER () AS able
  FROM z WHERE n_features >= {config.min_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= able * {config.percent} // 100 THEN rank END AS rank FROM z LEFT JOIN o USING (r)"""
