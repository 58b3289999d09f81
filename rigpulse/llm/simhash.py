"""SimHash near-duplicates: fingerprints of word shingles, links within a few bits, linked components.

Fingerprints at most ``max_bits`` apart are found by deletion variants. The 64 bits are cut into ``max_bits // 2 + 1``
segments, so a linked pair has a segment in which it differs in at most one bit. Each distinct fingerprint is indexed
under every segment as it is and under every segment with one bit masked; pairs meet in an equality join and are
verified on all 64 bits. A masked variant only pairs fingerprints that differ in the masked bit, so each segment yields
a pair once.

Fingerprints are made distinct before the join, so exact copies, however many, enter it as one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rigpulse.llm.common import Workspace, components, slices

BITS = 64
#: Words hashed at a time, which bounds the memory for a text of any length.
_WORDS_AT_ONCE = 1 << 15
_SPACE = re.compile(rb"[\x20\x09-\x0d]+")


def _words(text: bytes, chunk: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lower-cased words in lists of bounded size."""
    start = 0
    while start < len(text):
        end = min(len(text), start + chunk)
        if end < len(text):
            cut = _SPACE.search(text, end)
            end = cut.end() if cut else len(text)
        yield text[start:end].lower().split()
        start = end


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the ``width``-word shingles of a text (repeats count); 0 without words."""
    ones, total, tail = np.zeros(BITS, np.int64), 0, []
    for words in _words((text or "").encode()):
        for at in range(0, len(words), _WORDS_AT_ONCE):
            tail += words[at:at + _WORDS_AT_ONCE]
            if len(tail) >= width:
                count, votes = _votes([b" ".join(s) for s in zip(*(tail[k:] for k in range(width)))])
                ones, total, tail = ones + votes, total + count, tail[len(tail) - width + 1:]
    if not total and tail:
        total, ones = _votes([b" ".join(tail)])
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True) if total else 0


def _votes(shingles: list[bytes]) -> tuple[int, np.ndarray]:
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))
    return len(hashes), np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3,
                 carry: Sequence[str] = ()) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long; null and empty texts have 0.

    The columns ``carry`` follow as ``_c0``, ``_c1``, and so on.
    """
    others = [f"_c{k}" for k in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            found = [fingerprint(x.as_py(), width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]],
                                             names=["id", "fp", *others])

    chosen = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"),
                         F.col(f"`{text_column}`").cast("string").alias("text"),
                         *(F.col(f"`{c}`").alias(o) for c, o in zip(carry, others)))
    schema = StructType([StructField("id", LongType()), StructField("fp", LongType())]
                        + [StructField(o, docs.schema[c].dataType) for c, o in zip(carry, others)])
    return chosen.mapInArrow(run, schema)


def near_fingerprints(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): all pairs of the distinct fingerprints ``fp`` that differ in 1 to ``max_bits`` bits, each at least once."""
    parts = max_bits // 2 + 1
    edges = [BITS * k // parts for k in range(parts + 1)]
    variants = []
    for low, high in zip(edges, edges[1:]):
        mask = (1 << high) - (1 << low)
        variants += [(mask, 0), *((mask & ~(1 << bit), 1 << bit) for bit in range(low, high))]
    slots = F.array(*(F.struct(F.lit(_signed(kept)).alias("kept"), F.lit(_signed(bit)).alias("bit"))
                      for kept, bit in variants))
    index = (distinct.select("fp", F.posexplode(slots).alias("slot", "v"))
             .select("fp", "slot", F.col("fp").bitwiseAND(F.col("v.kept")).alias("value"),
                     (F.col("v.bit") == 0).alias("whole"), (F.col("fp").bitwiseAND(F.col("v.bit")) != 0).alias("side")))
    left, right = index.alias("l"), index.alias("r").hint("merge")  # 66 rows of each: never a broadcast
    met = left.join(right, (F.col("l.slot") == F.col("r.slot")) & (F.col("l.value") == F.col("r.value"))
                    & F.when(F.col("l.whole"), F.col("l.fp") < F.col("r.fp")).otherwise(F.col("l.side") < F.col("r.side"))
                    & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= max_bits))
    return met.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3,
                   max_bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fp, component_id (the smallest id that links reach, its own included), component.

    ``component`` tells apart the components of one smallest id, which a repeated id can have: it is a fingerprint in it.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with equal fingerprints (repeated rows
    too) are linked. A null id takes part in the links but is nobody's smallest; the component of a group without any
    id is null. An empty table gives an empty table. Other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    marked = ws.table(fingerprints(docs, id_column, text_column, width), "fingerprints")
    distinct = ws.table(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    labels = components(ws, near_fingerprints(distinct.select("fp"), max_bits))
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = ws.table(named.join(smallest, "component").select("fp", "component_id", "component"), "groups")
    ws.drop(distinct)
    return marked.join(groups, "fp").select("id", "fp", "component_id", "component")


def keep_one(docs: DataFrame, groups: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             width: int = 3) -> DataFrame:
    """One row of ``docs`` for each component in ``groups`` (of the same rows and ``width``), one that has its smallest id.

    Rows that share an id are copies only if they share a component as well; of those the first by fingerprint, then by a
    hash of the row, stays. The fingerprint is computed again for repeated ids alone. Rows without an id cannot be named
    and stay.
    """
    ids = groups.where("id IS NOT NULL").groupBy(F.col("id").alias("_named")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.col("id") == F.col("component_id")).alias("_own"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
                       F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{text_column}`").alias("_text"))
    own = rows.join(ids.where("_own"), F.col("_id") == F.col("_named"))
    single, several = own.where("_n = 1").select("_row"), own.where("_n > 1")
    marked = fingerprints(several, "_id", "_text", width, ("_row",))
    places = groups.where("id = component_id").select("id", "fp", "component").distinct()
    first = F.min_by("_c0", F.struct("fp", F.xxhash64(F.to_json(F.struct("_c0")))))
    copies = marked.join(places, ["id", "fp"]).groupBy("id", "component").agg(first.alias("_row")).select("_row")
    return single.union(copies).union(rows.where("_id IS NULL").select("_row")).select("_row.*")
