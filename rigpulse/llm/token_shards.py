"""Training-order materialisation: shuffled token sequences in shards of fixed stride.

The documents' ids, each document closed by an end id, form one stream in order of id; it is cut into sequences of
``length`` ids, the last one padded. A keyed Feistel network over the smallest even number of bits that holds the
number of sequences, walked until it lands below that number, gives every sequence its slot: a permutation that needs
no table, no sort and no communication, and that can be inverted. Shard k holds the slots from k * rows on, a record
of 2 * ``length`` bytes for each, so the place of a slot is arithmetic and reading can start at any slot.

The ids are written once, in 16 bits each; the places of the documents follow from their lengths alone. Places go to
files of one block of rows each, which the tasks that read those rows of ids open, so only lengths are shuffled by row
and the ids only once, by shard. What a batch sends to one shard travels as one row, its ids compressed with the low and
the high bytes apart. A very long text is cut into the records it covers and never held as numbers of a row each.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rigpulse.llm.common import Workspace, slices
from rigpulse.llm.tokens import token_rows
from rigpulse.llm.warc import place
from rigpulse.session import drop_folder

ID_BYTES = 2
#: Rows of a file of places: 2 to this power.
_BLOCK_BITS = 16


@dataclass(frozen=True)
class ShardConfig:
    length: int = 1024
    #: Records of a shard.
    rows: int = 4096
    key: int = 0x5EED
    rounds: int = 4
    end: int = 49407
    pad: int = 0


class Feistel:
    """A keyed permutation of 0 to ``size`` - 1."""

    def __init__(self, size: int, key: int, rounds: int):
        self.size = size
        self.half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
        self.keys = np.random.default_rng(key).integers(0, 1 << 63, rounds, dtype=np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return x >> np.uint64(64 - self.half)

    def _walk(self, values: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        out, todo = values.astype(np.uint64), np.arange(len(values))
        low = np.uint64((1 << self.half) - 1)
        while len(todo):
            left, right = out[todo] >> np.uint64(self.half), out[todo] & low
            for key in keys:
                if back:
                    left, right = right ^ self._round(left, key), left
                else:
                    left, right = right, left ^ self._round(right, key)
            out[todo] = left << np.uint64(self.half) | right
            todo = todo[out[todo] >= np.uint64(self.size)]
        return out.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, self.keys, False)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1], True)


def stream_starts(ws: Workspace, lengths: DataFrame) -> tuple[DataFrame, int]:
    """((row, start), number of ids): where each row of ``lengths`` (doc_id, text_hash, row, n) begins in the stream.

    The prefix sum runs in two levels: inside ranges of (doc_id, text_hash, row), and over the sums of the ranges. Rows
    have numbers of their own, so copies of a row are dealt over ranges like any others.
    """
    keys = [F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc_nulls_last(), F.col("row").asc()]
    parts = max(1, int(ws.spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = ws.table(lengths.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "lengths")
    bases = (ranged.groupBy("part").agg(F.sum("n").alias("room"))
             .withColumn("base", F.sum("room").over(Window.orderBy("part")) - F.col("room")))
    total = ranged.agg(F.sum("n")).first()[0] or 0
    before = F.sum("n").over(Window.partitionBy("part").orderBy(*keys)) - F.col("n")
    starts = ranged.withColumn("before", before).join(bases.select("part", "base"), "part")
    made = ws.table(starts.select("row", (F.col("base") + F.col("before")).alias("start")), "starts")
    ws.drop(ranged)
    return made, total


def write_starts(starts: DataFrame, ws: Workspace) -> str:
    """Folder with a file for each block of rows that holds their places as 64-bit numbers in order of row.

    A file appears under its name when it is complete; attempts of one task write the same bytes.
    """
    folder = ws.folder("places")

    def write(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        system, base = place(folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/{block}-{uuid.uuid4().hex}"
        with system.open_output_stream(name, compression=None) as out:
            out.write(table.sort_by("row")["start"].to_numpy().astype("<i8").tobytes())
        system.move(name, f"{base}/{block}.bin")
        return table.select(["block"]).slice(0, 1)

    blocks = starts.withColumn("block", F.shiftright("row", _BLOCK_BITS))
    blocks.groupBy("block").applyInArrow(write, "block long").write.format("noop").mode("overwrite").save()
    return folder


def squeeze(ids: np.ndarray) -> bytes:
    """Unsigned 16-bit ids, low bytes before high bytes, compressed."""
    return pa.compress(ids.view("u1").reshape(-1, ID_BYTES).T.tobytes(), "zstd", asbytes=True)


def unsqueeze(packed: bytes, count: int) -> np.ndarray:
    raw = pa.decompress(packed, ID_BYTES * count, "zstd", asbytes=True)
    return np.frombuffer(raw, "u1").reshape(ID_BYTES, -1).T.reshape(-1).view("<u2")


def write_shards(docs: DataFrame, ws: Workspace, path: str, config: ShardConfig = ShardConfig()) -> tuple[DataFrame, int]:
    """(manifest (shard, path, first_slot, n_records), number of ids) of the shards written for (doc_id, text).

    Null and empty texts are the end id alone; documents without an id come last, repeated rows one after the other. No
    rows, no shards. A shard is written by one task under a name of its attempt; only those in the manifest count.
    """
    columns = {"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64(F.col("text").cast("string"))}
    made = token_rows(docs, lambda row, ids: [(*row, len(ids), ids.tobytes())], "doc_id long,text_hash long,n long,ids binary",
                      columns, path, config.end, ordinary=True)
    rows = ws.table(made.withColumn("row", F.monotonically_increasing_id()), "ids", "zstd")
    starts, total = stream_starts(ws, rows.select("doc_id", "text_hash", "row", "n"))
    count = -(-total // config.length)
    order = Feistel(count, config.key, config.rounds)
    places, folder = write_starts(starts, ws), ws.folder("shards")
    ws.drop(starts)
    target = pa.schema([("shard", pa.int64()), ("at", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = place(places)
        block = begins = None
        for batch in slices(batches, "ids", 4 << 20):
            pieces, sequences, offsets = [], [], []
            for row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if row >> _BLOCK_BITS != block:
                    block = row >> _BLOCK_BITS
                    with system.open_input_file(f"{base}/{block}.bin") as file:
                        begins = np.frombuffer(file.read(), "<i8")
                start = int(begins[row & (1 << _BLOCK_BITS) - 1])
                ids = np.frombuffer(ids, "<u2")
                stop = start + len(ids)
                for sequence in range(start // config.length, (stop - 1) // config.length + 1):
                    low, high = max(sequence * config.length, start), min((sequence + 1) * config.length, stop)
                    pieces.append(ids[low - start:high - start])
                    sequences.append(sequence)
                    offsets.append(low % config.length)
            slot = order.slots(np.array(sequences, np.int64))
            shard, at = slot // config.rows, slot % config.rows * config.length + np.array(offsets, np.int64)
            turn = np.argsort(at + shard * (config.rows * config.length))
            rows = []
            for group in np.split(turn, np.flatnonzero(np.diff(shard[turn])) + 1):
                held = [pieces[k] for k in group]
                rows.append((shard[group[0]], at[group], [len(p) for p in held], squeeze(np.concatenate(held))))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(zip(*rows), target)], schema=target)

    def write(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        first = shard * config.rows
        records = np.full((min(config.rows, count - first), config.length), config.pad, "<u2")
        flat = records.reshape(-1)
        for places, sizes, packed in zip(table["at"].to_pylist(), table["n"].to_pylist(), table["ids"]):
            ids, done = unsqueeze(packed.as_py(), sum(sizes)), 0
            for begin, size in zip(places, sizes):
                flat[begin:begin + size] = ids[done:done + size]
                done += size
        system, base = place(folder)
        system.create_dir(base, recursive=True)
        name = f"{shard:08d}-{uuid.uuid4().hex}.bin"
        with system.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(records.tobytes())
        return pa.table({"shard": [shard], "path": [f"{folder}/{name}"], "first_slot": [first], "n_records": [len(records)]})

    pieces = rows.select("row", "ids").mapInArrow(cut, "shard long, at array<long>, n array<int>, ids binary")
    manifest = ws.table(pieces.groupBy("shard").applyInArrow(write, "shard long, path string, first_slot long, n_records long"), "manifest")
    ws.drop(rows)
    drop_folder(ws.spark, places)
    return manifest, total


def read_slots(path: str, first_slot: int, n_records: int, config: ShardConfig, start: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) of a shard in order, from slot ``start`` on: a seek, then one sequential read."""
    system, inner = place(path)
    skip = min(max(0, start - first_slot), n_records)
    stride = ID_BYTES * config.length
    with system.open_input_file(inner) as file:
        if file.size() != n_records * stride:
            raise ValueError(f"{path} does not hold {n_records} records")
        file.seek(skip * stride)
        for slot in range(first_slot + skip, first_slot + n_records):
            yield slot, np.frombuffer(file.read(stride), "<u2")


def read_shards(manifest: DataFrame, total: int, config: ShardConfig = ShardConfig(), start: int = 0) -> DataFrame:
    """(slot, sequence_id, shard, byte_offset, n_tokens, ids_crc32) of the records from slot ``start`` on.

    The CRC covers the ids without padding as 32-bit numbers; ``total`` is the number of ids of the stream.
    """
    count = -(-total // config.length)
    order = Feistel(count, config.key, config.rounds)
    kinds = pa.schema([(n, pa.int64()) for n in ("slot", "sequence_id", "shard", "byte_offset", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = []
                found = order.sequences(np.arange(row["first_slot"], row["first_slot"] + row["n_records"])).tolist()
                for slot, ids in read_slots(row["path"], row["first_slot"], row["n_records"], config, start):
                    sequence = found[slot - row["first_slot"]]
                    n = min(config.length, total - sequence * config.length)
                    made.append((slot, sequence, row["shard"], (slot - row["first_slot"]) * config.length * ID_BYTES, n,
                                 zlib.crc32(ids[:n].astype("<u4").tobytes())))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], schema=kinds)

    later = manifest.where(F.col("first_slot") + F.col("n_records") > start)
    return later.repartition(max(1, later.count())).mapInArrow(
        run, "slot long, sequence_id long, shard long, byte_offset long, n_tokens long, ids_crc32 long")
