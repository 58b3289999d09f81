"""Packing of token sequences into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows, which need no search. The rest, sorted by falling
length, goes to the open window with the least room that still suffices. A segment tree over the remaining capacities
finds it: leaf c counts the open windows with c ids of room, and the search descends to the first leaf at or right of
the length that is not empty.

The pieces are dealt into groups of about ``group_pieces`` by a hash and each group is packed on its own, so no task
holds more and a group loses less than one window of padding; a document of any length is spread over the groups by
piece. Only lengths travel to the packing; ids stay where they are unless they are asked for.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigpulse.llm.common import Workspace
from rigpulse.llm.tokens import token_rows

WINDOW = 4096
GROUP_PIECES = 8192
#: Sequence ids of a group start at its number shifted by this.
_GROUP_BITS = 24


class RoomTree:
    """Segment tree over remaining capacities 1 to ``most``: counts of open windows, search of the tightest that fits."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, window: int) -> None:
        if room:
            self.open[room].append(window)
            self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, window) of an open window with the least room of at least ``length``; it is no longer open."""
        room = self._first(length)
        if room is None:
            return None
        self._add(room, -1)
        return room, self.open[room].pop()

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def _first(self, room: int) -> int | None:
        node = room + self.size
        if self.count[node]:
            return room
        while node > 1:  # up to the first node with something open to the right
            if node & 1 == 0 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.size:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.size


def best_fit(lengths: list[int], most: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each length, which must come in falling order and fit in a window."""
    tree, windows, offsets, opened = RoomTree(most), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            room, window, opened = most, opened, opened + 1
        else:
            room, window = found
        windows.append(window)
        offsets.append(most - room)
        tree.put(room - length, window)
    return windows, offsets


def cut_pieces(docs: DataFrame, path: str, end: int, most: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): documents as ids closed by ``end``, cut into full windows.

    Null and empty texts are the id ``end`` alone. ``ids`` are little-endian unsigned 16-bit numbers, the CRC is of
    the ids as 32-bit numbers.
    """
    def make(row, ids):
        for start in range(0, len(ids), most):
            piece = ids[start:start + most]
            made = (row[0], start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids))
            yield (*made, piece.tobytes()) if keep_ids else made

    schema = "doc_id long,start long,length long,ids_crc32 long,doc_tokens long" + ",ids binary" * keep_ids
    return token_rows(docs, make, schema, {"doc_id": F.col("doc_id").cast("long")}, path, end)


def pack(pieces: DataFrame, most: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (doc_id, start, length and others) with sequence_id and offset.

    Within a sequence the pieces follow each other from offset 0 without gaps. Ties in length go by doc_id, then start;
    repeated rows are pieces of their own. No pieces, no sequences. ``pieces`` is a stored table: they are dealt into
    groups by their place in it, so that pieces without an id or with the same one are spread like all others.
    """
    total = pieces.count()
    groups = max(1, -(-total // group_pieces))
    width = pieces.schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        windows, offsets = best_fit(table["length"].to_pylist(), most)
        base = table["_group"][0].as_py() << _GROUP_BITS
        return (table.drop_columns(["_group"]).append_column("sequence_id", pa.array(np.asarray(windows, np.int64) + base))
                .append_column("offset", pa.array(offsets, pa.int64())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in width)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(5)), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame, most: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids): the packed ids of each sequence, padded to ``most``, as 16-bit numbers."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        joined = np.frombuffer(b"".join(table["ids"].to_pylist()), "<u2")
        padded = np.full(most, pad, "<u2")
        padded[:len(joined)] = joined
        return pa.table({"sequence_id": table["sequence_id"][:1], "n_ids": pa.array([len(joined)], pa.int64()),
                         "ids": pa.array([padded.tobytes()], pa.binary())})

    return (packed.select("sequence_id", "offset", "ids").groupBy("sequence_id")
            .applyInArrow(run, "sequence_id long, n_ids long, ids binary"))


def pack_documents(docs: DataFrame, path: str, end: int, most: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Whole documents to packed pieces; see ``cut_pieces`` and ``pack``. Other columns are not read."""
    ws = Workspace(docs.sparkSession, "packing")
    return pack(ws.table(cut_pieces(docs, path, end, most, keep_ids), "pieces"), most)
