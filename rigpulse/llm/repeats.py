"""Removal of long byte strings that also start in an earlier document, exact, over all documents.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Work is dealt
by content, so that no task sees more than a bounded part of the corpus:

1. Documents are packed into blocks of about ``BLOCK_BYTES``, written once.
2. Each window of ``LENGTH`` bytes has an anchor, its ``GRAM``-byte string with the smallest hash. Equal windows have
   equal anchors at the same place, so it is enough to compare windows with equal anchors. A block sends the hashes of
   its anchors to reducers, which answer for each whether a second document has it; the rest can be forgotten.
3. The stretches of text whose windows share such an anchor (contexts, under 80 bytes, distinct within the block, with
   the smallest id) go to the reducer of the anchor. Windows of an anchor with very many different surroundings are
   dealt one by one by their own hash, so no anchor fills a reducer.
4. A reducer builds a run-compressed Burrows-Wheeler transform of its distinct contexts with positions sampled at the
   ends of runs, and streams the contexts backwards through it, all at once. The row that a position reaches lies in
   the interval of the strings that agree with it on ``LENGTH`` bytes; a window is repeated if that interval holds a
   smaller id. One bit per window goes back to the block.
5. The blocks cut their documents.

Hashes only bring candidates together (and copies within a block, by 64 bits); the comparison is on bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigpulse.llm.common import Workspace, slices

LENGTH, GRAM = 50, 24
#: Windows that share an anchor at most.
REACH = LENGTH - GRAM + 1
BLOCK_BYTES = 2 << 20
#: Text per reducer of each kind.
REDUCER_BYTES = 8 << 20
#: Text in one index of a reducer.
INDEX_BYTES = 1 << 19
#: Different contexts of one anchor beyond which its windows are dealt one by one.
HOT_CONTEXTS = 2048
#: Rows without an id come after all others.
NO_ID = np.iinfo(np.int64).max
_PLACE_BITS = 22
_SEGMENT = 1 << 17
_FULL = np.uint32(0xFFFFFFFF)
_EMPTY = np.zeros(0, np.int64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


_BYTE_HASH = _mix(np.arange(256, dtype=np.uint64), np.arange(1, 257, dtype=np.uint64))
_ODD = pow(0x9E3779B97F4A7C15, 1, 1 << 64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position: a polynomial, doubled up to eight and twice that, then stirred."""
    h = _BYTE_HASH[data]
    for width in (1, 2, 4):
        h = _joined(h[:-width], h[width:], width)
    h = _joined(_joined(h[:-8], h[8:], 8)[:-8], h[16:], 8)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    made = left * np.uint64(pow(_ODD, width, 1 << 64))
    made += right
    return made


def contexts(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Contexts of a block: start, windows, anchor (hash of the anchor) and content (hash), by position.

    ``ends`` are the ends of the documents in ``data``; windows do not cross them.
    """
    found = []
    lengths = np.diff(ends, prepend=0)
    for low in range(0, max(len(data) - LENGTH + 1, 0), _SEGMENT):
        part = data[low:low + _SEGMENT + LENGTH - 1]
        h = gram_hashes(part)
        best = (h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width < REACH:
            step = min(width, REACH - width)
            best = np.minimum(best[:-step], best[step:])
            width += step
        place = (best & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        valid = np.ones(len(place), bool)
        first = np.searchsorted(ends, low, "right")
        for k in range(first, np.searchsorted(ends, low + len(part), "left") + 1):
            if k < len(ends):
                last = ends[k] - low
                valid[max(0, last - min(LENGTH - 1, lengths[k])):max(0, last)] = False
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        start, count = at[begin], np.diff(begin, append=len(at))
        stop = start + count + LENGTH - 1 - GRAM
        content = _mix(_mix(h[start], h[start + GRAM]), _mix(h[np.minimum(start + 2 * GRAM, stop)], h[stop])) + count.astype(np.uint64)
        smallest = h[place[start]]  # stirred again: smallest hashes crowd at the low end of the ranges
        found.append((start + low, count, _mix(smallest, smallest >> np.uint64(31)), content))
    names = ("start", "windows", "anchor", "content")
    kinds = (np.int64, np.int64, np.uint64, np.uint64)
    return {n: np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, (n, t) in enumerate(zip(names, kinds))}


class Block:
    """Documents of one block as bytes, with their contexts, and where messages about them go.

    Every pass rebuilds it from the stored block and finds the same contexts in the same order.
    """

    def __init__(self, ids: bytes, ends: bytes, text: bytes, reducers: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.ends = np.frombuffer(ends, np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
        self.found = contexts(self.data, self.ends)
        self.owner = np.searchsorted(self.ends, self.found["start"], "right")
        self.reducers = np.uint64(reducers)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors in order: reducer, hash of 48 bits, sign (how many contexts, 128 if in two documents)."""
        short = self.found["anchor"] >> np.uint64(16)
        order = np.argsort(short)
        new = np.ones(len(short), bool)
        new[1:] = short[order][1:] != short[order][:-1]
        self.group = np.empty(len(short), np.int64)
        self.group[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        sign = np.ones(len(first), np.uint8)
        again = np.flatnonzero(np.diff(first, append=len(short)) > 1)
        if len(again):
            many = np.zeros(len(first), bool)
            many[again] = True
            at = np.flatnonzero(many[self.group])
            group, content, ids = self.group[at], self.found["content"][at], self.ids[self.owner[at]]
            by = np.lexsort((content, group))
            group, content, ids = group[by], content[by], ids[by]
            begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            other = np.append(True, (group[1:] != group[:-1]) | (content[1:] != content[:-1])).astype(np.int64)
            several = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)
            sign[group[begin]] = np.minimum(np.add.reduceat(other, begin), 127) + 128 * several
        short = short[order[first]]
        return self.reducer(short), short, sign

    def reducer(self, short: np.ndarray) -> np.ndarray:
        """Ranges of the 48-bit hashes."""
        return ((short >> np.uint64(16)) * self.reducers >> np.uint64(32)).astype(np.int64)

    def chosen(self, verdicts: dict[int, bytes]) -> dict[str, np.ndarray]:
        """Contexts of anchors that several documents have, each window of a hot anchor as a context of its own.

        start, windows, owner by occurrence, and ``kind``: its place among the distinct ones, which are listed by
        reducer as first (an occurrence with the smallest id), route (the reducer) and tag (what equal windows share).
        """
        reducer, short, _ = self.anchors()
        says = np.zeros(len(short), np.uint8)
        for r, answer in verdicts.items():
            low, high = np.searchsorted(reducer, [r, r + 1])
            says[low:high] = np.frombuffer(answer, np.uint8)
        verdict = says[self.group]
        plain, hot = np.flatnonzero(verdict == 1), np.flatnonzero(verdict == 2)
        count = self.found["windows"][hot]
        single = np.repeat(self.found["start"][hot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.concatenate([self.found["start"][plain], single])
        windows = np.concatenate([self.found["windows"][plain], np.ones(len(single), np.int64)])
        owner = np.concatenate([self.owner[plain], np.repeat(self.owner[hot], count)])
        content, tag = self.found["content"][plain], self.found["anchor"][plain] >> np.uint64(16)
        if len(single):
            own = self._window_hashes(single)
            content, tag = np.concatenate([content, own]), np.concatenate([tag, own >> np.uint64(16)])
        order = np.lexsort((self.ids[owner], content, tag))
        new = np.ones(len(order), bool)
        new[1:] = (content[order][1:] != content[order][:-1]) | (tag[order][1:] != tag[order][:-1])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        first = order[new]
        return {"start": start, "windows": windows, "owner": owner, "kind": kind, "first": first,
                "route": self.reducer(tag[first]), "tag": (tag[first] & np.uint64(0xFFFFFFFF)).astype("<u4")}

    def _window_hashes(self, start: np.ndarray) -> np.ndarray:
        made = []
        for at in range(0, len(start), 1 << 16):
            grams = [gram_hashes(np.ascontiguousarray(self.data[start[at:at + (1 << 16), None] + k + np.arange(GRAM)].T))[0]
                     for k in (0, GRAM, LENGTH - GRAM)]
            made.append(_mix(_mix(grams[0], grams[1]), grams[2]))
        return np.concatenate(made)

    def covered(self, picked: dict[str, np.ndarray], masks: np.ndarray) -> np.ndarray:
        """Which bytes go, by the masks of the distinct contexts: bit k is window k of a context."""
        ids = self.ids[picked["owner"]]
        mask = np.where(ids > ids[picked["first"]][picked["kind"]], _FULL, masks[picked["kind"]])
        hit = np.zeros(len(self.data) + 1, np.int32)
        for k in range(REACH):
            on = (k < picked["windows"]) & (mask >> np.uint32(k) & np.uint32(1) == 1)
            hit[picked["start"][on] + k] = 1
        total = np.cumsum(hit[:-1])
        total[LENGTH:] -= total[:-LENGTH].copy()
        return total > 0


def pieces(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> bytes:
    """The bytes of all stretches, one after the other."""
    place = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    return data[place].tobytes()


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of strings, each closed by a separator.

    Suffixes are ordered up to their separator, equal ones by string. Stored are the symbol and start of each run, where
    its first row goes when a string is followed backwards, the text positions of the first and last row of each run,
    and the first row of each interval of suffixes that agree on ``LENGTH`` bytes.
    """

    def __init__(self, text: np.ndarray, lengths: np.ndarray):
        size = lengths + 1
        self.begin = np.cumsum(size) - size
        n = int(size.sum())
        symbols = np.zeros(n + 8, np.uint64)
        inner = np.ones(n, bool)
        inner[self.begin + lengths] = False
        symbols[:n][inner] = text.astype(np.uint64) + np.uint64(2)
        symbols[self.begin + lengths] = 1
        rest = np.repeat(self.begin + lengths, size) - np.arange(n)
        key = np.zeros(n, np.uint64)
        for k in range(6):
            key = key << np.uint64(9) | np.where(k <= rest, symbols[k:n + k], np.uint64(0))
        rank, depth = self._ranks(key), 6
        while depth < 2 * LENGTH:
            if depth == 48:
                self_depth = rank
            key = rank * np.int64(n + 1)
            key[:n - depth] += np.where(depth <= rest[:n - depth], rank[depth:] + 1, 0)
            rank, depth = self._ranks(key), depth * 2
        order = np.argsort(rank * np.int64(n) + np.arange(n))
        last = symbols[:n][order - 1]
        last[np.isin(order, self.begin)] = 1
        change = np.ones(n, bool)
        change[1:] = last[1:] != last[:-1]
        self.start = np.flatnonzero(change)
        self.symbol = last[self.start]
        run = np.diff(self.start, append=n)
        by = np.argsort(self.symbol, kind="stable")
        self.goes = np.empty(len(run), np.int64)
        self.goes[by] = np.cumsum(run[by]) - run[by]
        self.sampled = np.stack([order[self.start], order[self.start + run - 1]])
        self.length = run
        far = np.minimum(order + (LENGTH - 48), n - 1)
        differ = np.ones(n, bool)
        differ[1:] = (self_depth[order][1:] != self_depth[order][:-1]) | (self_depth[far][1:] != self_depth[far][:-1])
        self.interval = np.flatnonzero(differ)

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        step = np.zeros(len(key), np.int64)
        step[1:] = np.cumsum(key[order][1:] != key[order][:-1])
        rank = np.empty(len(key), np.int64)
        rank[order] = step
        return rank

    def stream(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow every string backwards: (string, window, interval) of the positions with LENGTH bytes left, in pairs.

        Returns an array (string, window) and the interval of each.
        """
        by = np.argsort(-lengths, kind="stable")
        row, at, found = by.copy(), -np.sort(-lengths), []
        for step in range(1, int(at[0]) + 1 if len(at) else 0):
            live = np.searchsorted(-at, -step, "right")
            row = row[:live]
            run = np.searchsorted(self.start, row, "right") - 1
            inside = row - self.start[run]
            for end, sampled in ((inside == 0, self.sampled[0]), (inside == self.length[run] - 1, self.sampled[1])):
                here = self.begin[by[:live]] + at[:live] - step + 1
                if (sampled[run[end]] != here[end]).any():
                    raise AssertionError("the index does not lead back through its own text")
            row = self.goes[run] + inside
            if step >= LENGTH:
                found.append((by[:live], at[:live] - step, np.searchsorted(self.interval, row, "right") - 1))
        if not found:
            return np.zeros((0, 2), np.int64), _EMPTY
        return (np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], 1),
                np.concatenate([f[2] for f in found]))


def repeated_windows(text: np.ndarray, lengths: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Masks of distinct strings: bit k is set if the window at k also lies in a string with a smaller id.

    Equal windows have equal tags: a string alone with its tag has no partner, and the others are indexed in parts that
    keep a tag together.
    """
    masks = np.zeros(len(lengths), np.uint32)
    order = np.argsort(tags, kind="stable")
    first = np.flatnonzero(np.append(True, tags[order][1:] != tags[order][:-1])) if len(order) else _EMPTY
    size = np.diff(first, append=len(order))
    order = order[np.repeat(size > 1, size)]
    size = size[size > 1]
    begin = np.cumsum(lengths) - lengths
    ends = np.cumsum(size)
    weight = np.cumsum(lengths[order] + 1)[ends - 1] if len(ends) else _EMPTY
    part = weight // INDEX_BYTES
    cuts = [0, *ends[np.flatnonzero(np.diff(part))].tolist(), len(order)]
    for low, high in zip(cuts, cuts[1:]):
        some = order[low:high]
        if len(some):
            masks[some] = _indexed(np.frombuffer(pieces(text, begin[some], lengths[some]), np.uint8), lengths[some], ids[some])
    return masks


def _indexed(text: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    masks = np.zeros(len(lengths), np.uint32)
    index = RunIndex(text, lengths)
    at, interval = index.stream(lengths)
    least = np.full(len(index.interval), NO_ID)
    np.minimum.at(least, interval, ids[at[:, 0]])
    hit = at[least[interval] < ids[at[:, 0]]]
    np.bitwise_or.at(masks, hit[:, 0], np.uint32(1) << hit[:, 1].astype(np.uint32))
    return masks


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_SIGNALS = pa.schema([("reducer", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("signs", pa.binary())])
_ANSWERS = pa.schema([("block", pa.int64()), ("reducer", pa.int64()), ("answer", pa.binary())])
_SENT = pa.schema([("reducer", pa.int64()), ("block", pa.int64()), ("lengths", pa.binary()), ("ids", pa.binary()), ("tags", pa.binary()),
                   ("text", pa.binary())])


def _six_bytes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` without repeated bytes, and what was removed.

    Columns: those of ``docs`` but the text, then _n_bytes, _n_removed, _n_spans (long), _kept_sha256 and, with
    ``keep_text``, _kept (the remaining bytes as text; bytes of a character cut in two are left out). Null texts are
    empty. Repeated rows share an id, so neither is earlier; rows without an id are later than all others and not
    earlier than each other. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "repeats")
    carried = [f for f in docs.schema if f.name != text_column]
    names = [f.name for f in carried]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("n", pa.int64()),
                            ("rest", pa.binary()), ("data", pa.binary())])
        for batch in slices(batches, "_text", BLOCK_BYTES):
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [x.as_py() or b"" for x in batch.column(1)]
            data = b"".join(texts)
            rest = batch.select(range(2, batch.num_columns))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as out:
                out.write_batch(rest)
            yield _batch(schema, [number], [ids.tobytes()], [np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes()],
                         [len(data)], [sink.getvalue().to_pybytes()], [zstandard.ZstdCompressor(3).compress(data)])
            number += 1

    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("_id"),
                         F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).cast("binary").alias("_text"),
                         *(F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)))
    stored = ws.table(source.mapInArrow(blocks, "block long, ids binary, ends binary, n long, rest binary, data binary"), "blocks")
    total = stored.agg(F.sum("n")).first()[0] or 0
    reducers = max(1, -(-total // REDUCER_BYTES))

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reducer, hashes, signs = Block(row["ids"], row["ends"], row["data"], reducers).anchors()
                some, low = np.unique(reducer, return_index=True)
                high = np.append(low[1:], len(reducer))
                yield _batch(_SIGNALS, some, [row["block"]] * len(some), [_six_bytes(hashes[a:b]) for a, b in zip(low, high)],
                             [signs[a:b].tobytes() for a, b in zip(low, high)])

    def decide(table: pa.Table) -> pa.Table:
        sent = [_from_six(x) for x in table["hashes"].to_pylist()]
        sizes = np.array([len(x) for x in sent])
        hashes, back = np.unique(np.concatenate(sent), return_inverse=True)
        signs = np.frombuffer(b"".join(table["signs"].to_pylist()), np.uint8)
        blocks_with = np.bincount(back, minlength=len(hashes))
        several = np.bincount(back, signs >> 7, minlength=len(hashes)) > 0
        surroundings = np.bincount(back, signs & 127, minlength=len(hashes))
        verdict = np.where((blocks_with > 1) | several, np.where(surroundings > HOT_CONTEXTS, 2, 1), 0).astype(np.uint8)[back]
        ends = np.cumsum(sizes)
        return pa.Table.from_arrays([table["block"], table["reducer"], pa.array(
            [verdict[b - s:b].tobytes() for s, b in zip(sizes, ends)], pa.binary())], schema=_ANSWERS)

    answers = "block long, reducer long, answer binary"
    verdicts = ws.table(
        stored.select("block", "ids", "ends", "data").mapInArrow(signals, "reducer long, block long, hashes binary, signs binary")
        .groupBy("reducer").applyInArrow(decide, answers)
        .groupBy("block").agg(F.collect_list(F.struct("reducer", "answer")).alias("verdicts")), "verdicts")

    def opened(row: dict) -> tuple[Block, dict[str, np.ndarray]]:
        block = Block(row["ids"], row["ends"], row["data"], reducers)
        return block, block.chosen({v["reducer"]: v["answer"] for v in row["verdicts"] or []})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, picked = opened(row)
                some, low = np.unique(picked["route"], return_index=True)
                high = np.append(low[1:], len(picked["route"]))
                length = picked["windows"][picked["first"]] + LENGTH - 1
                start, ids = picked["start"][picked["first"]], block.ids[picked["owner"][picked["first"]]]
                zip_text = zstandard.ZstdCompressor(3).compress
                yield _batch(_SENT, some, [row["block"]] * len(some), [length[a:b].astype(np.uint8).tobytes() for a, b in zip(low, high)],
                             [ids[a:b].tobytes() for a, b in zip(low, high)],
                             [picked["tag"][a:b].tobytes() for a, b in zip(low, high)],
                             [zip_text(pieces(block.data, start[a:b], length[a:b])) for a, b in zip(low, high)])

    def match(table: pa.Table) -> pa.Table:
        lengths = np.frombuffer(b"".join(table["lengths"].to_pylist()), np.uint8).astype(np.int64)
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64)
        text = b"".join(map(zstandard.ZstdDecompressor().decompress, table["text"].to_pylist()))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        strings = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text)])
        coded = strings.dictionary_encode()
        kind = coded.indices.to_numpy()
        least = np.full(len(coded.dictionary), NO_ID)
        np.minimum.at(least, kind, ids)
        tags = np.zeros(len(least), np.uint32)
        tags[kind] = np.frombuffer(b"".join(table["tags"].to_pylist()), "<u4")
        own = np.diff(np.frombuffer(coded.dictionary.buffers()[1], np.int32, len(least) + 1)).astype(np.int64)
        found = repeated_windows(np.frombuffer(coded.dictionary.buffers()[2] or b"", np.uint8)[:own.sum()], own, least, tags)
        masks = np.where(ids > least[kind], _FULL, found[kind]).astype("<u4")
        sizes = np.array([len(x) for x in table["lengths"].to_pylist()])
        ends = np.cumsum(sizes)
        return pa.Table.from_arrays([table["block"], table["reducer"], pa.array(
            [masks[b - s:b].tobytes() for s, b in zip(sizes, ends)], pa.binary())], schema=_ANSWERS)

    asked = stored.select("block", "ids", "ends", "data").join(verdicts, "block", "left")
    masks = ws.table(
        asked.mapInArrow(send, "reducer long, block long, lengths binary, ids binary, tags binary, text binary")
        .groupBy("reducer").applyInArrow(match, answers)
        .groupBy("block").agg(F.collect_list(F.struct("reducer", "answer")).alias("masks")), "masks")

    outputs = [("_n_bytes", pa.int64()), ("_n_removed", pa.int64()), ("_n_spans", pa.int64()), ("_kept_sha256", pa.string())]
    outputs += [("_kept", pa.string())] * keep_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, picked = opened(row)
                told = {m["reducer"]: m["answer"] for m in row["masks"] or []}
                answer = np.frombuffer(b"".join(told[r] for r in np.unique(picked["route"])), "<u4")
                gone = block.covered(picked, answer)
                rest = pa.ipc.open_stream(row["rest"]).read_next_batch()
                made = []
                for low, high in zip(np.concatenate([[0], block.ends[:-1]]), block.ends):
                    own, mine = gone[low:high], block.data[low:high]
                    spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(len(own) > 0 and own[0])
                    kept = mine[~own].tobytes()
                    values = (len(mine), int(own.sum()), spans, hashlib.sha256(kept).hexdigest())
                    made.append((*values, kept.decode("utf-8", "ignore")) if keep_text else values)
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, *(pa.array(c, kind) for c, (_, kind) in zip(zip(*made), outputs))],
                    names=[*(f"c{k}" for k in range(len(names))), *(n for n, _ in outputs)])

    fields = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(carried)), "_n_bytes long", "_n_removed long",
                        "_n_spans long", "_kept_sha256 string", *["_kept string"] * keep_text])
    made = stored.join(verdicts, "block", "left").join(masks, "block", "left").mapInArrow(cut, fields)
    return made.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)), *(n for n, _ in outputs))
