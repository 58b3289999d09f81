"""SentencePiece encoding and decoding of whole texts by suffix-array matching.

A text becomes chunks: no piece goes from a character on to a following word mark, so a run of word marks and what
follows up to the next one is encoded by itself. The new chunks of a batch are laid end to end and a suffix array of
them is built by doubling up to the longest piece. A binary search of every piece for its range of suffixes finds all
places where it occurs; these edges, sorted by position, are all that a merge may produce. Each chunk is then relaxed
over its edges: of the neighbouring parts that an edge spans, those of the best score are joined first, the leftmost
of equals before the others, until no edge spans two parts. Characters without a piece become their bytes.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigpulse.llm.common import slices

PIECES = "piece_bpe_32k.model"
MARK = "▁"
_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_REMEMBERED = 1_000_000
#: Characters of new chunks matched by one suffix array.
_AT_ONCE = 1 << 18
#: Mask of a place inside a chunk.
_PLACES = (1 << 35) - 1
_ENCODERS: dict[str, PieceIds] = {}


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first ``depth`` symbols; symbols are positive, the end counts as 0."""
    n, rank, width = len(codes), np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1, 1
    while True:
        key = rank * (n + 2)
        if width < n:
            key[:n - width] += rank[width:]
        order = np.argsort(key, kind="stable")
        width *= 2
        if width >= depth:
            return order
        step = np.zeros(n, np.int64)
        step[1:] = np.cumsum(key[order][1:] != key[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = step + 1


class PieceIds(dict):
    """Chunk to ids as little-endian unsigned 16-bit numbers, for a byte-pair model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        if size > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): i for i in plain}
        #: Place of each piece in the order of scores, best first.
        self.turn = np.unique([-model.get_score(i) for i in range(size)], return_inverse=True)[1].astype(np.int64)
        self.bytes = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(size) if model.is_byte(i)}
        if any(MARK in p.lstrip(MARK) for p in self.pieces) or len(self.bytes) != 256:
            raise ValueError("a piece goes on into the next word, or bytes are missing")
        self.texts: list[bytes] = [b""] * size
        for p, i in self.pieces.items():
            self.texts[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.texts[i] = bytes([b])
        merged = [p for p in self.pieces if len(p) > 1]
        self.longest = max(map(len, merged))
        if self.longest > 31:
            raise ValueError("a piece is longer than 31 characters")
        self.names = np.zeros((len(merged), self.longest), np.int64)
        for k, p in enumerate(merged):
            self.names[k, :len(p)] = [ord(c) for c in p]
        self.sizes = np.array([len(p) for p in merged])
        self.numbers = np.array([self.pieces[p] for p in merged])

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, piece) of every occurrence of a piece of two characters or more, by position."""
        order = suffix_array(codes, self.longest)
        padded = np.concatenate([codes, np.zeros(self.longest, np.int64)])
        low, high = np.zeros(len(self.names), np.int64), np.full(len(self.names), len(order))
        for depth in range(self.longest):
            live = np.flatnonzero((self.sizes > depth) & (low < high))
            if not len(live):
                break
            column, wanted = padded[order + depth], self.names[live, depth]
            low[live], high[live] = (self._bound(column, low[live], high[live], wanted),
                                     self._bound(column, low[live], high[live], wanted + 1))
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        place = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at = order[place]
        by = np.argsort(at, kind="stable")
        return at[by], self.sizes[which[by]], self.numbers[which[by]]

    @staticmethod
    def _bound(column: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """First place in [low, high) whose symbol is not below the wanted one, for all pieces at once."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            below = open_ & (column[np.minimum(middle, len(column) - 1)] < wanted)
            low = np.where(below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return low

    def _relax(self, chunk: str, edges: dict[int, int], pairs: list[int]) -> list[int]:
        """Ids of a chunk. ``edges`` gives the turn of a span (start << 32 | stop), ``pairs`` those of two characters."""
        n = len(chunk)
        after = [*range(1, n + 1), -1]
        before = list(range(-1, n))
        find, push, pop = edges.get, heapq.heappush, heapq.heappop
        heapq.heapify(pairs)
        while pairs:
            turn = pop(pairs)
            left = (turn >> 5) & _PLACES
            stop = left + (turn & 31)
            right = after[left]
            if after[right] != stop:
                continue
            after[left], after[right] = stop, n
            before[stop] = left
            if stop < n and (found := find((left << 32) + after[stop])) is not None:
                push(pairs, found)
            if left and (found := find((before[left] << 32) + stop)) is not None:
                push(pairs, found)
        ids, at, pieces = [], 0, self.pieces
        while at < n:
            part = chunk[at:after[at]]
            if part in pieces:
                ids.append(pieces[part])
            else:
                ids += [self.bytes[b] for b in part.encode("utf-8", "replace")]
            at = after[at]
        return ids

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks together."""
        held: list[str] = []
        size = 0
        for chunk in chunks:
            held.append(chunk)
            size += len(chunk) + 1
            if size >= _AT_ONCE:
                self._learn(held)
                held, size = [], 0
        if held:
            self._learn(held)

    def _learn(self, chunks: list[str]) -> None:
        codes = np.frombuffer("\n".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        names = self.names
        self.names = np.where(names > 0, names + 1, 0)
        at, length, piece = self._edges(codes)
        self.names = names
        starts = np.cumsum([0, *(len(c) + 1 for c in chunks)])
        cuts = np.searchsorted(at, starts)
        left = at - np.repeat(starts[:-1], np.diff(cuts))
        turn = self.turn[piece] << 40 | left << 5 | length
        two = length == 2
        first, firsts = turn[two].tolist(), np.concatenate([[0], np.cumsum(two)])[cuts].tolist()
        spans, turns, cuts = (left << 32 | left + length).tolist(), turn.tolist(), cuts.tolist()
        for k, chunk in enumerate(chunks):
            low, high = cuts[k], cuts[k + 1]
            ids = self._relax(chunk, dict(zip(spans[low:high], turns[low:high])), first[firsts[k]:firsts[k + 1]])
            self[chunk] = struct.pack(f"<{len(ids)}H", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > _REMEMBERED:
            self.clear()
        found = [_CHUNKS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(list({c: None for chunks in found for c in chunks if c not in self}))
        return [b"".join(map(self.__getitem__, chunks)) for chunks in found]

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are no characters become replacement characters."""
        joined = b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u2").tolist()))
        return joined[1:].decode("utf-8", "replace") if joined[:1] == b" " else joined.decode("utf-8", "replace")


def encoder(path: str) -> PieceIds:
    """One for each worker and model."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceIds(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids of each row's whole text, 16 bits each. Null and empty texts have none; other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in slices(batches, "text", 4 << 20):
            ids = model.encode([x.as_py() or "" for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids binary")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids are an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in slices(batches, "ids"):
            texts = [model.decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256): of the ids as 32-bit numbers, and of the text decoded from them."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in slices(batches, "ids"):
            made = [(len(i) // 2, zlib.crc32(np.frombuffer(i, "<u2").astype("<u4").tobytes()),
                     hashlib.sha256(model.decode(i).encode()).hexdigest()) for i in batch.column(1).to_pylist()]
            n, crc, sha = zip(*made)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha)],
                                             names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])

    return encode_pieces(docs, path).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")
