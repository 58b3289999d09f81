"""Token ids of whole texts, word by word, for the token-file operators and for packing."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigpulse.llm.common import slices

WORD_BPE = "word_bpe_49k.json"
#: Distinct words whose ids a Python worker remembers, and the longest of them in bytes.
_REMEMBERED, _LONGEST = 1_000_000, 256
_ENCODERS: dict[tuple[str, bool], WordIds] = {}
#: Marks that may close a word of letters, and words of letters from the first 256 code points.
_MARKS = b".,!?;:#$%&*"
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: The character by which a byte-level model writes a byte: its own if it is visible, else the next one above 255.
_BYTE_CHARS = dict(zip((b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)), range(256, 512)))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    r"""Bytes of a word to its ids as little-endian unsigned 16-bit numbers.

    The tokenizer lowers case, drops white space and splits at it, and parts letters from marks, so the ids of a text
    are those of its words in turn, and those of letters closed by marks are the ids of both. Texts are cut at ASCII
    white space. Words of plain or Latin letters need only the tokenizer's merges; whatever else a word holds is left to
    the tokenizer. If ``ordinary``, the names of special tokens in a text are text like any other.
    """

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")

    def ids(self, text: str) -> bytes:
        raw = text.encode("utf-8", "replace")
        if b"<|" not in raw:  # names of special tokens keep their case
            raw = raw.lower()
        if len(self) > _REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, raw.split()))

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(_MARKS)
        if not _LETTERS.fullmatch(stem):
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}H", *ids)
        elif len(stem) < len(word):
            found = self[stem] + self[word[len(stem):]]
        else:
            chars = word.decode()
            if not word.isascii():
                chars = chars.lower().encode().decode("latin-1").translate(_BYTE_CHARS)
            parts = self.tokenizer.model.tokenize(chars)
            found = struct.pack(f"<{len(parts)}H", *[t.id for t in parts])
        if len(word) <= _LONGEST:
            self[word] = found
        return found


def encoder(path: str, ordinary: bool = False) -> WordIds:
    """One for each worker and vocabulary."""
    if (path, ordinary) not in _ENCODERS:
        _ENCODERS[path, ordinary] = WordIds(path, ordinary)
    return _ENCODERS[path, ordinary]


def token_rows(docs: DataFrame, make, schema: str, columns: dict, path: str, end: int | None,
               ordinary: bool = False) -> DataFrame:
    """Rows that ``make(row columns, ids)`` yields for each document.

    ``columns`` names what to carry (name to expression), ids are an array of unsigned 16-bit numbers that closes with
    ``end``; null texts count as empty.
    """
    names = list(columns)
    tail = b"" if end is None else np.asarray([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, target = encoder(path, ordinary), None
        for batch in slices(batches, "_text", 4 << 20):
            texts = batch.column(len(names))
            rows = []
            for carried, text in zip(zip(*(batch.column(k).to_pylist() for k in range(len(names)))), texts):
                rows += make(carried, np.frombuffer(encode.ids(text.as_py() or "") + tail, "<u2"))
            if rows:
                target = target or _arrow_schema(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, kind.type) for values, kind in zip(zip(*rows), target)], schema=target)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")
    return docs.select(*(c.alias(n) for n, c in columns.items()), text).mapInArrow(run, schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def _arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (part.split() for part in schema.split(","))])
