r"""Benchmark passages in documents: one Aho-Corasick automaton over normalised items, each text scanned once.

Texts and items are normalised alike: A-Z in lower case, words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, one blank
before each word. A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window.
Windows close with a blank, so the automaton, which reads bytes, only finds whole words. The word number of a match is the
number of blanks before it, and its place in the original follows from the words' starts there, as normalising a byte never
moves it.

Spark cuts the items into windows and deals them to blocks of bounded size; the driver holds one block at a time and
broadcasts it. One block is the rule. A larger benchmark is a query set against all documents in blocks: the texts are
written once with row numbers, scanned once per block, and the passages of a row are merged.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigpulse.llm.common import Workspace, slices

#: Each byte as it is compared: A-Z in lower case, what is in no word as a blank.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: What separates words, as a pattern for texts in lower case.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of windows of one block, with a toll for each; an automaton takes some 60 bytes a character.
BLOCK_CHARS = 4_000_000
_TOLL = 16
_BLANK = 32
_BUILT: dict[str, object] = {}
_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "begin", "end")]))
_FOUND = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", _SPANS)])
_COLUMNS = "n_words long, n_hit long, items array<long>, spans array<struct<first: long, last: long, begin: long, end: long>>"


def item_windows(benchmark: DataFrame, width: int, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(window, item): the distinct windows of each item."""
    text = F.translate(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")), UPPER, LOWER)
    words = F.filter(F.split(text, GAPS), lambda w: w != "")
    split = benchmark.select(F.col(f"`{id_column}`").cast("long").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(width - 1), F.lit(1)))
    cut = F.transform(starts, lambda i: F.concat_ws(" ", F.slice("words", i, width)))
    return split.select(F.explode(cut).alias("window"), "item").distinct()


def automaton_of(pairs: list[tuple[str, int | None]]):
    """Aho-Corasick automaton of (window, item): bytes as characters, values (words of the window, its items)."""
    import ahocorasick

    held: dict[str, list] = {}
    for window, item in pairs:
        items = held.setdefault(window, [])
        if item is not None:
            items.append(item)
    made = ahocorasick.Automaton()
    for window, items in held.items():
        made.add_word(f" {window} ".encode().decode("latin-1"), (window.count(" ") + 1, items))
    made.make_automaton()
    return made


def normalised(raw: bytes) -> np.ndarray:
    """The normalised bytes: a blank before each word, one at the end."""
    flat = np.frombuffer(b" %b " % raw.translate(NORMAL), np.uint8)
    keep = flat != _BLANK
    keep[:-1] |= keep[1:]
    keep[-1] = True
    return flat[keep]


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character and character after the last of each word in the text ``raw`` is the UTF-8 of."""
    inside = np.frombuffer(b" %b " % raw.translate(NORMAL), np.uint8) != _BLANK
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])
    return chars[turns[::2]], chars[turns[1::2]]


def scan(raw: bytes, automaton) -> tuple[int, int, list[int], list[dict]]:
    """(words, words inside matches, items, runs of such words) of one text."""
    flat = normalised(raw)
    blanks = np.flatnonzero(flat == _BLANK)
    count = len(blanks) - 1
    if automaton is None or count < 1:
        return max(count, 0), 0, [], []
    ends, lengths, items = [], [], set()
    for end, (length, named) in automaton.iter(flat.tobytes().decode("latin-1")):
        ends.append(end)
        lengths.append(length)
        items.update(named)
    if not ends:
        return count, 0, [], []
    stop = np.searchsorted(blanks, ends)
    depth = np.zeros(count + 2, np.int64)
    np.add.at(depth, stop - np.array(lengths) + 1, 1)
    np.add.at(depth, stop + 1, -1)
    turns = np.flatnonzero(np.diff(np.cumsum(depth) > 0))  # before the first word of a run, and at its last
    first, last = turns[::2], turns[1::2] - 1
    begins, ends_at = word_places(raw)
    spans = [dict(zip(("first", "last", "begin", "end"), map(int, s))) for s in zip(first, last, begins[first], ends_at[last])]
    return count, int((last - first + 1).sum()), sorted(items), spans


def _built(key: str, pairs):
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton_of(pairs.value) if pairs is not None else None
    return _BUILT[key]


def _scanned(docs: DataFrame, carried: str, kind: str, pairs) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built(key, pairs)
        for batch in slices(batches, "raw", 8 << 20):
            found = [scan(x.as_py() or b"", automaton) for x in batch.column(1)]
            columns = [pa.array(c, t.type) for c, t in zip(zip(*found), _FOUND)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[carried, *_FOUND.names])

    return docs.select(carried, "raw").mapInArrow(run, f"{carried} {kind}, {_COLUMNS}")


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_column: str = "doc_id",
                       text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
                       block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (ids of items with a window here, sorted), spans.

    ``spans`` are the maximal runs of words inside windows: numbers of the first and last word, and the characters of the
    original text from ``begin`` to before ``end``. Null and empty texts have no words; repeated rows have a row each; a
    null id passes through. An item without an id hits but is not listed; items that share an id are one item. Empty tables
    give no rows, or rows without hits. Very long texts are scanned whole, as arrays of bytes. Other columns are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "passages")
    windows = ws.table(item_windows(benchmark, width, item_column, item_text), "windows")
    size = windows.agg(F.sum(F.octet_length("window") + _TOLL)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_chars))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"),
                       F.col(f"`{text_column}`").cast("string").cast("binary").alias("raw"))

    def block(number: int):
        dealt = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == number)
        return spark.sparkContext.broadcast([tuple(r) for r in dealt.collect()]) if size else None

    if blocks == 1:
        return _scanned(rows, "id", "long", block(0))
    rows = ws.table(rows.withColumn("row", F.monotonically_increasing_id()), "texts", "zstd")
    found = None
    for number in range(blocks):
        pairs = block(number)
        hits = ws.table(_scanned(rows, "row", "long", pairs).where("n_hit > 0"), "hits")
        pairs.unpersist()
        found = hits if found is None else found.unionByName(hits)
    plain = ws.table(_scanned(rows, "row", "long", None).select("row", "n_words").join(rows.select("row", "id"), "row"), "plain")
    return plain.join(merged(found), "row", "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        *(F.coalesce(c, F.array().cast(merged(found).schema[c].dataType)).alias(c) for c in ("items", "spans")))


def merged(found: DataFrame) -> DataFrame:
    """(row, n_hit, items, spans) of the hits of all blocks: each item once, runs that touch or overlap made one."""
    each = found.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
                                    F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    joined = F.expr("""aggregate(slice(spans, 2, greatest(size(spans) - 1, 0)), slice(spans, 1, 1), (done, s) ->
        if(s.first <= element_at(done, -1).last + 1,
           concat(slice(done, 1, size(done) - 1), array(named_struct(
               'first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, s.last),
               'begin', element_at(done, -1).begin, 'end', greatest(element_at(done, -1).end, s.end)))),
           concat(done, array(s))))""")
    runs = each.select("row", F.array_sort("items").alias("items"), joined.alias("spans"))
    return runs.select("row", F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)").alias("n_hit"), "items", "spans")


def passages_sql(width: int = 10) -> str:
    """The result of the query over tables ``documents`` and ``benchmark`` as SQL."""
    words = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAPS}'), lambda w: w <> '')"
    after = ", ".join(f"lead(w, {k}) OVER t" for k in range(1, width))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
i AS (SELECT row_number() OVER () AS b, item_id, {words} AS words FROM benchmark),
du AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS k FROM d),
iu AS (SELECT b, item_id, unnest(words) AS w, generate_subscripts(words, 1) AS k, least(len(words), {width}) AS n, len(words) AS m FROM i),
dw AS (SELECT r, k, [w, {after}] AS ws, count(*) OVER (PARTITION BY r) AS m FROM du WINDOW t AS (PARTITION BY r ORDER BY k)),
iw AS (SELECT b, item_id, k, n, m, [w, {after}] AS ws FROM iu WINDOW t AS (PARTITION BY b ORDER BY k)),
g AS (SELECT DISTINCT item_id, n, array_to_string(ws[1:n], ' ') AS key FROM iw WHERE k + n - 1 <= m),
s AS (SELECT DISTINCT n FROM g),
h AS (SELECT r, k, n, array_to_string(ws[1:n], ' ') AS key FROM dw JOIN s ON k + n - 1 <= m),
f AS (SELECT r, k, h.n, item_id FROM h JOIN g ON h.n = g.n AND h.key = g.key),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS k FROM (SELECT DISTINCT r, k, n FROM f)) GROUP BY r),
e AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed
  FROM (SELECT DISTINCT r, item_id FROM f WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN e USING (r)"""
