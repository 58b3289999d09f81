"""Token, packing and archive operators against plain versions and round trips."""

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rigpulse.llm import packing, sentence_pieces, token_counts, token_shards, tokens, warc
from rigpulse.llm.common import Workspace
from rigpulse.llm.token_shards import Feistel, ShardConfig

ODD = ["", "  ", "a.b c,d e,, f!?\n", "don't 's x's, y'll. IT'S", "<|endoftext|> A<|ENDOFTEXT|>, <|startoftext|>.",
       "É. ñ, x́, á. ﬁ, ①. 12.5, 3.\x1c z", "日本語, 。.  x.　y,\u0085z. ", "ΑΣ. Σ, İ, x", '"quote," said. (end.) ',
       "a\x00b. \x07, q.\x0bz", "   lead", "a▁b ▁▁ c", "<s> </s> <0x0A> <unk>", "a" * 500 + " " + " " * 70, "İ😀 x😀"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path(tokens.WORD_BPE))


@pytest.fixture(scope="module")
def ordinary():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokens.tokenizer_path(tokens.WORD_BPE))
    made.encode_special_tokens = True
    return made


def documents(spark):
    rows = [(k, t, 7, "s") for k, t in enumerate([*ODD, None, "word, and more words. " * 3000])]
    rows += [rows[2], (None, "no id here", 7, "s")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, length long, ids string")


def test_word_ids(plain):
    model = tokens.WordIds(tokens.tokenizer_path(tokens.WORD_BPE))
    for text in ODD:
        assert np.frombuffer(model.ids(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


@given(st.lists(st.text(alphabet="ab '.,!?Zé \n<|1́", max_size=30), max_size=4))
@settings(max_examples=60, deadline=None)
def test_word_ids_of_any_text(texts):
    model = tokens.encoder(tokens.tokenizer_path(tokens.WORD_BPE))
    for text in texts:
        assert np.frombuffer(model.ids(text), "<u2").tolist() == model.tokenizer.encode(text, add_special_tokens=False).ids


def test_piece_ids():
    import sentencepiece

    path = tokens.tokenizer_path(sentence_pieces.PIECES)
    plain, model = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.encoder(path)
    for text, ids in zip(ODD, model.encode(ODD)):
        found = np.frombuffer(ids, "<u2").tolist()
        assert found == plain.encode(text)
        assert model.decode(ids) == plain.decode(found)


def test_pieces_round_trip(spark):
    rows, docs = documents(spark)
    path = tokens.tokenizer_path(sentence_pieces.PIECES)
    back = sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(docs, path), path).collect()
    wanted = sorted((str(r[0]), (r[1] or "").replace("▁", " ")) for r in rows)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == wanted
    assert sentence_pieces.piece_digests(docs.limit(0), path).count() == 0


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=60, deadline=None)
def test_best_fit_takes_the_tightest_window(lengths):
    lengths = sorted(lengths, reverse=True)
    windows, offsets = packing.best_fit(lengths, 50)
    room = []
    for length, window, offset in zip(lengths, windows, offsets):
        fitting = [r for r in room if r >= length]
        if window == len(room):
            assert not fitting
            room.append(50)
        assert room[window] == min(fitting, default=50) and offset == 50 - room[window]
        room[window] -= length


def test_packing(spark, plain):
    rows, docs = documents(spark)
    pieces = packing.pack_documents(docs, tokens.tokenizer_path(tokens.WORD_BPE), 2, keep_ids=True)
    found = pieces.collect()
    ids = {str(r[0]): plain.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    total = sum(len(ids[str(r[0])]) for r in rows)
    assert sum(p["length"] for p in found) == total
    for p in found:
        own = ids[str(p["doc_id"])]
        part = own[p["start"]:p["start"] + p["length"]]
        assert len(part) == p["length"] and p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    packed = packing.sequences(pieces).collect()
    assert sum(s["n_ids"] for s in packed) == total and all(len(s["ids"]) == 8192 for s in packed)
    assert len(packed) <= -(-total // 4096) + 1
    assert packing.pack_documents(docs.limit(0), tokens.tokenizer_path(tokens.WORD_BPE), 2).count() == 0


@given(st.integers(1, 3000), st.integers(0, 5))
@settings(max_examples=40, deadline=None)
def test_feistel_permutes(size, key):
    order = Feistel(size, key, 4)
    slots = order.slots(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert (order.sequences(slots) == np.arange(size)).all()


def test_shards(spark, ordinary):
    rows, docs = documents(spark)
    config = ShardConfig(length=64, rows=16)
    ws = Workspace(spark, "test")
    manifest, total = token_shards.write_shards(docs, ws, tokens.tokenizer_path(tokens.WORD_BPE), config)
    key = lambda r: (r[0] is None, r[0] or 0)
    flat = np.array([i for r in sorted(rows, key=key) for i in ordinary.encode(r[1] or "", add_special_tokens=False).ids + [config.end]], "<u4")
    assert total == len(flat)
    for start in (0, 37):
        got = token_shards.read_shards(manifest, total, config, start).collect()
        assert sorted(r["slot"] for r in got) == list(range(start, -(-total // 64)))
        for r in got:
            part = flat[64 * r["sequence_id"]:64 * (r["sequence_id"] + 1)]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    empty, none = token_shards.write_shards(docs.limit(0), ws, tokens.tokenizer_path(tokens.WORD_BPE), config)
    assert none == 0 and token_shards.read_shards(empty, none, config).count() == 0


def test_token_counts(spark, ordinary, tmp_path):
    rows, docs = documents(spark)
    ws = Workspace(spark, "test")
    files, order = token_counts.write_token_files(docs, ws, tokens.tokenizer_path(tokens.WORD_BPE))
    wanted = sorted((str(r[0]), len(ordinary.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = token_counts.count_tokens(files, ws, block_bytes=64).join(order, ["path", "ordinal"])
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got.collect()) == wanted
    ids = np.array([5, 9, 9, 4, 4, 4, 4, 4, 9, 3, 3], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    table = spark.createDataFrame([(f"file://{tmp_path}/a.bin", 22), (f"file://{tmp_path}/b.bin", 0)], "path string, n_bytes long")
    for block in (2, 4, 6, 100):
        found = token_counts.count_tokens(table, ws, end=9, block_bytes=block).collect()
        assert sorted(tuple(r)[1:] for r in found) == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 5, True), (3, 9, 2, False)]
    assert token_counts.write_token_files(docs.limit(0), ws, tokens.tokenizer_path(tokens.WORD_BPE))[0].count() == 0


def test_archives(spark):
    long = "<p>é</p>" * 200
    rows = [(1, "http://a", long, "x"), (2, "http://b\r\nX: y", long, "x"), (3, None, None, "x"), (4, "u", "", "x"), (5, "u", "short", "x"),
            (6, "u", "short", "x"), (None, "n", long, "x"), (7, "u", "y" * 2_000_000, "x"), (2, "http://b\r\nX: y", long, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    ws = Workspace(spark, "test")
    got = warc.read_archives(warc.write_archives(warc.with_revisits(pages), ws), with_payload=True).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == sorted(
        [("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("3", "response", None), ("4", "response", None),
         ("5", "response", None), ("6", "response", None), ("7", "response", None), ("None", "revisit", 2)])
    for r in got:
        page = next((p for p in rows if p[0] == r["page_id"]))
        assert r["payload_bytes"] == len((page[2] or "").encode())
        if r["record_type"] == "response":
            assert r["payload"].decode() == (page[2] or "")
    assert warc.write_archives(warc.with_revisits(pages.limit(0)), ws).count() == 0


def test_damaged_archives():
    good = warc.page_record(1, "u", b"some payload", None) + warc.page_record(2, "u", b"", None)
    assert [r.payload for r in warc.records(io.BytesIO(good), True)] == [b"some payload", b""]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-5])))
    raw = zlib.decompress(warc.page_record(1, "u", b"some payload", None), 31)
    for broken in (raw.replace(b"some", b"same"), raw.replace(b"Content-Length: 12", b"Content-Length: 11"), raw[:-2]):
        with pytest.raises(ValueError):
            packer = zlib.compressobj(wbits=31)
            list(warc.records(io.BytesIO(packer.compress(broken) + packer.flush())))


def test_pieces_without_an_id_are_spread(spark):
    """Pieces of one id or of none fill groups of the wanted size, and every sequence stays gapless."""
    pieces = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"),
                                      (F.col("id") % 90 + 1).alias("length"))
    rows = packing.pack(pieces, 128, 500).withColumn("g", F.shiftright("sequence_id", packing._GROUP_BITS))
    sizes = [r["count"] for r in rows.groupBy("g").count().collect()]
    assert len(sizes) == 12 and sum(sizes) == 6000 and max(sizes) < 700
    filled = rows.groupBy("sequence_id").agg(F.sum("length").alias("total"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert filled.where("total <> end OR total > 128").count() == 0
