"""Quality ledger, language identification and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rigpulse.llm import language_id, quality_ledger, queries

DATA = "/root/testdata/sf0.001"
ROWS = [(0, "one two three " * 30, "en", "s", 1), (1, None, None, "s", 1), (2, "", "en", "s", 1), (3, "a\nb\n\nb\n \nb c d e\x0bf" + " word" * 60, "en", "s", 1),
        (3, "a\nb\n\nb\n \nb c d e\x0bf" + " word" * 60, "en", "s", 1), (None, "# | | |", "fr", "s", 1), (5, " ".join(f"w{k}" for k in range(30_000)), "en", "s", 1),
        (6, "é ü 😀 x " * 20, "fr", "s", 1), (7, "a b c a b c a b", "en", "s", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_words long"


def test_ledger_is_its_sql(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = quality_ledger.apply_policy(quality_ledger.ledger(docs))
    con = duckdb.connect(config={"memory_limit": "2GB"})
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in ROWS])
    names = [c for c in got.columns]
    wanted = con.execute(f"SELECT {', '.join(names)} FROM ({quality_ledger.verdict_sql()})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, wanted))
    assert quality_ledger.ledger(docs.limit(0)).count() == 0


def test_ablations_agree_with_rows(spark):
    ledger = quality_ledger.ledger(spark.createDataFrame(ROWS, SCHEMA))
    bits = [r["failure_bits"] for r in ledger.collect()]
    for row in quality_ledger.ablations(ledger).collect():
        mask = quality_ledger.POLICIES[row["version"]]
        bit = quality_ledger.mask_of(row["rule"])
        assert (row["failing"], row["rejected_alone"], row["kept"], row["kept_without"]) == (
            sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits), sum(b & mask == 0 for b in bits),
            sum(b & mask & ~bit == 0 for b in bits))


def test_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = queries.QUERIES["op10_language_id"](spark, DATA)
    rows = made.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 20
    model = language_id.fit_languages(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (None, "the"), (5, "漢字仮名"), (5, "漢字仮名"), (6, "é" * 3_000_000)], "doc_id long, text string")
    got = language_id.identify(odd, model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True) for r in got if r["doc_id"] in (1, 2, 3))
    assert all(r["rejected"] and r["lang_pred"] != "und" for r in got if r["doc_id"] == 5)
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_no_language_to_learn(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("lang", F.lit(None).cast("string"))
    found = language_id.identify(docs, language_id.fit_languages(docs)).collect()
    assert {r["lang_pred"] for r in found} == {"und"}


@pytest.mark.parametrize("extra", [False, True])
def test_pipeline_stages(spark, extra):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    if extra:
        odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
        docs = docs.union(odd).withColumn("fp", F.lit(1)).withColumn("_text", F.lit("x")).withColumn("failure_bits", F.lit(0))
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, DATA)
        if name != "packing":
            assert found.columns == docs.columns
            assert 0.6 * seen < found.count() <= seen
            docs = queries.Workspace(spark, "test").table(found, name)
            seen = docs.count()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in found.select("doc_id").collect()} == ids


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
