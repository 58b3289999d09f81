"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigpulse.llm import (
    decontamination, embedding_dedup, importance, language_id, packing, quality_ledger, repeats, sentence_pieces, simhash,
    source_divergence, token_counts, token_shards, tokens, warc)
from rigpulse.llm.common import Workspace
from rigpulse.session import ship_package, use_local_folder, use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def ready(spark: SparkSession) -> None:
    use_utc(spark)
    use_local_folder(spark)
    ship_package(spark)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         "component_id")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "quality")
    entries = ws.table(quality_ledger.ledger(table(spark, sf_dir, "documents")), "ledger")
    return quality_ledger.apply_policy(entries).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "failure_bits", F.lit(quality_ledger.CURRENT).alias("policy_version"))


ORACLES["op8_quality_rules"] = quality_ledger.verdict_sql()


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.tokenizer_path(tokens.WORD_BPE), 2)


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit_languages(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return made.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
                       F.col("_n_spans").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "warc")
    manifest = warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages")), ws)
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op4_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to FROM f"""


@query
def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "shards")
    path = tokens.tokenizer_path(tokens.WORD_BPE)
    manifest, total = token_shards.write_shards(table(spark, sf_dir, "documents"), ws, path)
    return token_shards.read_shards(manifest, total)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "counts")
    files, order = token_counts.write_token_files(table(spark, sf_dir, "documents"), ws, tokens.tokenizer_path(tokens.WORD_BPE))
    return token_counts.count_tokens(files, ws).join(order, ["path", "ordinal"]).select("doc_id", "n_tokens")


@query
def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_digests(table(spark, sf_dir, "documents"), tokens.tokenizer_path(sentence_pieces.PIECES))


@query
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.benchmark_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", named), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op11_benchmark_decontamination"] = decontamination.passages_sql()


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = source_divergence.audit_sql()


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_importance_resampling"] = importance.draw_sql()
