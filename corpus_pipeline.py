"""Documents to packed training sequences: quality, language, near duplicates, repeated passages, packing.

Every stage works on all rows that the stage before it kept and returns them with the columns of ``documents``; the
last one returns the packed pieces. Null and empty texts fall to the quality rules; repeated rows of one id count as
copies of it. Rows without an id cannot be named and so are never dropped as copies. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigpulse.llm import language_id, packing, quality_ledger, repeats, simhash, tokens
from rigpulse.llm.common import Workspace
from rigpulse.llm.queries import ready


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text"))
    verdicts = quality_ledger.apply_policy(quality_ledger.ledger(rows, keep=("_row",)))
    return verdicts.where("kept").select("_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language learned from those that have one."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text"))
    found = language_id.identify(rows, language_id.fit_languages(docs), carry=("_row",))
    return found.where("NOT rejected").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return simhash.keep_one(docs, simhash.simhash_groups(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long passages that an earlier one has; a text may become empty."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row"))
    made = repeats.remove_repeats(rows)
    columns = {c: F.col(f"_row.`{c}`") for c in others} | {"text": F.col("_kept")}
    if "n_chars" in columns:
        columns["n_chars"] = F.char_length("_kept").cast("long")
    return made.select(*(columns[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences."""
    return packing.pack_documents(docs, tokens.tokenizer_path(tokens.WORD_BPE), 2)


STAGES = [("quality_rules", quality), ("language_id", language), ("simhash_near_dedup", near_dedup),
          ("suffix_array_dedup", passages), ("packing", pack)]

#: The packing stage needs a tokenizer, which SQL has not; the tests check stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
