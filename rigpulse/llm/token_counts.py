"""Tokens per document of flat token files that have no index, by a scan for the end-of-document id.

A file is cut into blocks that are scanned independently: a vectorised comparison finds the separators of a block. A
prefix scan over the block summaries of a file then tells each block how many documents end before it and where the
last of them ends, which joins documents that span blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rigpulse.llm.common import Workspace, slices
from rigpulse.llm.tokens import encoder
from rigpulse.llm.warc import place

END = 49407
BLOCK_BYTES = 4 << 20
FILE_BYTES = 64 << 20


def write_token_files(docs: DataFrame, ws: Workspace, path: str, end: int = END) -> tuple[DataFrame, DataFrame]:
    """(files (path, n_bytes), order (path, ordinal, doc_id)): ids of (doc_id, text) as 16-bit numbers, each document
    closed by ``end``.

    Null and empty texts are the end id alone; repeated rows are documents of their own. Files are named by the attempt
    that wrote them and only those returned count.
    """
    folder = ws.folder("tokens")
    close = np.array([end], "<u2").tobytes()
    schema = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ordinary=True)  # the separator occurs nowhere else
        system, base = place(folder)
        system.create_dir(base, recursive=True)
        out = None
        for batch in slices(batches, "text", 4 << 20):
            if out is None:
                name, size, count = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", 0, 0
                out = system.open_output_stream(f"{base}/{name}", compression=None)
            for text in batch.column(1):
                size += out.write(encode.ids(text.as_py() or "") + close)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * n), pa.nulls(n, pa.int64()),
                                              pa.array(np.arange(count, count + n)), batch.column(0)], schema=schema)
            count += n
            if size >= FILE_BYTES:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([f"{folder}/{name}"], [size], [None], [None]), schema)], schema=schema)
                out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([f"{folder}/{name}"], [size], [None], [None]), schema)], schema=schema)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = ws.table(chosen.mapInArrow(run, "path string, n_bytes long, ordinal long, doc_id long"), "manifest")
    return (told.where("n_bytes IS NOT NULL").select("path", "n_bytes"),
            told.where("ordinal IS NOT NULL").select("path", "ordinal", "doc_id"))


def count_tokens(files: DataFrame, ws: Workspace, end: int = END, id_bytes: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, start, n_tokens, closed): the documents of each file in order, without their separators.

    ``start`` counts ids from the beginning of the file. Ids after the last separator are a document that is not
    closed; an empty file has no document. A file whose size is no multiple of ``id_bytes`` fails the job.
    """
    kind = {2: "<u2", 4: "<u4"}[id_bytes]
    step = block_bytes // id_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, block in zip(*(c.to_pylist() for c in batch.columns)):
                if size % id_bytes:
                    raise ValueError(f"{path} ends inside an id")
                system, inner = place(path)
                with system.open_input_file(inner) as file:
                    file.seek(block * step * id_bytes)
                    ids = np.frombuffer(file.read(min(step * id_bytes, size - block * step * id_bytes)), kind)
                ends = np.flatnonzero(ids == end) + block * step
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block]), pa.array([size // id_bytes]),
                                                  pa.array([ends.tolist()], pa.list_(pa.int64()))], names=["path", "block", "size", "ends"])

    last = F.greatest(F.ceil(F.col("n_bytes") / (step * id_bytes)) - 1, F.lit(0)).cast("long")
    blocks = files.where("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    tasks = max(1, blocks.count())
    scanned = ws.table(blocks.select("path", "n_bytes", "block").repartition(min(tasks, 10_000)).mapInArrow(
        run, "path string, block long, size long, ends array<long>"), "blocks")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = scanned.select("path", "block", "size", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("tail"))
    carried = summary.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                             F.coalesce(F.last("tail", ignorenulls=True).over(earlier), F.lit(-1)).alias("tail"))
    closed = (scanned.where(F.size("ends") > 0).join(carried, ["path", "block"])
              .select("path", "before", "tail", "ends", F.posexplode("ends").alias("k", "stop"))
              .withColumn("start", F.when(F.col("k") > 0, F.element_at("ends", F.greatest("k", F.lit(1)))).otherwise(F.col("tail")) + 1)
              .select("path", (F.col("before") + F.col("k")).alias("ordinal"), "start", (F.col("stop") - F.col("start")).alias("n_tokens"),
                      F.lit(True).alias("closed")))
    rest = (summary.groupBy("path").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("tail"), F.lit(-1)) + 1).alias("start"), F.max("size").alias("size"))
            .where("start < size").select("path", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))
    return closed.union(rest)
