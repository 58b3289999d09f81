"""Fit once, score later: fitted tables under one version, published by a manifest.

A bundle holds the robust centre of every feature and machine, the limit of the scores of the training rows and, if wanted,
the isolation forest with its offsets. Its tables are written first; then a manifest that names them, their schemas and the
settings appears under the next number by a rename, so a reader sees a whole version or the one before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rigpulse.config import ForestConfig
from rigpulse.functions.quantiles import group_quantiles
from rigpulse.operators.forest import fit_isolation_forest, isolation_scores
from rigpulse.operators.scoring import reference_stats
from rigpulse.session import materialize


@dataclass(frozen=True)
class Bundle:
    version: int
    tables: dict[str, DataFrame]
    settings: dict


def _place(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the published versions, oldest first."""
    path, system = _place(spark, f"{folder}/manifests")
    if not system.exists(path):
        return []
    names = [f.getPath().getName() for f in system.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def save_bundle(spark: SparkSession, folder: str, tables: dict[str, DataFrame], settings: dict) -> int:
    """Write ``tables`` and publish them as the next version. A writer that loses a race for a number takes the next one."""
    root = f"{folder}/tables/{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{root}/{name}")
    text = json.dumps({"root": root, "settings": settings, "tables": {n: t.schema.json() for n, t in tables.items()}})
    draft, system = _place(spark, f"{folder}/manifests/_draft-{uuid.uuid4().hex}")
    system.mkdirs(draft.getParent())
    out = system.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    number = (versions(spark, folder) or [0])[-1] + 1
    while True:
        target, _ = _place(spark, f"{folder}/manifests/{number:08d}.json")
        if not system.exists(target) and system.rename(draft, target):
            return number
        number += 1


def load_bundle(spark: SparkSession, folder: str, version: int | None = None) -> Bundle:
    """A published version, the latest by default."""
    known = versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no version {version or ''} of a bundle in {folder}")
    number = version or known[-1]
    path, _ = _place(spark, f"{folder}/manifests/{number:08d}.json")
    held = json.loads("\n".join(r[0] for r in spark.read.text(path.toString(), wholetext=True).collect()))
    tables = {n: spark.read.schema(StructType.fromJson(json.loads(s))).parquet(f"{held['root']}/{n}")
              for n, s in held["tables"].items()}
    return Bundle(number, tables, held["settings"])


def fit_bundle(train: DataFrame, folder: str, keys: Sequence[str], columns: Sequence[str], prob: float = 0.995,
               floor: float = 1e-9, forest: ForestConfig | None = None, row_key: Sequence[str] = ()) -> int:
    """Fit on ``train`` and publish; gives the version."""
    spark = train.sparkSession
    settings = {"keys": list(keys), "columns": list(columns), "prob": prob, "forest": forest is not None}
    tables = {"stats": materialize(reference_stats(train, keys, columns, floor))}
    scored = materialize(robust_score(train.join(tables["stats"], list(keys)), columns).select(*keys, "score"))
    tables["limits"] = group_quantiles(scored, list(keys), {"limit": (F.col("score"), prob)})
    if forest:
        tables["forest"] = materialize(fit_isolation_forest(train, keys, columns, row_key, forest))
        raw = materialize(isolation_scores(train, tables["forest"], keys, columns, row_key, forest, "_raw"))
        tables["offsets"] = group_quantiles(raw, list(keys), {"offset": (F.col("_raw"), 1.0 - forest.contamination)})
    return save_bundle(spark, folder, tables, settings)


def robust_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``score``: mean of the largest robust deviations, a tenth of the features but at least three.

    ``df`` carries the centres of its machine. A missing value does not deviate.
    """
    k = max(3, int(0.1 * len(columns)))
    away = [F.coalesce(F.abs(F.col(c) - F.col(f"{c}_ref_median")) / F.col(f"{c}_ref_mad"), F.lit(0.0)) for c in columns]
    top = F.slice(F.sort_array(F.array(*away), asc=False), 1, k)
    return df.withColumn("score", F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / min(k, len(columns)))


def score_bundle(df: DataFrame, bundle: Bundle, row_key: Sequence[str] = (), forest: ForestConfig | None = None) -> DataFrame:
    """``df`` (a table or a stream) with score and limit of its machine; rows of unknown machines have nulls.

    With a forest in the bundle, and for tables only, also ``anomaly_score_if``.
    """
    keys, columns = bundle.settings["keys"], bundle.settings["columns"]
    known = df.join(bundle.tables["stats"], keys, "left").join(bundle.tables["limits"], keys, "left")
    scored = robust_score(known, columns)
    found = scored.select(*df.columns, F.when(F.col("limit").isNotNull(), F.col("score")).alias("score"), "limit")
    if not bundle.settings["forest"] or df.isStreaming:
        return found
    raw = isolation_scores(found, bundle.tables["forest"], keys, columns, row_key, forest or ForestConfig(), "_raw")
    return (raw.join(bundle.tables["offsets"], keys, "left")
            .select(*found.columns, (F.col("_raw") - F.col("offset")).alias("anomaly_score_if")))
