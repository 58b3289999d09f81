"""Language identification by the nearest centroid of normalised TF-IDF vectors of letter n-grams.

A text is lower-cased, every run of other characters than letters becomes one blank, and its n-grams of one to three
characters are counted in ``BUCKETS`` hash buckets. Document frequencies are counted over all training rows. Each
language gets several centroids by spherical k-means over a sample of its training rows (``sample_rows``, a
documented bound of the fit, drawn by a hash of the id). A text takes the language of the centroid with the largest
cosine; it is rejected as too distant from every language where that cosine is below the language's limit.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigpulse.llm.common import Workspace, slices

BUCKETS = 4096
UNKNOWN = "und"
#: Languages that a model may hold, so that its size (this times clusters times 16 KB) is bounded.
MOST_LANGUAGES = 512
#: Rows vectorised together, and characters of a text counted at a time.
_ROWS, _CHARS = 128, 1 << 20


@dataclass(frozen=True)
class LanguageConfig:
    clusters: int = 4
    sample_rows: int = 1000
    rounds: int = 12
    #: A text is rejected below this share of the cosine that 99 % of the sampled rows of its language exceed.
    limit_share: float = 0.6
    seed: int = 7


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owners: np.ndarray
    limits: np.ndarray


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of the first plane: which code points are letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(1 << 16)), bool, 1 << 16)


def gram_counts(text: str) -> tuple[np.ndarray, bool]:
    """Counts of the n-grams by bucket, and whether the text has a letter."""
    counts, letters, before = np.zeros(BUCKETS, np.int64), False, np.zeros(1, np.uint64)
    for at in range(0, len(text), _CHARS):
        codes = np.frombuffer(text[at:at + _CHARS].lower().encode("utf-32-le", "replace"), "<u4")
        low = codes < 1 << 16
        letter = np.where(low, _letters()[np.where(low, codes, 0)], True)
        if not low.all():
            letter[~low] = [chr(c).isalpha() for c in codes[~low]]
        letters |= bool(letter.any())
        own = np.where(letter, codes, 0).astype(np.uint64)
        x = np.concatenate([before, own])
        x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
        pair = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        triple = pair[:-1] * np.uint64(0x165667B19E3779F9) + x[2:] * np.uint64(0xD6E8FEB86659FD93)
        for grams in (x[1:] * np.uint64(0xFF51AFD7ED558CCD), pair, triple):
            counts += np.bincount((_mixed(grams) >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
        before = x[-2:]
    return counts, letters


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in slices(batches, "text", 4 << 20):
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            found = [gram_counts(x.as_py() or "") for x in part.column(part.schema.get_field_index("text"))]
            yield part, np.stack([c for c, _ in found]), np.array([has for _, has in found], bool)


def held_out(id_column: str = "doc_id") -> Column:
    """Every fifth id by its CRC is kept from the fit; a null id is neither held out nor learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_column}`").cast("string")), F.lit(5)) == 0, F.lit(False))


def fit_languages(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Learn from (doc_id, text, lang): rows with a language and an id that is not held out; the rest is ignored.

    Without any such row the model knows no language.
    """
    ws = Workspace(docs.sparkSession, "languages")
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = tuple(sorted(sizes))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for _, counts, _ in _counted(batches):
            seen += (counts > 0).sum(0)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], names=["bucket", "n"])

    frequency = np.zeros(BUCKETS)
    for bucket, n in (known.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket")
                      .agg(F.sum("n").alias("n")).collect()):
        frequency[bucket] = n
    idf = (np.log((1 + sum(sizes.values())) / (1 + frequency)) + 1).astype(np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts, has in _counted(batches):
            rows = [x.tobytes() for x in _weighted(counts, idf)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())],
                                             names=["doc_id", "lang", "x"]).filter(pa.array(has))

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float32).reshape(-1, BUCKETS)
        centers, limit = spherical_means(x, config)
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(centers)),
                         "center": pa.array([c.tobytes() for c in centers], pa.binary()),
                         "limit": pa.array([limit] * len(centers), pa.float64())})

    share = F.create_map(*(F.lit(v) for name in names for v in (name, min(1.0, config.sample_rows / sizes[name])))) if names else None
    rows = []
    if names:
        draw = F.pmod(F.xxhash64("doc_id", F.lit(config.seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        sample = ws.table(known.where(draw < share[F.col("lang")]).mapInArrow(vectors, "doc_id long, lang string, x binary"), "sample")
        rows = sorted(sample.groupBy("lang").applyInArrow(cluster, "lang string, center binary, limit double").collect())
        ws.drop(sample)
    learned = tuple(sorted({r["lang"] for r in rows}))
    centroids = np.stack([np.frombuffer(r["center"], np.float32) for r in rows]) if rows else np.zeros((0, BUCKETS), np.float32)
    return LanguageModel(learned, idf, centroids, np.array([learned.index(r["lang"]) for r in rows], np.int64),
                         np.array([r["limit"] for r in rows]))


def spherical_means(x: np.ndarray, config: LanguageConfig) -> tuple[np.ndarray, float]:
    """Centroids of unit rows by cosine, begun at the mean and the rows farthest from those taken; the cosine limit."""
    mean = x.mean(0)
    centers = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(centers) < min(config.clusters, len(x)):
        centers.append(x[(x @ np.stack(centers).T).max(1).argmin()])
    centers = np.stack(centers)
    for _ in range(config.rounds):
        own = (x @ centers.T).argmax(1)
        sums = np.stack([x[own == k].sum(0) if (own == k).any() else centers[k] for k in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    best = np.sort((x @ centers.T).max(1))
    return centers.astype(np.float32), float(best[len(best) // 100]) * config.limit_share


def identify(docs: DataFrame, model: LanguageModel, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry``, then lang_pred, score and rejected of each row's whole text.

    Null, empty and letterless texts, and all texts if the model is empty, are ``und`` with score 0 and rejected. Ties
    go to the first language by name. Other columns than text and ``carry`` are not read.
    """
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts, has in _counted(batches):
            if len(model.languages):
                cosines = _weighted(counts, model.idf) @ model.centroids.T
                best = cosines.argmax(1)
                score = np.where(has, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0).astype(float)
                far = ~has | (score < model.limits[best])
                named = [model.languages[model.owners[b]] if ok else UNKNOWN for b, ok in zip(best, has)]
            else:
                named, score, far = [UNKNOWN] * len(has), np.zeros(len(has)), np.ones(len(has), bool)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:width], pa.array(named, pa.string()), pa.array(score), pa.array(far)],
                names=[*(f"c{k}" for k in range(width)), "lang_pred", "score", "rejected"])

    chosen = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)),
                         F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"c{k} {chosen.schema[k].dataType.simpleString()}" for k in range(width))
    made = chosen.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")
    return made.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(carry)), "lang_pred", "score", "rejected")
