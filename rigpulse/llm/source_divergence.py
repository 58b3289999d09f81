r"""How the sources of a language differ in their words: exact smoothed shares, all pairs of sources, telling terms.

Terms are runs of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]`` with A-Z in lower case. CountVectorizer learns the vocabulary (all terms in
at least ``min_docs`` documents, no other limit) and turns each document into an exact sparse vector. A term carries its
language in front, so one fit serves any number of languages and every language still has a vocabulary of its own. As a
fit brings its vocabulary to the driver, terms are dealt by hash into so many blocks that a block's vocabulary stays below
``vocabulary_block``, with one fit for each; blocks share no term, so their counts are simply put together. How many terms
will be kept is told from those of one hash class in ``_CLASSES``, each counted over all documents; a block that turns out
larger fails the job. One block is the rule.

The vectors are summed by (language, source, term), with map-side combine. The sums stay sparse: the distance of two sources
is that of two empty sources, plus what each source's own terms change against an empty partner (summed over distinct
shares), plus a correction for the terms that both have (an equality join on the term).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rigpulse.llm.common import Workspace, slices

#: Each byte as it is compared: A-Z in lower case, what is in no term as a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Between a language and a term; no term holds it.
_MARK = "\0"
#: Share of an event in billionths.
_SCALE = 1_000_000_000
#: Hash classes of terms, one of which foretells the size of the vocabulary.
_CLASSES = 64


@dataclass(frozen=True)
class AuditConfig:
    min_docs: int = 30
    smoothing: int = 5
    top_terms: int = 50
    #: Kept terms of one fit: what the driver may hold and broadcast.
    vocabulary_block: int = 1_000_000


def term_lists(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, terms) of each row, repeats included, each term behind its language; nulls count as ''."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "raw", 4 << 20):
            data, sizes, ends = [], [], [0]
            for name, raw in zip(batch.column(0), batch.column(2)):
                front = (name.as_py() + _MARK).encode()
                found = raw.as_py().translate(LETTERS).split()
                if found:
                    data.append(front + front.join(found))
                    sizes.append(np.fromiter(map(len, found), np.int64, len(found)) + len(front))
                ends.append(ends[-1] + len(found))
            places = np.concatenate([[0], np.cumsum(np.concatenate(sizes))] if sizes else [[0]])
            flat = pa.LargeStringArray.from_buffers(ends[-1], pa.py_buffer(places.astype("<i8")), pa.py_buffer(b"".join(data)))
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["lang", "source", "terms"])

    def plain(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    chosen = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).cast("binary").alias("raw"))
    return chosen.mapInArrow(run, "lang string, source string, terms array<string>")


def block_count(rows: DataFrame, config: AuditConfig) -> int:
    """Blocks of terms so that no vocabulary is expected above its bound, by four deviations and some."""
    cells = rows.select(F.monotonically_increasing_id().alias("row"), F.explode("terms").alias("term"))
    one = cells.where(F.pmod(F.xxhash64("term", F.lit(1)), F.lit(_CLASSES)) == 0).distinct()
    seen = one.groupBy("term").agg(F.count("*").alias("docs"))
    kept = seen.where(F.col("docs") >= config.min_docs).count()
    return max(1, math.ceil(1.25 * _CLASSES * (kept + 4 * math.sqrt(kept) + 8) / config.vocabulary_block))


def kept_counts(ws: Workspace, rows: DataFrame, groups: DataFrame, config: AuditConfig) -> tuple[DataFrame, DataFrame]:
    """((lang, source, term, n > 0), (lang, v)): sums of the documents' vectors, and the sizes of the vocabularies.

    ``groups`` numbers the (lang, source), so that the sums are made under short keys.
    """
    spark = rows.sparkSession
    blocks = block_count(rows, config)
    sums = sizes = None
    for number in range(blocks):
        mine = F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(blocks)) == number) if blocks > 1 else F.col("terms")
        part = rows.select("lang", "source", mine.alias("terms"))
        # a mark without language and term in enough rows, so that a block without kept terms has a vocabulary too
        marks = spark.range(config.min_docs).select(F.array(F.lit(_MARK)).alias("terms"))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(config.min_docs),
                                vocabSize=2 ** 31 - 1).fit(part.select("terms").union(marks))
        if len(model.vocabulary) > config.vocabulary_block:
            raise ValueError(f"a block of {len(model.vocabulary)} terms; the bound is {config.vocabulary_block}")
        vocabulary = spark.createDataFrame([(k, *name.rpartition(_MARK)[::2]) for k, name in enumerate(model.vocabulary)
                                            if name != _MARK], "index int, lang string, term string")
        vector = F.unwrap_udt("vector")
        numbered = part.join(groups, ["lang", "source"]).select("group", "terms")
        cells = model.transform(numbered).select("group", vector["values"].alias("values"), F.posexplode(vector["indices"]).alias("at", "index"))
        totals = (cells.select("group", "index", F.col("values")[F.col("at")].cast("long").alias("n"))
                  .groupBy("group", "index").agg(F.sum("n").alias("n")))
        named = ws.table(totals.join(vocabulary.drop("lang"), "index").join(groups, "group").select("lang", "source", "term", "n"), "sums")
        held = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
        sums = named if sums is None else sums.union(named)
        sizes = held if sizes is None else sizes.union(held)
    return sums, ws.table(sizes.groupBy("lang").agg(F.sum("v").alias("v")), "sizes")


def share(n: Column, total: Column, v: Column, smoothing: int) -> Column:
    """Smoothed share in billionths, rounded down, plus 1; the quotient of whole numbers is exact."""
    over = F.lit(_SCALE).cast("decimal(10,0)") * (n + smoothing).cast("decimal(20,0)")
    under = (total + F.lit(smoothing) * v).cast("decimal(20,0)")
    return F.call_function("div", over, under) + F.lit(1).cast("long")


def audit(docs: DataFrame, config: AuditConfig = AuditConfig(), lang: str = "lang", source: str = "source",
          text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others, and by which terms.

    Part ``pair``: every other source of the language with the sum of the absolute differences of the shares of all kept
    terms (0 without any), ranked by value descending, then name. Part ``term``: the first ``top_terms`` terms that the source
    has, with a larger share than in the whole language, and by how much. Null text, language and source are ''; documents
    without terms still make a group; repeated rows count each time; an empty table gives no rows; very long texts are
    one row of terms. Other columns are not read. The rows of part ``pair`` are as many as ordered pairs of sources.
    """
    ws = Workspace(docs.sparkSession, "audit")
    rows = ws.table(term_lists(docs, lang, source, text), "terms", "zstd")
    groups = ws.table(rows.select("lang", "source").distinct().withColumn("group", F.monotonically_increasing_id()), "groups")
    counts, sizes = kept_counts(ws, rows, groups, config)
    ws.drop(rows)
    k = config.smoothing
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    zero = F.lit(0).cast("long")
    known = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "used", "v")))
    known = ws.table(known.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("total"), F.col("v"), k))), "known")
    shares = ws.table(counts.join(known, ["lang", "source"]).select(
        "lang", "source", "term", "n", "p0", share(F.col("n"), F.col("total"), F.col("v"), k).alias("p")), "shares")
    return pairs(known, shares).union(terms(known, shares, config))


def pairs(known: DataFrame, shares: DataFrame) -> DataFrame:
    """Part ``pair`` from (lang, source, total, used, v, p0) and (lang, source, term, p, p0)."""
    names = ["lang", "a", "b"]
    here = known.select("lang", F.col("source").alias("a"), F.col("used").alias("ua"), "v", F.col("p0").alias("pa"))
    there = known.select("lang", F.col("source").alias("b"), F.col("used").alias("ub"), F.col("p0").alias("pb"))
    couples = here.join(there, "lang").where("a <> b")
    # a source's terms against an empty partner: one row for each distinct share
    levels = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("times"))
    alone = (levels.join(there.select("lang", "b", "pb"), "lang").where("a <> b").groupBy(*names)
             .agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("pb"))).alias("alone")))
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("x"), F.col("p0").alias("x0"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("y"), F.col("p0").alias("y0"))
    x, x0, y, y0 = (F.col(c) for c in ("x", "x0", "y", "y0"))
    both = (left.join(right, ["lang", "term"]).where("a < b").groupBy(*names).agg(
        F.sum(F.abs(x - y) - F.abs(x - y0) - F.abs(y - x0) + F.abs(x0 - y0)).alias("shared")))
    both = both.union(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    turned = alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("turned"))
    zero = F.lit(0).cast("long")
    empty = (F.col("v") - F.col("ua") - F.col("ub")) * F.abs(F.col("pa") - F.col("pb"))
    value = sum((F.coalesce(c, zero) for c in (F.col("alone"), F.col("turned"), F.col("shared"))), F.coalesce(empty, zero))
    summed = couples.join(alone, names, "left").join(turned, names, "left").join(both, names, "left").select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.select("*", F.row_number().over(order).alias("rank"))


def terms(known: DataFrame, shares: DataFrame, config: AuditConfig) -> DataFrame:
    """Part ``term``; each task sends on at most ``top_terms`` rows of a source."""
    whole = known.groupBy("lang").agg(F.sum("total").alias("all"), F.max("v").alias("v"))
    overall = (shares.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(whole, "lang")
               .select("lang", "term", share(F.col("n"), F.col("all"), F.col("v"), config.smoothing).alias("q")))
    told = shares.join(overall, ["lang", "term"]).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return told.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= config.top_terms)


def audit_sql(config: AuditConfig = AuditConfig()) -> str:
    """The audit of table ``documents`` as SQL, with every kept term in every group."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = (rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), "
             r"'[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')")
    p = f"1 + CAST({_SCALE}::HUGEINT * (n + {config.smoothing}) // (total + {config.smoothing} * v) AS BIGINT)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {words} AS words FROM documents),
u AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= {config.min_docs}),
z AS (SELECT lang, count(*) AS v FROM k GROUP BY lang), s AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM u JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT lang, source, term, coalesce(c, 0) AS n FROM s JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
t AS (SELECT lang, source, sum(n) AS total FROM f GROUP BY ALL),
g AS (SELECT lang, source, term, n, {p} AS p FROM f JOIN t USING (lang, source) JOIN z USING (lang)),
fq AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL), tq AS (SELECT lang, sum(n) AS total FROM f GROUP BY lang),
q AS (SELECT lang, term, {p} AS q FROM fq JOIN tq USING (lang) JOIN z USING (lang)),
b AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.term = y.term
  AND x.source <> y.source GROUP BY ALL),
e AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(b.value, 0) AS BIGINT) AS value FROM s x JOIN s y
  ON x.lang = y.lang AND x.source <> y.source LEFT JOIN b ON b.lang = x.lang AND b.source = x.source AND b.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM g JOIN q USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= {config.top_terms}"""
