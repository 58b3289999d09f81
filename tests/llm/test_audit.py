"""Decontamination, divergence audit and importance resampling against plain versions, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rigpulse.llm import decontamination, importance, queries, source_divergence
from rigpulse.llm.common import Workspace

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, id long, raw string, row long, n_words long, items string"
VOCAB = [f"Wörd{k}" for k in range(30)] + [f"w{k}x" for k in range(60)] + ["ÉTÉ", "日本", "😀", "áb"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts(seed, n, most=120):
    draw = random.Random(seed)
    marks = [" ", "  ", "\n", ", ", "-", "\x00", "\u007f", "\t"]
    made = ["".join(draw.choice(VOCAB) + draw.choice(marks) for _ in range(draw.randint(0, most))) for _ in range(n)]
    return made + ["", None, "...", "w1x", " w1x w2x", "日本日本", made[0], made[0]]


def frame(spark, made, langs=("en", "fr", None, ""), sources=("s1", "s2", "s3", None)):
    rows = [(k, t, langs[k % len(langs)], sources[k // 4 % len(sources)], 1, "r", 2, 3, "i") for k, t in enumerate(made)]
    rows += [rows[3], rows[3], (None, rows[2][1], "en", "s1", 1, "r", 2, 3, "i"), (None, None, None, None, 1, "r", 2, 3, "i")]
    return spark.createDataFrame(rows, SCHEMA), rows


def items_of(made, seed=4):
    draw = random.Random(seed)
    found = []
    for k in range(25):
        words = WORD.findall(made[draw.randrange(30)] or "")
        at, size = draw.randrange(max(1, len(words) - 5)), draw.choice([1, 3, 9, 10, 11, 30])
        found.append((k % 20, " ".join(words[at:at + size]).upper() if k % 3 else "\n".join(words[at:at + size])))
    return found + [(90, None), (91, "... !"), (None, " ".join(WORD.findall(made[1])[:12])), (92, "nowhere at all"), (93, found[1][1])]


def plain_passages(text, items, width=10):
    """(words, hit words, items, runs as (first, last, begin, end)) by trying every window at every word."""
    text = lower(text)
    places = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b] for a, b in places]
    hit, named = set(), set()
    for item, content in items:
        other = WORD.findall(lower(content))
        n = min(len(other), width)
        wanted = {tuple(other[k:k + n]) for k in range(len(other) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k:k + n]) in wanted:
                hit.update(range(k, k + n))
                named.add(item)
    runs = [k for k in sorted(hit) if k - 1 not in hit]
    spans = []
    for first in runs:
        last = first
        while last + 1 in hit:
            last += 1
        spans.append((first, last, places[first][0], places[last][1]))
    return len(words), len(hit), sorted(i for i in named if i is not None), spans


@pytest.mark.parametrize("block_chars", [decontamination.BLOCK_CHARS, 1500])
def test_passages_are_brute_force(spark, block_chars):
    made = texts(1, 60)
    made.append(" ".join(random.Random(9).choices(VOCAB, k=60_000)) + " " + made[0])
    docs, rows = frame(spark, made)
    items = items_of(made)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = decontamination.benchmark_passages(docs, benchmark, block_chars=block_chars).collect()
    got = sorted(str((r["id"], r["n_words"], r["n_hit"], list(r["items"]), [tuple(s) for s in r["spans"]])) for r in found)
    assert got == sorted(str((r[0], *plain_passages(r[1], items))) for r in rows)
    assert sum(r["n_hit"] > 0 for r in found) > 10


def test_passages_of_nothing(spark):
    docs, rows = frame(spark, texts(2, 5))
    benchmark = spark.createDataFrame([(1, "w1x")], "item_id long, text string")
    assert decontamination.benchmark_passages(docs.limit(0), benchmark).count() == 0
    found = decontamination.benchmark_passages(docs, benchmark.limit(0)).collect()
    assert len(found) == len(rows) and all(r["n_hit"] == 0 and r["items"] == [] and r["spans"] == [] for r in found)


def test_one_word_without_end(spark):
    text = "x" * 5_000_000
    docs = spark.createDataFrame([(1, text), (2, "a " * 2_000_000)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a a a"), (2, "xxx")], "item_id long, text string")
    found = {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.benchmark_passages(docs, benchmark).collect()}
    assert found == {1: (1, 0, []), 2: (2_000_000, 2_000_000, [1])}


def plain_audit(rows, config):
    docs = [((r[2] or ""), (r[3] or ""), TERM.findall(lower(r[1]))) for r in rows]
    df = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= config.min_docs:
            kept[lang].append(t)
    groups = defaultdict(Counter)
    for lang, source, terms in docs:
        groups[lang, source].update(t for t in terms if t in kept[lang])
    share = lambda c, lang: {t: 1 + 10 ** 9 * (c[t] + config.smoothing) // (sum(c.values()) + config.smoothing * len(kept[lang]))
                             for t in kept[lang]}
    out = []
    for (lang, source), c in groups.items():
        p, whole = share(c, lang), sum((g for (x, _), g in groups.items() if x == lang), Counter())
        q = share(whole, lang)
        others = [(sum(abs(p[t] - o[t]) for t in p), s) for (x, s), g in groups.items() if x == lang and s != source
                  for o in [share(g, lang)]]
        told = [(p[t] - q[t], t) for t in p if c[t] and p[t] > q[t]]
        for part, values, most in (("pair", others, None), ("term", told, config.top_terms)):
            ordered = sorted(values, key=lambda v: (-v[0], v[1].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)]
    return sorted(out)


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_audit_is_brute_force(spark, block):
    docs, rows = frame(spark, texts(3, 400, 40) + ["w1x " * 20_000, "x" * 1_000_000], ("en", "fr", None, "x\0y", "bare"), ("s1", "s2", "s3", None, "s4"))
    rows += [(1000, "12 !", "empty", "s", 1, "r", 2, 3, "i"), (1001, None, "empty", "t", 1, "r", 2, 3, "i")]
    docs = spark.createDataFrame(rows, SCHEMA)
    config = source_divergence.AuditConfig(min_docs=30, top_terms=7, vocabulary_block=block)
    got = sorted(map(tuple, source_divergence.audit(docs, config).collect()))
    assert got == plain_audit(rows, config)
    assert {r[2] for r in got} == {"pair", "term"} and ("empty", "s", "pair", "t", 0, 1) in got


def test_audit_without_terms_or_rows(spark):
    docs, _ = frame(spark, texts(3, 5))
    assert source_divergence.audit(docs.limit(0)).count() == 0
    few = source_divergence.audit(docs).collect()  # no term is in 30 documents
    assert few and all(r["part"] == "pair" and r["value"] == 0 for r in few)


def test_shares_are_exact(spark):
    draw = random.Random(6)
    cells = [(draw.randrange(10 ** 13), draw.randrange(10 ** 13, 10 ** 15), draw.randrange(1, 10 ** 9)) for _ in range(300)]
    df = spark.createDataFrame(cells, "n long, total long, v long")
    got = df.select("n", "total", "v", source_divergence.share(F.col("n"), F.col("total"), F.col("v"), 5).alias("p")).collect()
    assert all(r["p"] == 1 + 10 ** 9 * (r["n"] + 5) // (r["total"] + 5 * r["v"]) for r in got)


def plain_draw(rows, target, config):
    def features(text):
        words = [w.encode() for w in WORD.findall(lower(text))]
        runs = [b" ".join(words[k:k + n]) for n in range(1, config.orders + 1) for k in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(f) % config.buckets for f in runs]

    docs = [(r[0], *features(r[1])) for r in rows]
    s, t = (Counter(b for _, f in part for b in f) for part in ([d[1:] for d in docs], [features(x) for x in target]))
    size = config.buckets
    ds, dt = s.total() + size, t.total() + size
    made = []
    for doc, n_words, found in docs:
        gain = [math.floor(1000 * math.log((t[b] + 1) * ds / ((s[b] + 1) * dt))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{config.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        made.append((doc, len(gain), weight, score, n_words))
    able = sorted((m for m in made if m[4] >= config.min_words), key=lambda m: (-m[3], m[0] is None, m[0] or 0, m[1]))
    ranks = defaultdict(list)
    for k, m in enumerate(able):
        ranks[m].append(k + 1 if k < config.percent * len(able) // 100 else None)
    return sorted(str((*m[:4], ranks[m].pop() if ranks[m] else None)) for m in made)


@pytest.mark.parametrize("changes", [{}, {"orders": 3, "buckets": 97}, {"percent": 100}, {"percent": 63, "min_words": 1}, {"percent": 0}])
def test_draw_is_brute_force(spark, changes):
    config = replace(importance.DrawConfig(), **changes)
    made = texts(5, 150) + [" ".join(random.Random(1).choices(VOCAB, k=200_000))]
    _, rows = frame(spark, made)
    rows += [rows[7]] * 60 + [(None, rows[9][1], None, None, 1, "r", 2, 3, "i")] * 40
    docs = spark.createDataFrame(rows, SCHEMA)
    target = texts(6, 20) + [made[4]]
    got = importance.draw(docs, spark.createDataFrame([(t,) for t in target], "text string"), config).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_draw(rows, target, config)


def test_draw_of_nothing(spark):
    docs, rows = frame(spark, texts(5, 30))
    target = spark.createDataFrame([("w1x",)], "text string")
    assert importance.draw(docs.limit(0), target).count() == 0
    got = importance.draw(docs, target.limit(0)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_draw(rows, [], importance.DrawConfig())


def test_cutoffs(spark):
    draw = random.Random(8)
    values = [draw.choice([3, -5, 10 ** 12, draw.randrange(-10 ** 6, 10 ** 6)]) for _ in range(500)] + [None] * 7
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(v for v in values if v is not None)
    for wanted in (1, 17, 250, 500):
        assert importance.smallest_with(df, F.col("v"), wanted) == ordered[wanted - 1]
    assert importance.smallest_with(df, F.col("v"), 501) is None


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(int(v),) for v in np.random.default_rng(1).integers(0, 50, 3000)], "v long")
    found = importance.number(Workspace(spark, "test"), rows, [F.col("v").desc()]).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 3001))
    assert [r["v"] for r in sorted(found, key=lambda r: r["rank"])] == sorted((r["v"] for r in found), reverse=True)


@pytest.mark.parametrize("name", ["op11_benchmark_decontamination", "op12_source_divergence", "op13_importance_resampling"])
def test_queries_are_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect(config={"memory_limit": "2GB"})
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    made = queries.QUERIES[name](spark, folder)
    wanted = con.execute(f"SELECT {', '.join(made.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, wanted))
