"""Near-duplicate and repeat operators against brute force, with odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rigpulse.llm import embedding_dedup, repeats, simhash

WORDS = [f"w{k}" for k in range(400)]
DOCS = "doc_id long, text string, id long, fp string, _text string"


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def texts(seed=3):
    """Copies, near copies, shared passages, short, empty, null and very long texts."""
    draw = random.Random(seed)
    base = [" ".join(draw.choices(WORDS, k=draw.randint(60, 200))) for _ in range(12)]
    made = list(base)
    for text in base[:6]:
        words = text.split()
        for _ in range(4):
            words[draw.randrange(len(words))] = draw.choice(WORDS)
            made.append(" ".join(words))
    passage = " ".join(draw.choices(WORDS, k=30))
    made += [f"{draw.choice(WORDS)} {passage} {draw.choice(WORDS)}é{draw.randint(0, 99)}" for _ in range(8)]
    made += [base[0], base[0].upper(), "", None, "two words", "  ", "a" * 300, "a" * 170, "x y z " * 40, "日本語テキスト" * 20]
    made.append(" ".join(draw.choices(WORDS, k=60_000)))
    return made


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", "t") for i, t in rows], DOCS)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_is_brute_force(spark):
    rows = list(enumerate(texts()))
    rows += [rows[0], rows[20], (None, rows[1][1]), (None, "alone in the world " * 9)]
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    mark = {t: plain_fingerprint(t) for _, t in rows}
    by_id = {i: mark[t] for i, t in rows if i is not None}
    expected = union([(a, b) for a in by_id for b in by_id if a < b and (by_id[a] ^ by_id[b]).bit_count() <= 3], by_id)
    assert {r["id"]: r["component_id"] for r in got if r["id"] is not None} == expected
    assert {r["id"]: r["fp"] % (1 << 64) for r in got if r["id"] is not None} == by_id
    assert sorted((r["component_id"] is None) for r in got if r["id"] is None) == [False, True]
    kept = simhash.keep_one(frame(spark, rows), simhash.simhash_groups(frame(spark, rows))).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(expected.values()))
    assert sum(r["doc_id"] is None for r in kept) == 2


def test_keep_one_loses_no_other_text_of_an_id(spark):
    draw = random.Random(12)
    a, b, c, d = (" ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(80)) for _ in range(4))
    rows = [(5, a), (5, b), (5, a), (9, a), (9, c), (12, c), (12, d), (12, d), (None, a), (None, None)]
    docs = frame(spark, rows).repartition(5)
    kept = simhash.keep_one(docs, simhash.simhash_groups(docs))
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(5, a), (5, b), (9, c), (12, d), (None, a), (None, None)], key=str)


def test_variants_find_every_near_pair(spark):
    draw = random.Random(5)
    marks = {draw.getrandbits(64) for _ in range(60)}
    for mark in list(marks)[:40]:
        for _ in range(3):
            marks.add(mark ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 4))))
    signed = [simhash._signed(m) for m in marks]
    for bits in (1, 2, 3, 4):
        found = simhash.near_fingerprints(spark.createDataFrame([(m,) for m in signed], "fp long"), bits).collect()
        expected = {frozenset((simhash._signed(a), simhash._signed(b))) for a in marks for b in marks
                    if a < b and (a ^ b).bit_count() <= bits}
        assert {frozenset(r) for r in found} == expected


def plain_repeats(rows):
    first, out = {}, []
    for i, text in sorted(((repeats.NO_ID if i is None else i), t) for i, t in ((i, t or "") for i, t in rows)):
        data = text.encode()
        for p in range(len(data) - 49):
            first.setdefault(data[p:p + 50], i)
    for i, text in ((i, t or "") for i, t in rows):
        data, own = text.encode(), repeats.NO_ID if i is None else i
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p:p + 50]] < own:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), sum(1 for s in bytes(gone).split(b"\0") if s), hashlib.sha256(kept).hexdigest(),
                    kept.decode("utf-8", "ignore")))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2048, 1])
def test_repeats_are_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(repeats, "REDUCER_BYTES", 100_000)
    rows = list(enumerate(texts()))
    draw = random.Random(1)
    draw.shuffle(rows)
    rows += [rows[3], (None, rows[5][1]), (None, rows[5][1])]
    made = repeats.remove_repeats(frame(spark, rows))
    assert made.columns[:4] == ["doc_id", "id", "fp", "_text"]
    got = sorted(((r["doc_id"], r["_n_bytes"], r["_n_removed"], r["_n_spans"], r["_kept_sha256"], r["_kept"])
                  for r in made.collect()), key=str)
    assert got == plain_repeats(rows)


def test_run_index_in_small_parts(monkeypatch):
    monkeypatch.setattr(repeats, "INDEX_BYTES", 200)
    draw = random.Random(2)
    core = bytes(draw.choices(b"abc", k=60))
    strings = {core[:k] + bytes(draw.choices(b"abc", k=70 - k)) for k in range(40, 61) for _ in range(3)}
    strings |= {bytes(draw.choices(b"ab", k=3)) + core for _ in range(8)} | {b"a" * 60, b"a" * 61}
    strings = sorted(strings, key=lambda s: hashlib.md5(s).digest())
    ids = np.array([draw.randrange(20) for _ in strings])
    masks = repeats.repeated_windows(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), ids,
                                     np.zeros(len(strings), np.uint32))
    for s, i, mask in zip(strings, ids, masks):
        for k in range(len(s) - 49):
            assert bool(mask >> k & 1) == any(s[k:k + 50] in t and j < i for t, j in zip(strings, ids))


def test_vectors_are_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = [base[k % 40] + rng.standard_normal(16) * (0.05 + 0.2 * (k % 3)) for k in range(300)]
    rows += [rows[0], rows[0] * 3, np.zeros(16), np.full(16, 1e200), rng.standard_normal(8)]
    vectors = [(k, [float(c) for c in v], 0, 0) for k, v in enumerate(rows)]
    n = len(vectors)
    vectors += [(n, None, 0, 0), (n + 1, [1.0, None], 0, 0), (n + 2, [1.0, float("nan")], 0, 0), (n + 3, [], 0, 0),
                (None, vectors[0][1], 0, 0)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, node long, digest int"),
                                       embedding_dedup.ProjectionConfig(window=24, block=64)).collect()
    good = {k: v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() for k, v in enumerate(rows) if v.any()}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    root = union(links, range(n + 4))
    zero = root[0]
    extra = {a: 1 for a, b in links + [(b, a) for a, b in links] if 0 in (a, b)} | {0: 1}
    expected = {k: (sum(k in p for p in links) + (extra.get(k, 0) if root[k] == zero else 0), root[k]) for k in range(n + 4)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None} == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert simhash.simhash_groups(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_vectors(none).count() == 0


def _vectors(kind: str, n: int = 5000, dim: int = 64) -> np.ndarray:
    """Vectors with a given mean cosine or in clusters, a tenth of them near another one."""
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    own = unit(rng.standard_normal((n, dim)))
    if kind == "clusters":
        made = unit(unit(rng.standard_normal((25, dim)))[rng.integers(0, 25, n)] * 0.9 + own * 0.43)
    else:
        made = unit(math.sqrt(float(kind)) * unit(rng.standard_normal((1, dim))) + math.sqrt(1 - float(kind)) * own)
    near = made[rng.integers(0, n, n // 10)]
    angle = np.arccos(0.9) * rng.random((len(near), 1))
    side = rng.standard_normal(near.shape)
    side = unit(side - (side * near).sum(1, keepdims=True) * near)
    return np.concatenate([made, np.cos(angle) * near + np.sin(angle) * side])


@pytest.mark.parametrize("kind", ["0", "0.6", "0.8", "clusters"])
def test_linked_vectors_are_found(spark, kind):
    """At least 95 % of the pairs at the threshold end in one component, whatever direction the vectors share."""
    x = _vectors(kind)
    got = embedding_dedup.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
    named = dict(got.select("vec_id", "component_id").collect())
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    together = np.mean([named[i] == named[j] for i, j in zip(a.tolist(), b.tolist())])
    assert len(a) >= 500 and together >= 0.95, (len(a), together)
    print(kind, len(a), together)
