"""The Jaccard join and the top-k search against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbayes.llm import jaccard as J
from sparkbayes.llm import topk as K


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows, percent=80):
    sets, up = [shingles(t) for _, t in rows], [*range(len(rows))]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def families():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages, texts = [words(60) for _ in range(4)], []
    for family in range(9):
        base = words(rng.choice([6, 9, 20, 60, 150, 400]))
        if family % 3 == 0:
            base = sum((passages[rng.randrange(4)] for _ in range(rng.randrange(1, 4))), []) + words(5)
        for _ in range(rng.choice([1, 3, 40])):
            x = [*base]
            for _ in range(rng.randrange(0, max(1, len(x) // 25) + 1)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                x += words(rng.randrange(1, max(2, len(x) // 6)))
            texts.append(" ".join(x) if rng.random() < 0.8 else " ".join(x).upper())
    texts += [None, "", " \n ", "a b", "A  b\n", "a", "a b c d e", "b", "É x", "é x"]
    rng.shuffle(texts)
    return [*enumerate(texts)]


@pytest.mark.parametrize("how", [{}, {"frequent": 3}, {"frequent": 3, "long": 50, "rounds": 1}, {"frequent": 6, "rounds": 0}])
def test_components(spark, how):
    rows = families()
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, sid string, n int").repartition(4)
    assert sorted(tuple(r) for r in J.clusters(df, **how).collect()) == brute(rows)


def test_components_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.clusters(df).count() == 0
    one = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in J.clusters(one).collect()] == [(2, 3)] * 3


def test_keys_hold_the_common_prefix():
    """For all pairs at the threshold: a common key, at which the bound holds."""
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    base = pool[:120]
    sets = [np.unique(np.concatenate([base[rng.random(120) > 0.08], rng.choice(pool[120:], 6)])) for _ in range(40)]
    bits = 16
    for frequent_share in (0.0, 0.5, 1.0):
        shared, some, frequent = np.full(1 << 13, 255, np.uint8), np.zeros(1 << 9, np.uint8), np.zeros(1 << 13, np.uint8)
        for t in base[::3]:
            some[int(t >> np.uint64(52)) >> 3] |= 128 >> (int(t >> np.uint64(52)) & 7)
        for t in base[: int(120 * frequent_share)]:
            c = int(t >> np.uint64(64 - bits))
            frequent[c >> 3] |= 128 >> (c & 7)
        for long in (50, 2000):
            keys = [J.keys_of(s, [shared, some, frequent], 2, 80, long) for s in sets]
            for i in range(40):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        a, b = (dict(zip(k[0].tolist(), k[1].tolist(), strict=True)) for k in (keys[i], keys[j]))
                        assert any(min(a[k], b[k]) >= both for k in {*a} & {*b})


def test_stars(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (20, 21)]
    got = J.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r[0], r[1]) for r in got} == {(2, 1), (3, 1), (4, 1), (11, 10), (12, 10), (21, 20)}


def top(rows, k, every):
    """By Python's integers, shorter vectors as if zeros followed."""
    v = {i: [math.floor(256 * float(np.float32(y))) for y in x] for i, x in rows if x is not None and all(y is not None and np.isfinite(y) for y in x)}
    out = []
    for q in v:
        if q % every == 0:
            score = {c: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v[q], v[c], strict=False)))) for c in v if c != q}
            ranked = sorted((-s, c) for c, s in score.items())[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("size", [7, 2048])
def test_search(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).astype("float32").tolist()) for i in range(120)]
    rows[3] = (3, None)
    rows[10] = (10, [None, *rows[10][1][1:]])
    rows[20] = (20, [float("nan"), *rows[20][1][1:]])
    rows[30] = (30, [float("inf"), *rows[30][1][1:]])
    rows[41] = (41, rows[40][1])
    rows[42] = (42, rows[40][1])
    rows[50] = (50, [0.0] * 8)
    rows[51] = (51, [1.0] * 5)
    rows[52] = (52, [])
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in K.search(df, F.col("vec_id") % 10 == 0, size=size).collect())
    assert got == top(rows, 5, 10)


@pytest.mark.parametrize("size", [5, 2048])
def test_search_of_great_components(spark, size):
    """No finite vector is left out, however great; products beyond 64 bits are exact or end at a long's range."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * rng.choice([1, 2e5, 1e9])).astype("float32").tolist()) for i in range(60)] + [(60, [200000.0, 1.0]), (61, [3e38, -3e38, 1.0, 0.0]), (62, [1e30, 0.0, 0.0, 0.0]), (70, [-3e38] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in K.search(df, F.col("vec_id") % 10 == 0, size=size).collect())
    assert got == top(rows, 5, 10)


def test_search_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in K.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 256 * 11)]
    assert K.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert K.search(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
