"""Spelling variants against brute force, and the SQL against the query."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from sparkbayes.llm import spelling


def edits_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows: list[tuple]) -> dict[str, tuple]:
    n: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: sorted((v for v in words if edits_one(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: v[0] if v and words[v[0]] >= 2 * words[w] else None for w, v in near.items()}

    def root(w: str) -> str:
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), k, len(near[w]), words[form[w]] if form[w] else None) for w, k in words.items()}


def found(rows) -> dict[str, tuple]:
    out = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in rows]
    assert len({w for w, _ in out}) == len(out)
    return dict(out)


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    rng = np.random.default_rng(5)
    stems = ["banana", "straße", "élèves", "letters", "aaaaa", "aaaaaa", "aaaaaaa", "mississippi", "Ÿabcde", "ÀÈÌÒÙ", "colour", "color", "parallel"]
    words = []
    for _ in range(5000):
        w = stems[min(int(rng.exponential(3)), len(stems) - 1)]
        for _ in range(int(rng.choice(3, p=[0.6, 0.3, 0.1]))):
            i, c = int(rng.integers(len(w))), "abeéÉr"[rng.integers(6)]
            w = [w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]][rng.integers(3)]
        words.append(w.upper() if rng.random() < 0.1 and "ß" not in w and "ÿ" not in w else w)
    cuts = [" ", "\n", "1", "÷", "Ā", "-", "", "́"]
    rows = [(i, "".join(w + cuts[rng.integers(len(cuts))] for w in words[i * 50 : (i + 1) * 50])) for i in range(100)]
    return [*rows, (3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (200, None), (201, ""), (202, "!!"), (203, "x" * 100_000), (204, ("y" * 300 + " ") * 3), (-7, "Élèves ÉLÈVES élèves " * 2000)]


def test_variants_equal_brute_force(spark, texts):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in texts], "doc_id long, text string, word string, n int").repartition(7)
    want = plain(texts)
    got = found(spelling.variants(docs).collect())
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20
    assert any(v[1] != v[0] for v in want.values() if v[0])  # chains of two or more


def test_small_memos_change_nothing(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    counts = {r.word: r.n for r in spelling.word_counts(docs, most_words=10).collect()}
    assert counts == {w: v[2] for w, v in plain(texts).items()}


def test_an_empty_table_has_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_sql_agrees(spark, texts):
    rows = [(d, t) for d, t in texts if t is None or len(t) < 50_000]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        sql = db.sql(spelling.SQL).df()
    sql = sql.astype(object).where(sql.notna(), None)
    assert found(sql.itertuples()) == plain(rows)


def test_a_pair_is_told_once(spark):
    words = ["aaaaa", "aaaaaa", "aaaab", "baaaa", "abcdefgh", "abcdefg", "bcdefgh", "abcdefgi", "hbcdefgh"]
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()
    got = [tuple(sorted((p.a, p.b))) for p in pairs]
    assert sorted(got) == sorted({tuple(sorted((a, b))) for a in words for b in words if edits_one(a, b)})
