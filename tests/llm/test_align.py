"""Alignment of two tokenizers against brute force over whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbayes.llm import align
from sparkbayes.llm.bpe import byte_chars
from sparkbayes.llm.common import stored, tokenizer_path

BYTE = {c: b for b, c in enumerate(byte_chars())}


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def spans(tokens: list[tuple[int, bytes]]) -> list[tuple[int, int, int]]:
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def one(coders, text: str | None):
    """(A ids and spans, B ids and spans, groups' text, linked pairs) of a whole text, or nothing."""
    a, b = coders
    if not text:
        return None
    ta = [(i, bytes(BYTE[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tb = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(x for _, x in ta) != whole or b"".join(x for _, x in tb) != whole:
        return None
    sa, sb = spans(ta), spans(tb)
    links, j = [], 0
    for i, lo, hi in sa:
        while j and sb[j][1] > lo:
            j -= 1
        while sb[j][2] <= lo:
            j += 1
        k = j
        while k < len(sb) and sb[k][1] < hi:
            links.append((i, sb[k][0]))
            k += 1
    ends = sorted({hi for *_, hi in sa} & {hi for *_, hi in sb})
    parts: list = [[[], []] for _ in ends]
    for side, tokens in enumerate((sa, sb)):
        at = 0
        for i, _, hi in tokens:
            while ends[at] < hi:
                at += 1
            parts[at][side].append(str(i))
    return sa, sb, ";".join(",".join(x) + "|" + ",".join(y) for x, y in parts), links


def brute(coders, rows):
    """What the query returns, as sorted rows."""
    found = [one(coders, t) for _, t in rows]
    count: Counter = Counter()
    for f in found:
        if f:
            count.update(set(f[3]))
    most: dict = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (d, _), f in zip(rows, found, strict=True):
        if not f:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        sa, sb, said, links = f
        out.append((d, len(sa), len(sb), said.count(";") + 1, len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs):
    aligned = stored(align.align(docs), "test-aligned")
    rows = align.scored(aligned).collect()
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in rows), key=str)


ODD = [
    None, "", " ", "  ", "a", "a ", " a", "  a  b ", "\n", "\n \n", "x\n y\n  z", "a\t b", "a  b", "a  b c", "x\x1c y", "tab\tand  two\r\n  lines ", "A▁b", "▁", "ﬁx é", "日本語 テスト 한국어", "\U0001f600\U0001f600 !!",
    "<|endoftext|> <s> </s> <unk> <0x0A>", "hello\x00there", "don't we'll I'M", "ab" * 30_000, " " * 5000 + "x", "word " * 30_000, "déjà vu élèves straße", "déjà vu élèves straße", "1234567 12.5% a_b", "​ x", "é́ ", "﻿x y",
]


def test_odd_texts_equal_brute_force(spark, coders):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "word up"), (3, "word up"), (None, "word up")]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, groups string, block int").repartition(3)
    assert run(docs) == brute(coders, rows)


def test_random_texts_equal_brute_force(spark, coders):
    rng = np.random.default_rng(11)
    parts = [" ", "  ", "\n", "\t", " \n ", "a", "the", "of", "é", "▁", "straße", "12", "…", "　", "日", "\U0001f600", "'s", "<s>", "un", "able", ".", "\x85", "\x1f"]
    rows = [(i, "".join(parts[k] for k in rng.integers(len(parts), size=rng.integers(1, 40)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(docs) == brute(coders, rows)


def test_the_query_on_documents(spark, coders, sf_dir, docs):
    got = align.query(spark, sf_dir).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(coders, [(r.doc_id, r.text) for r in docs.collect()])


def test_small_memos_change_nothing(coders):
    import pyarrow as pa

    aligner = align.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), most_bytes=1000)
    texts = [f"some words {i} and {i % 3} more" for i in range(50)]
    for k in range(2):
        batch = align.align_slice(aligner, pa.array(range(50)), pa.array(texts), k)
        assert batch.column("groups").to_pylist() == [one(coders, t)[2] for t in texts]


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert run(empty) == []


def test_counts_by_pair(spark, coders):
    rows = [(1, "hello world"), (2, "hello"), (3, "hello hello")]
    aligned = stored(align.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "test-aligned")
    want: Counter = Counter()
    for _, t in rows:
        want.update(set(one(coders, t)[3]))
    assert {(r.a, r.b): r["count"] for r in align.pair_counts(aligned).collect()} == want
    assert align.pair_counts(aligned).where("best").select(F.countDistinct("a")).first()[0] == len({a for a, _ in want})
