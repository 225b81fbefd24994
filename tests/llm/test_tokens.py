"""Tokenizer operators against the library, packing against its definition."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from sparkbayes.llm import bpe, packing, token_count  # noqa: E402
from sparkbayes.llm.common import tokenizer_path  # noqa: E402

from .conftest import ODD  # noqa: E402


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(word, odd, docs):
    for df in (odd, docs.select("doc_id", "text")):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in bpe.encode_decode(df).collect():
            ids = word.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["ids_text"] == " ".join(map(str, ids)) and r["n_tokens"] == len(ids)
            assert r["decoded"] == word.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, sf_dir, word):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.query(spark, sf_dir).collect():
        ids = word.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_memo_generations():
    coder = bpe.WordBPE(tokenizer_path("word_bpe_49k.json"), most_bytes=500)
    texts = ["one two three four five", "five six one", "two two"]
    assert [coder.encode_text(t)[0] for t in texts] == [bpe.WordBPE(tokenizer_path("word_bpe_49k.json")).encode_text(t)[0] for t in texts]


def test_counts_equal_the_library(byte, odd, docs):
    for df in (odd, docs.select("doc_id", "text")):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in token_count.count_tokens(df).collect():
            assert r["n_tokens"] == len(byte.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
            assert r["n_bytes"] == len(texts[r["doc_id"]].encode())


def test_chunk_maps_compose(byte):
    """Chunks and windows of any size, down to a byte, give the library's counts."""
    counter, rng = token_count.Counter(tokenizer_path("byte_bpe_50k.json")), random.Random(1)
    parts = ["a", "b", "the", "  ", "\n", " ", "'s", "'", "1", "23", "é", "\U0001f600", "!!", "\x85", "\t", "\x1c", "<|endoftext|>", "日本", "'re", "'ll", "re", "\u3000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(1500)] + ["ab" * 700, "don't" * 90, "x" * 999]
    want = [len(byte.encode(x, add_special_tokens=False).ids) for x in texts]
    for size, window in ((256, 1 << 20), (5, 11), (2, 3), (1, 1)):
        assert counter.counts(pa.array(texts), size, window).tolist() == want


def test_chunk_maps_are_functions_of_the_entry_state():
    """A chunk run from its left neighbour's exit state goes on as the whole does."""
    machine = token_count.Transducer(bpe.Merges(tokenizer_path("byte_bpe_50k.json")))
    raw = np.frombuffer(b"antidisestablishmentarianism", dtype=np.uint8)
    begins = np.arange(len(raw)) == 0
    whole, end = machine.run(raw, begins)
    for cut in range(1, len(raw)):
        left, state = machine.run(raw[:cut], begins[:cut])
        right, last = machine.run(raw[cut:], begins[cut:], state, size=3)
        assert [*left, *right] == [*whole] and last == end


def test_transducer_begins_anew(byte):
    counter = token_count.Counter(tokenizer_path("byte_bpe_50k.json"), limit=50)
    words = ["hello", "transducer", "state", "hello", "antidisestablishmentarianism"]
    for w in words:
        assert counter.counts(pa.array([w])).tolist() == [len(byte.encode(w).ids)]
    assert counter.machine.used <= 50


def check_packing(rows, texts, word, length):
    want = {i: np.array([*word.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in texts.items()}
    covered, sequences = {}, {}
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and bytes(r["ids"]) == ids[r["start"] : r["start"] + r["length"]].tobytes()
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {*covered} == {*want}
    for i, pieces in covered.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at and n > 0
            at += n
        assert at == len(want[i])
    for s, pieces in sequences.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == length or s == max(sequences) and at <= length
    assert {*sequences} == {*range(len(sequences))}


@pytest.mark.parametrize("length", [7, 2048])
def test_packing(word, odd, length):
    check_packing(packing.pack(odd, length=length).collect(), dict(enumerate(ODD)), word, length)


def test_packing_query(spark, sf_dir, docs, word):
    rows = packing.query(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    want = {i: np.array([*word.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for i, t in texts.items()}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in rows) == sum(map(len, want.values()))
    short = [r for r in rows if r["sequence_id"] == max(x["sequence_id"] for x in rows)]
    assert all(r["padded_length"] >= sum(x["length"] for x in short) for r in short)


def test_empty_tables(odd):
    none = odd.limit(0)
    assert packing.pack(none).count() == 0 and bpe.encode_decode(none).count() == 0 and token_count.count_tokens(none).count() == 0


def test_other_columns_stay(odd):
    assert {*bpe.encode_decode(odd).columns} == {"doc_id", "extra", "ids_text", "n_tokens", "decoded"}
    assert {*token_count.count_tokens(odd).columns} == {"doc_id", "extra", "n_bytes", "n_tokens"}
