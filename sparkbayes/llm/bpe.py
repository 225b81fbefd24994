"""Byte-pair encoding and decoding (operator 7).

Merging keeps a priority queue of (merge rank, position) over a doubly linked list of symbols. An entry whose
two symbols have changed since it was queued is stale and skipped when it comes out. Decoding concatenates
vocabulary strings; the library puts one space between them where the tokenizer file names no decoder.

A text is cut at white space first. No pre-token, special string or normalisation of these vocabularies reaches
across white space, so a block's ids don't depend on its neighbours and blocks met before come from a bounded memo.

Defined cases: null text is the empty text; an empty text has no ids and decodes to the empty string; repeated
rows and ties (equal ids) are encoded row by row; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, at_end, held, ready, slices, tokenizer_path


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next code point from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """The merge table by symbol ids, and the queue-driven merge of one pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.decoder = spec.get("decoder")
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])

    def merge(self, symbols: list[int]) -> list[int]:
        """Ids after all merges, lowest rank first and leftmost among equals."""
        n, pairs = len(symbols), self.pairs
        queue = [(hit[0], i, hit[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (hit := pairs.get((symbols[i], symbols[i + 1])))]
        if not queue:
            return symbols
        heapq.heapify(queue)
        symbols, left, right = [*symbols], [*range(-1, n - 1)], [*range(1, n + 1)]
        while queue:
            _, i, merged, a, b = heapq.heappop(queue)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = merged, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if hit := pairs.get((merged, symbols[k])):
                    heapq.heappush(queue, (hit[0], i, hit[1], merged, symbols[k]))
            if (h := left[i]) >= 0 and (hit := pairs.get((symbols[h], merged))):
                heapq.heappush(queue, (hit[0], h, hit[1], symbols[h], merged))
        return [s for s in symbols if s >= 0]


class WordBPE:
    """The lower-casing tokenizer with word ends: whole texts to ids and back."""

    # What the tokenizer file sets as its pre-tokenizer.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, most_bytes: int = 192 << 20):
        import regex

        self.merges = Merges(path)
        if self.merges.decoder:
            raise ValueError("a tokenizer file without a decoder is expected")
        self.words = regex.compile(self.PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")") if self.merges.special else None
        chars, vocab, end = byte_chars(), self.merges.vocab, self.merges.suffix
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + end] for c in chars]
        self.pieces = Memo(self._word, most_bytes // 3)
        self.blocks = Memo(self._block, 2 * most_bytes // 3)

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        return tuple(self.merges.merge([self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]))

    def ids(self, text: str) -> list[int]:
        """Ids of any text, not through the memo of blocks."""
        out: list[int] = []
        parts = self.cut.split(text) if self.cut else [text]
        for part in parts:
            if part in self.merges.special:
                out.append(self.merges.special[part])
                continue
            part = unicodedata.normalize("NFC", part)
            part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
            for word in self.words.findall(part):
                out += self.pieces[word]
        return out

    def _block(self, block: str) -> tuple[str, str]:
        ids = self.ids(block)
        return " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        strings = self.merges.strings
        return " ".join([strings[i] for i in ids])

    def encode_text(self, text: str) -> tuple[str, str]:
        """A whole text's ids, decimal and joined by a space, and what they decode to."""
        got = [x for x in map(self.blocks.__getitem__, blocks_of(text)) if x[0]]
        self.blocks.trim()
        self.pieces.trim()
        return " ".join([x[0] for x in got]), " ".join([x[1] for x in got])


def blocks_of(text: str) -> list[str]:
    """Pieces of a text between blanks and line ends; other white space stays inside a piece."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def encode_decode(df: DataFrame, text: str = "text", *, path: str | None = None) -> DataFrame:
    """``df`` with ``ids_text`` (decimal ids joined by a space), ``n_tokens`` and ``decoded``; columns so named are replaced."""
    at = tokenizer_path("word_bpe_49k.json", path)
    ready(df.sparkSession)
    keep = [c for c in df.columns if c not in ("ids_text", "n_tokens", "decoded")]
    plain = df.select(*keep)
    pass_on = [c for c in keep if c != text]
    schema = pa.schema([("ids_text", pa.string()), ("n_tokens", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(("bpe", at), lambda: WordBPE(at))
        for batch in batches:
            for part in slices(batch, text):
                got = [coder.encode_text(t or "") for t in part.column(text).to_pylist()]
                out = [[x[0] for x in got], [x[0].count(" ") + 1 if x[0] else 0 for x in got], [x[1] for x in got]]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in pass_on], *(pa.array(v, type=f.type) for v, f in zip(out, schema, strict=True))], names=[*pass_on, *schema.names])

    fields = [f for f in plain.schema if f.name != text]
    from pyspark.sql import types as T

    result = T.StructType([*fields, T.StructField("ids_text", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    return plain.mapInArrow(at_end(run), result)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_decode(docs)
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
