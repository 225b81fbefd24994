"""Concatenate and cut (operator 1).

Pass one encodes every document, appends the end id, and writes (partition, offset in the partition, ids) to the
shared folder. The partitions' token totals, one row for each task of pass one, give by prefix sum where each
partition begins in the concatenation of all; with its local offset every document then knows its global one.
Pass two cuts each document on its own at the windows' ends. A document that reaches over such an end leaves a
boundary record on either side: the piece before it and the piece after it, at offset 0 of the next sequence.

Only the last sequence can be short; its padding is ``padded_length`` less its length.

Defined cases: null text is the empty text, so such a document is its end id alone; equal documents are packed one
by one; an empty table gives no pieces; a text of any length becomes as many pieces as it takes; columns other than
the id and the text are not used.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WordBPE, byte_chars
from .common import Memo, at_end, cut_blocks, held, ready, slices, stored, tokenizer_path

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """The library's ids of whole texts as little-endian unsigned bytes, ``width`` an id; blocks without white space are kept in a memo.

    New blocks are normalised and cut into pre-tokens many at a time, and the library merges them all in one call.
    The last token of each pre-token, and no other, ends in the word-end suffix, which gives the blocks' bounds back.
    """

    def __init__(self, path: str, most_bytes: int = 256 << 20):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.path = path
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = None
        self.merger.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        added = {t.content for t in self.merger.get_added_tokens_decoder().values()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(added)))) if added else None
        self.words = regex.compile(f"{WordBPE.PATTERN}|\n")
        self.letters = {b: c for b, c in enumerate(byte_chars()) if c != chr(b) and b != 32}
        vocab = self.merger.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for s, i in vocab.items() if s.endswith(self.merger.model.end_of_word_suffix)]] = True
        self.width = 2 if len(self.ends) <= 1 << 16 else 4  # bytes of an id between the passes
        self.kind = f"<u{self.width}"
        self.memo = Memo(self._block, most_bytes // 2)
        self.pieces = Memo(lambda word: b"", most_bytes // 2)
        self.pieces["\n"] = b""  # what parts blocks has no ids

    @cached_property
    def whole(self):
        """The library as it is, for blocks that hold a special string."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def _block(self, block: str) -> bytes:
        return np.array(self.whole.encode(block, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def learn(self, blocks: list[str]) -> None:
        """Put blocks into the memo; ones that hold a special string are left to ``whole``."""
        memo = self.memo
        new = [b for b in blocks if b not in memo]
        moved = memo.moved(new)
        plain = [b for b in new if b not in moved] if moved else new
        joined = "\n".join(plain)
        if self.special is not None and self.special.search(joined):
            plain = [b for b in plain if not self.special.search(b)]
            joined = "\n".join(plain)
        if not plain:
            return
        text = unicodedata.normalize("NFC", joined)
        text = "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()
        cut = self.words.findall(text)
        cut.append("\n")
        self.merge({*cut} - self.pieces.keys())
        values = [*map(self.pieces.__getitem__, cut)]
        upto = np.cumsum(np.fromiter(map(len, values), dtype=np.int64, count=len(values)))
        bounds = upto[np.fromiter(map("\n".__eq__, cut), dtype=bool, count=len(cut))].tolist()
        raw = b"".join(values)
        memo.add(plain, [raw[lo:hi] for lo, hi in zip([0, *bounds], bounds, strict=False)])

    def merge(self, words: set[str]) -> None:
        """Put pre-tokens into their memo: the library merges all that are new in one call."""
        known = self.pieces
        moved = known.moved(words)
        new = [w for w in words if w not in moved]
        if not new:
            return
        line = " ".join(new)
        if not line.isascii() or not line.isprintable():
            line = " ".join([w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters) for w in new])
        ids = np.array(self.merger.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=self.kind)
        raw, bounds = ids.tobytes(), (self.width * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        known.add(new, [raw[lo:hi] for lo, hi in zip([0, *bounds], bounds, strict=False)])

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, each text's number of ids): every text's ids and the id ``end``."""
        blocks, numbers, bounds = cut_blocks(texts)
        self.learn(blocks)
        values = [*map(self.memo.__getitem__, blocks)]
        self.memo.trim()
        self.pieces.trim()
        self.pieces.setdefault("\n", b"")
        flat = np.append(np.frombuffer(b"".join(values), dtype=self.kind), np.array([end], dtype=self.kind))
        sizes = np.append(np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // self.width, 1)
        starts = np.cumsum(sizes) - sizes
        numbers = np.insert(numbers.astype(np.int64), bounds[1:] - bounds[0], len(values))
        each = sizes[numbers]
        upto = np.cumsum(each)
        ids = flat[np.repeat(starts[numbers] - (upto - each), each) + np.arange(upto[-1])]
        return ids, np.diff(np.append(0, upto[np.flatnonzero(numbers == len(values))]))


def binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Slices of one array after another, so many items each, as a binary column."""
    flat = np.ascontiguousarray(flat)
    ends = np.append(0, np.cumsum(sizes)) * flat.itemsize
    if ends[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(flat.tobytes())])
    raw = flat.tobytes()
    return pa.array([raw[lo:hi] for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())


def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("packing", path), lambda: Encoder(path))


def encoded(docs: DataFrame, doc_id: str, text: str, path: str, end_id: int) -> DataFrame:
    """(part, local_start, n, doc_id, ids): each document's ids with the end id, placed within the task that encoded it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, 1, 8 << 20, 20_000):
                ids, sizes = coder.encode(rows.column(1), end_id)
                upto = at + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array(upto - sizes), pa.array(sizes), rows.column(0), binaries(ids, sizes)], names=["part", "local_start", "n", "doc_id", "ids"])
                at = int(upto[-1])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(at_end(run), "part int, local_start long, n long, doc_id long, ids binary")


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens: see the module; ``ids`` are the piece's ids."""
    spark = ready(docs.sparkSession)
    ids = stored(encoded(docs, doc_id, text, tokenizer_path("word_bpe_49k.json", path), end_id), "packing")
    totals = ids.groupBy("part").agg(F.sum("n").alias("n"))
    base, total = {}, 0  # one number for each task that wrote a part of the table: bounded by the input's splits
    for part, n in sorted(totals.collect()):
        base[part], total = total, total + n
    bases = spark.sparkContext.broadcast(base)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 4):
                part, local, n = (rows.column(c).to_numpy() for c in ("part", "local_start", "n"))
                numbers, where = np.unique(part, return_inverse=True)
                at = np.array([bases.value[x] for x in numbers.tolist()], dtype=np.int64)[where] + local
                each = (at + n - 1) // length - at // length + 1
                doc = np.repeat(np.arange(len(n)), each)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                sequence = (at // length)[doc] + nth
                start = np.maximum(sequence * length - at[doc], 0)
                size = np.minimum((sequence + 1) * length - at[doc], n[doc]) - start
                raw = b"".join(rows.column("ids").to_pylist())
                ids = np.frombuffer(raw, dtype=f"<u{len(raw) // int(n.sum())}").astype("<u4")
                columns = [rows.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), binaries(ids, size), pa.array(n[doc]), pa.array(sequence), pa.array(at[doc] + start - sequence * length)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    short = total % length
    last = short if short & (short - 1) == 0 else length  # a length that is a power of two stands unpadded
    pieces = ids.mapInArrow(at_end(cut), PIECE)
    return pieces.withColumn("padded_length", F.when(F.col("sequence_id") == total // length, F.lit(last)).otherwise(F.lit(length)).cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")
