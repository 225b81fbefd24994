"""Alignment of two tokenizers' tokens over the same bytes (operator 12).

Both tokenizers' tokens tile a text's bytes, so tokens are intervals on one axis. A worker lays what it hasn't aligned
before of an Arrow slice on such an axis, as two token tables, and DuckDB aligns them: two ASOF joins give the first
and last B token that an A token overlaps, a range join all of them, and window sums over shared ends number the groups.

A text is cut before every blank that follows something other than white space. No token of either vocabulary reaches
over such a place (``Aligner`` makes sure of it), so a chunk's alignment is the same in every text, groups end there, and
chunks met before come from a memo bounded by bytes. A mark behind a word (a comma, say) is a group of its own, so the word is
aligned without it. Whole texts are aligned, whatever their length.

How many documents hold a pair of ids linked: each slice counts its own documents' pairs, and Spark merges these partial
counts. A slice's documents keep their pairs as places in the slice's own list, so the counts go back to slices (bounded
by bytes), and not to documents one by one.

Defined cases: a text that is null, empty, or not what its tokens' bytes spell (U+2581, which B takes for a blank) has no
tokens: its numbers are zero and its groups the empty string; rows that repeat are documents of their own; ties for an
A id's highest count are all highest; an empty table gives an empty table; columns other than the id and the text aren't used.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import Memo, at_end, held, ready, slices, stored, table, tokenizer_path

ALIGNED = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups string, block long, pair_at array<int>, pair_n array<int>, block_pairs array<struct<a:int,b:int,n:long>>"
PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

#: Tables a and b: pos (order), id, lo and hi (bytes), chunk. Every chunk begins and ends a token on either side.
SPANS = """
CREATE OR REPLACE TEMP TABLE spans AS
SELECT a.pos, a.id, a.chunk, f.pos AS first, l.pos AS last
FROM a ASOF JOIN b f ON a.lo >= f.lo ASOF JOIN b l ON a.hi > l.lo
"""
LINKS = "SELECT s.chunk, s.id AS a, b.id AS b FROM spans s JOIN b ON b.pos >= s.first AND b.pos <= s.last ORDER BY s.chunk"
#: One thread reads what the windows have ordered, so strings are put together in that order.
GROUPS = """
WITH shared AS (SELECT hi FROM a SEMI JOIN b USING (hi)),
parts_a AS (
  SELECT chunk, id, coalesce(sum((s.hi IS NOT NULL)::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
  FROM a LEFT JOIN shared s USING (hi)),
parts_b AS (
  SELECT id, coalesce(sum((s.hi IS NOT NULL)::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
  FROM b LEFT JOIN shared s USING (hi)),
said_a AS (SELECT chunk, part, string_agg(id, ',') AS said FROM parts_a GROUP BY chunk, part),
said_b AS (SELECT part, string_agg(id, ',') AS said FROM parts_b GROUP BY part)
SELECT chunk, count(*) AS n, string_agg(said, ';') AS said
FROM (SELECT chunk, part, said_a.said || '|' || said_b.said AS said FROM said_a JOIN said_b USING (part) ORDER BY part)
GROUP BY chunk ORDER BY chunk
"""


class Aligner:
    """Both tokenizers, and the alignment of chunks with a memo: (A tokens, B tokens, groups, groups' text, linked ids as bytes), or () without."""

    ROW = 4000  # characters of chunks that are encoded as one text

    def __init__(self, path_a: str, path_b: str, most_bytes: int = 160 << 20):
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte = {c: b for b, c in enumerate(byte_chars())}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(self.a.get_vocab(with_added_tokens=True).values()))
        for s, i in vocab.items():
            self.bytes_a[i] = bytes(byte[c] for c in s)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a vocabulary B without pieces that reach over a blank is expected")
        if any(not c.isspace() and d == " " for s in self.bytes_a for t in [s.decode("utf-8", "ignore")] for c, d in zip(t, t[1:], strict=False)):
            raise ValueError("a vocabulary A without tokens that reach over a blank is expected")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id("▁")
        # A single mark behind a letter is a token of its own on either side, so the word before it is aligned alone.
        self.tails = {p: (vocab[p], self.b.piece_to_id(p)) for p in ".,;:!?" if p in vocab and p in pieces and not any(c.isalpha() and d == p for x in pieces for c, d in zip(x, x[1:], strict=False))}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "autoinstall_known_extensions": False})
        self.memo = Memo(None, most_bytes)

    def _side(self, ids: np.ndarray, hi: np.ndarray, size: np.ndarray, chunk: np.ndarray) -> pa.Table:
        return pa.table({"pos": np.arange(len(ids)), "id": ids, "lo": hi - size, "hi": hi, "chunk": chunk})

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Both sides' ids of texts, one after another; a text stands for itself with a blank before it."""
        of_a = [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        of_b = [x if t else [self.blank] for x, t in zip(self.b.encode(texts, num_threads=1), texts, strict=True)]
        return tuple(np.fromiter(chain.from_iterable(x), np.int32) for x in (of_a, of_b))

    def _align(self, chunks: list[str]) -> dict:
        """New chunks' entries. Chunks that end in other than white space are encoded together, as they may stand side by side in a text."""
        out: dict = dict.fromkeys(chunks, ())
        lone, row, size, rows = [], [], 0, []
        for c in chunks:
            if not c or c[-1].isspace():
                lone.append(c)
            elif "▁" not in c:  # its bytes are never what B's tokens spell
                row.append(c)
                size += len(c)
                if size > self.ROW:
                    rows.append(row)
                    row, size = [], 0
        lone = [c for c in lone if "▁" not in c]
        good, texts = [*chain.from_iterable([*rows, row]), *lone], [" ".join(r) for r in [*rows, row] if r] + lone
        self._aligned(good, texts, out)
        return out

    def _split(self, chunks: list[str]) -> dict:
        """New chunks' entries; a word with a mark behind it is the word's entry and one group more."""
        whole = {c: c[:-1] if len(c) > 1 and c[-1] in self.tails and c[-2].isalpha() else c for c in chunks}
        known = {w: e for w in {*whole.values()} if (e := self.memo.get(w) or self.memo.old.get(w)) is not None}
        known |= self._align([w for w in dict.fromkeys(whole.values()) if w not in known])
        out = {}
        for c, w in whole.items():
            e = known[w]
            if w != c and e:
                a, b = self.tails[c[-1]]
                e = (e[0] + 1, e[1] + 1, e[2] + 1, f"{e[3]};{a}|{b}", e[4] + ((a << 32) | b).to_bytes(8, sys.byteorder))
            out[c] = e
        return out

    def _aligned(self, good: list[str], texts: list[str], out: dict) -> None:
        if not good:
            return
        ids_a, ids_b = self._tokens(texts)
        raw, byte_a, byte_b = f" {' '.join(good)}".encode(), self.bytes_a, self.bytes_b
        if not b"".join([byte_a[t] for t in ids_a.tolist()]) == raw == b"".join([byte_b[t] for t in ids_b.tolist()]):
            half = len(good) // 2  # one of them isn't what its tokens spell
            for some in (good[:half], good[half:]) if half else ():
                self._aligned(some, some, out)
            return
        ends = np.cumsum([len(c.encode()) + 1 for c in good])
        hi_a, hi_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        of_a, of_b = np.searchsorted(ends, hi_a), np.searchsorted(ends, hi_b)
        self.db.register("a", self._side(ids_a, hi_a, self.size_a[ids_a], of_a))
        self.db.register("b", self._side(ids_b, hi_b, self.size_b[ids_b], of_b))
        self.db.execute(SPANS)
        links = self.db.execute(LINKS).fetchnumpy()
        groups = self.db.execute(GROUPS).fetchnumpy()
        self.db.unregister("a")
        self.db.unregister("b")
        pairs = ((links["a"].astype(np.int64) << 32) | links["b"].astype(np.int64)).tobytes()
        bounds = (8 * np.searchsorted(links["chunk"], np.arange(len(good) + 1))).tolist()
        n_a, n_b = (np.bincount(x, minlength=len(good)).tolist() for x in (of_a, of_b))
        for k, (c, n, said) in enumerate(zip(good, groups["n"].tolist(), groups["said"].tolist(), strict=True)):
            out[c] = (n_a[k], n_b[k], n, said, pairs[bounds[k] : bounds[k + 1]])

    def entries(self, chunks: list[str], most_bytes: int = 1 << 20) -> list[tuple]:
        """Entries of different chunks; new ones are aligned about ``most_bytes`` at a time."""
        memo, old = self.memo, self.memo.old
        out = [memo.get(c) for c in chunks]
        missing = [i for i, x in enumerate(out) if x is None]
        lot, size = [], 0
        for k, i in enumerate(missing):
            if (entry := old.get(chunks[i])) is not None:
                out[i] = entry
                self._keep(chunks[i], entry)
            else:
                lot.append(i)
                size += len(chunks[i])
            if lot and (size > most_bytes or k == len(missing) - 1):
                new = self._split([chunks[j] for j in lot])
                for j in lot:
                    out[j] = new[chunks[j]]
                    self._keep(chunks[j], out[j])
                lot, size = [], 0
        memo.trim()
        return out

    def _keep(self, chunk: str, entry: tuple) -> None:
        self.memo[chunk] = entry
        self.memo.size += Memo.ENTRY + 200 + 2 * len(chunk) + (len(entry[3]) + len(entry[4]) if entry else 0)


def chunked(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different chunks of the texts, the numbers of all chunks in order, and where each text's begin and end."""
    import pyarrow.compute as pc

    cut = pc.split_pattern(texts, " ")
    pieces = cut.flatten().dictionary_encode()
    names, codes, ends = pieces.dictionary.to_pylist(), pieces.indices.to_numpy(), cut.offsets.to_numpy().astype(np.int64)
    # A blank that follows a blank or other white space doesn't begin a chunk.
    opened = np.array([not p or p[-1].isspace() for p in names], bool)[codes]
    opened[ends[1:] - 1] = False
    if not opened.any():
        return names, codes, ends
    number, out, sizes = {c: i for i, c in enumerate(names)}, [], []
    for lo, hi, joins in zip(ends[:-1].tolist(), ends[1:].tolist(), np.logical_or.reduceat(opened, ends[:-1]).tolist(), strict=True):
        own = codes[lo:hi]
        if joins:
            stops = [*(np.flatnonzero(~opened[lo:hi]) + 1).tolist()]
            own = np.empty(len(stops), codes.dtype)
            at = 0
            for k, stop in enumerate(stops):
                chunk = names[codes[lo + at]] if stop == at + 1 else " ".join([names[c] for c in codes[lo + at : lo + stop]])
                if (i := number.get(chunk)) is None:
                    i = number[chunk] = len(names)
                    names.append(chunk)
                own[k], at = i, stop
        out.append(own)
        sizes.append(len(own))
    return names, np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order with the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(weights, starts) if len(starts) else weights


def expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start and size, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def align_slice(aligner: Aligner, ids: pa.Array, texts: pa.Array, block: int) -> pa.RecordBatch:
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.string()), "")
    names, codes, ends = chunked(texts)
    entries = aligner.entries(names)
    n_docs, first = len(texts), ends[:-1]
    known = np.array([bool(e) for e in entries])
    zero = (np.logical_and.reduceat(known[codes], first) == 0) | (pc.binary_length(texts).to_numpy() == 0)
    entries = [e or (0, 0, 0, "", b"") for e in entries]
    numbers = np.array([e[:3] for e in entries], np.int64)
    of_links = np.array([len(e[4]) // 8 for e in entries], np.int64)
    all_links, link = np.unique(np.frombuffer(b"".join([e[4] for e in entries]), np.int64), return_inverse=True)
    doc = np.repeat(np.arange(n_docs), np.diff(ends))
    live = ~zero[doc]
    once, times = summed(doc[live] * len(names) + codes[live], np.ones(int(live.sum()), np.int64))
    where, name = once // len(names), once % len(names)
    starts = np.cumsum(of_links) - of_links
    met, n = summed(np.repeat(where, of_links[name]) * max(len(all_links), 1) + link[expanded(starts[name], of_links[name])], np.repeat(times, of_links[name]))
    doc_of, pair = met // max(len(all_links), 1), met % max(len(all_links), 1)
    held_pairs, local = np.unique(pair, return_inverse=True)
    in_docs = np.bincount(local, minlength=len(held_pairs))
    totals = [np.where(zero, 0, np.add.reduceat(numbers[codes, k], first)) for k in range(3)]
    links = np.bincount(doc_of, weights=n, minlength=n_docs).astype(np.int64)
    said = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([e[3] for e in entries], pa.string()).take(pa.array(codes))), ";")
    said = pc.if_else(pa.array(zero), "", said)
    bounds = pa.array(np.searchsorted(doc_of, np.arange(n_docs + 1)), pa.int32())
    own = all_links[held_pairs]
    listed = pa.StructArray.from_arrays([pa.array(own >> 32, pa.int32()), pa.array(own & 0xFFFFFFFF, pa.int32()), pa.array(in_docs, pa.int64())], fields=[*PAIR])
    block_pairs = pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), listed), pa.nulls(n_docs - 1, pa.list_(PAIR))])
    columns = [ids, *(pa.array(t, pa.int64()) for t in totals), pa.array(links, pa.int64()), said, pa.array(np.full(n_docs, block, np.int64)), *(pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (local, n)), block_pairs]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "block", "pair_at", "pair_n", "block_pairs"])


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A row for each document: numbers of tokens, groups and links, the groups as text, and its linked pairs as places in its slice's list.

    The first row of a slice holds that list, with how many of the slice's documents have each pair.
    """
    at_a, at_b = tokenizer_path("byte_bpe_50k.json", path_a), tokenizer_path("piece_bpe_32k.model", path_b)
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(("align", at_a, at_b), lambda: Aligner(at_a, at_b))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, most_bytes=4 << 20):
                yield align_slice(aligner, part.column(0), part.column(1), block)
                block += 1

    plain = docs.select(doc_id, text)
    return plain.mapInArrow(at_end(run), ALIGNED.format(id=plain.schema[0].dataType.simpleString()))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): how many documents hold a pair linked, and whether that is the A id's highest."""
    parts = aligned.where("block_pairs is not null").select(F.explode("block_pairs").alias("pair"))
    counts = parts.groupBy("pair.a", "pair.b").agg(F.sum("pair.n").alias("count"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def score_block(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A slice's documents with the sums of their links' counts."""
    import pyarrow.compute as pc

    at = counts["at"].to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at], best[at] = counts["count"].to_numpy(), counts["best"].cast(pa.int64()).to_numpy()
    pair, n = (pc.list_flatten(docs[c]).to_numpy() for c in ("pair_at", "pair_n"))
    doc = np.repeat(np.arange(docs.num_rows), pc.list_value_length(docs["pair_at"]).to_numpy())
    out = docs.drop_columns(["pair_at", "pair_n", "block"])
    for name, weight in (("n_best", best), ("count_sum", count)):
        total = np.zeros(docs.num_rows, np.int64)
        np.add.at(total, doc, n.astype(np.int64) * weight[pair])
        out = out.append_column(name, pa.array(total, pa.int64()))
    return out


def scored(aligned: DataFrame) -> DataFrame:
    """``aligned`` (stored, as it is read several times) with ``n_best`` and ``count_sum`` for each document."""
    parts = aligned.where("block_pairs is not null").select("block", F.posexplode("block_pairs").alias("at", "pair")).select("block", "at", "pair.a", "pair.b")
    counts = parts.join(pair_counts(aligned), ["a", "b"]).select(F.col("block").alias("of_block"), "at", "count", "best")
    docs = aligned.drop("block_pairs")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("pair_at", "pair_n", "block"))
    return docs.groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(score_block, f"{fields}, n_best long, count_sum long")


def query(spark, sf_dir: str) -> DataFrame:
    aligned = align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    return scored(stored(aligned.select(*[digest if c == "groups" else c for c in aligned.columns]), "aligned"))
