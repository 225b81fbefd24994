"""Token counts by a compiled finite-state transducer (operator 8).

The vocabulary is compiled, state by state as inputs reach them, into a deterministic transducer over bytes whose
transitions carry the number of tokens they emit. A state holds, for each start from which a token could still
come to end here, the place in the vocabulary's prefix tree, the last token before that start and the count there
relative to the count here. One byte later exactly one token fits: one that ends here, whose left neighbour and
itself survive byte-pair merging side by side. Its count less the count before is what the transition emits.

The pre-tokenizer is a scanner over character classes: whether a pre-token begins at a character is told from the
character before and three after it. Where one begins the transducer is in its first state again.

Texts, one after another, are cut into chunks of fixed size, which go through the transducer side by side, a byte of
each at a time. A chunk's map takes the state it is entered in to the state it is left in and to what its bytes emit.
Behind the chunk's first beginning of a pre-token the map is constant, and that part needs no entry state; the part
before it is run once the entry state is known. The maps compose in a prefix scan: every round resolves all chunks
whose left neighbour's exit state is known, which after the first round only chunks inside one long pre-token aren't.
All texts take this path, of whatever length; a text's count is the sum of what its bytes emit.

Defined cases: null text is the empty text with no bytes and no tokens; a special string inside a text is one token
and parts it; a text of any length is counted whole, in windows of bounded size that hand their state on; equal and
repeated rows are counted one by one; an empty table gives an empty table; clashing names (n_bytes, n_tokens) are
replaced, other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Merges, byte_chars
from .common import Memo, at_end, held, ready, slices, tokenizer_path

CHUNK = 256  # bytes
WINDOW = 1 << 20  # characters
LETTER, NUMBER, OTHER, SPACE, END = range(5)


class Transducer:
    """Counts the tokens of pre-tokens; compiled lazily into a hash table of transitions, begun anew beyond ``limit`` of them."""

    def __init__(self, merges: Merges, limit: int = 800_000):
        of_char = {c: b for b, c in enumerate(byte_chars())}
        self.merges, self.limit = merges, limit
        self.bytes_of = {i: bytes(of_char[c] for c in s) for s, i in merges.vocab.items()}
        self.single = [0] * 256
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        for i, raw in self.bytes_of.items():
            node = 0
            for b in raw:
                if (at := self.child.get(node << 8 | b)) is None:
                    at = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                node = at
            self.token[node] = i
            if len(raw) == 1:
                self.single[raw[0]] = i
        self.fits = Memo(self._fits, 24 << 20)
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [(0, -1, 0)]  # (node, token before, count) of each open start, flat
        self.number = {self.states[0]: 0}
        self.bits, self.used = 16, 0
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.to, self.emits = np.zeros(1 << self.bits, dtype=np.int32), np.zeros(1 << self.bits, dtype=np.int16)

    def trim(self) -> None:
        self.fits.trim()
        if self.used > self.limit:
            self.reset()

    def _fits(self, pair: int) -> bool:
        """Whether two tokens side by side stay as they are when their bytes are merged together."""
        a, b = pair >> 24, pair & 0xFFFFFF
        return self.merges.merge([self.single[x] for x in self.bytes_of[a] + self.bytes_of[b]]) == [a, b]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        opened, found, last = [], None, -1
        held_, child, token = self.states[state], self.child, self.token
        for at in range(0, len(held_), 3):
            to = child.get(held_[at] << 8 | byte)
            if to is None:
                continue
            before, count = held_[at + 1], held_[at + 2]
            opened.append((to, before, count))
            if found is None and (ends := token[to]) >= 0 and (before < 0 or self.fits[before << 24 | ends]):
                found, last = count + 1, ends
        if found is None:
            raise ValueError("the vocabulary has no token that ends here")
        key = tuple([x for node, before, count in opened for x in (node, before, count - found)]) + (0, last, 0)
        if (at := self.number.get(key)) is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
        return at, found

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, to: np.ndarray, emits: np.ndarray) -> None:
        """Different new keys into the table, which is at most two fifths full."""
        self.used += len(keys)
        if 5 * self.used > 2 << self.bits:
            old = np.flatnonzero(self.keys >= 0)
            keys, to, emits = np.append(self.keys[old], keys), np.append(self.to[old], to), np.append(self.emits[old], emits)
            while 5 * self.used > 2 << self.bits:
                self.bits += 1
            self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
            self.to, self.emits = np.zeros(1 << self.bits, dtype=np.int32), np.zeros(1 << self.bits, dtype=np.int16)
        at, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.to[at], self.emits[at] = to, emits

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, tokens emitted), side by side."""
        key = (state << 8) | byte
        at = self.slots(key)
        got = self.keys[at]
        off = np.flatnonzero(got != key)
        while len(off):
            if (got[off] < 0).any():
                new = np.unique(key[off[got[off] < 0]])
                made = [self._compile(k >> 8, k & 255) for k in new.tolist()]
                self.put(new, np.array([m[0] for m in made], dtype=np.int32), np.array([m[1] for m in made], dtype=np.int16))
                at = self.slots(key)
            else:
                at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at]
            off = np.flatnonzero(got != key)
        return self.to[at].astype(np.int64), self.emits[at]

    def run(self, raw: np.ndarray, begins: np.ndarray, entry: int = 0, size: int = CHUNK) -> tuple[np.ndarray, int]:
        """(what each byte emits, exit state) of bytes entered in a state; ``begins`` tells where the first state is taken."""
        n = len(raw)
        lanes = max(1, -(-n // size))
        pad = lanes * size - n
        bytes_ = np.append(raw, np.zeros(pad, dtype=np.uint8)).reshape(lanes, size).T.astype(np.int64)
        begins = np.append(begins, np.zeros(pad, dtype=bool)).reshape(lanes, size).T.copy()
        ends = np.full(lanes, size)
        ends[-1] -= pad
        out = np.zeros((size, lanes), dtype=np.int16)
        known = begins.any(axis=0)
        first = np.where(known, begins.argmax(axis=0), ends)
        leave = np.zeros(lanes, dtype=np.int64)

        def go(which: np.ndarray, state: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            """Chunks ``which`` from byte lo to hi each, and their exit states."""
            for j in range(int(lo.min()), int(hi.max())):
                on = np.flatnonzero((lo <= j) & (j < hi))
                if len(on) < len(which):
                    now, at = np.where(begins[j, which[on]], 0, state[on]), which[on]
                else:
                    now, at = np.where(begins[j, which], 0, state), which
                state[on], out[j, at] = self.step(now, bytes_[j, at])
            leave[which] = state

        whole = np.flatnonzero(known)
        if len(whole):
            go(whole, np.zeros(len(whole), dtype=np.int64), first[whole], ends[whole])
        open_ = np.flatnonzero(first > 0)
        while len(open_):
            ready_ = open_[(open_ == 0) | known[open_ - 1]]
            enter = np.where(ready_ == 0, entry, leave[ready_ - 1])
            exits = leave[ready_].copy()
            if len(ready_) > 4:
                go(ready_, enter, np.zeros(len(ready_), dtype=np.int64), first[ready_])
            else:
                for lane, state in zip(ready_.tolist(), enter.tolist(), strict=True):
                    leave[lane] = self.alone(bytes_[:, lane], out[:, lane], state, int(first[lane]))
            leave[ready_] = np.where(known[ready_], exits, leave[ready_])
            known[ready_] = True
            open_ = np.setdiff1d(open_, ready_, assume_unique=True)
        return out.T.reshape(-1)[:n], int(leave[-1])

    def alone(self, raw: np.ndarray, out: np.ndarray, state: int, n: int) -> int:
        """One chunk's first bytes, one by one."""
        for j, b in enumerate(raw[:n].tolist()):
            key = state << 8 | b
            if (hit := self.single_steps.get(key)) is None:
                to, emitted = self.step(np.array([state]), np.array([b]))
                hit = self.single_steps[key] = int(to[0]), int(emitted[0])
            state, out[j] = hit
        return state

    @property
    def single_steps(self) -> dict[int, tuple[int, int]]:
        """Some transitions once more, for single steps; of this table only."""
        if getattr(self, "_steps_of", None) is not self.number or len(self._steps) > 20_000:
            self._steps_of, self._steps = self.number, {}
        return self._steps


class Counter:
    """Counts of whole texts: scanner and transducer."""

    # The pattern by which the tokenizer file's byte-level pre-tokenizer cuts a text. The scanner below says the same.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, limit: int = 800_000):
        import regex

        merges = Merges(path)
        self.machine = Transducer(merges, limit)
        self.special = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None
        self.hints = tuple(merges.special)
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.classes = np.full(0x110000, OTHER, dtype=np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, everything):
                lo, hi = ord(m[0][0]), ord(m[0][-1])
                self.classes[lo : hi + 1] = kind

    def begins(self, codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin, of characters and their classes; at the ends as if texts ended there."""
        n = len(codes)
        before, after = np.full(n, END, dtype=np.uint8), np.full(n, END, dtype=np.uint8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        blank_before = np.zeros(n, dtype=bool)
        blank_before[1:] = codes[:-1] == 32
        blank_before &= before == SPACE
        # White space: the run's first character, and its last one if the text goes on. Else: a run's first, unless a blank before it is taken along.
        out = np.where(kind == SPACE, (before != SPACE) | (after < SPACE), (before != kind) & ~blank_before) | (kind == END)
        at = np.flatnonzero(out & (codes == 39) & (kind == OTHER))  # 's 't 'm 'd 're 've 'll
        if len(at):
            far = np.append(np.where(kind == END, 0, codes), np.zeros(3, dtype=codes.dtype))
            one, two = far[at + 1], far[at + 2]
            short = np.isin(one, [115, 116, 109, 100])
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            out[at[short | long] + 1] = False
            rest = np.append(at[short] + 2, at[long] + 3)
            rest = rest[rest < n]
            out[rest] |= kind[rest] == LETTER
        return out

    def emitted(self, text: str, ends: np.ndarray, size: int = CHUNK, window: int = WINDOW) -> np.ndarray:
        """Tokens up to each end (in characters) of a string of parts; one character behind each end but the last parts them."""
        marks = ends[:-1]
        total, state, found = 0, 0, np.zeros(len(ends), dtype=np.int64)
        for lo in range(0, len(text), window):
            hi = min(lo + window, len(text))
            a, b = max(0, lo - 4), min(len(text), hi + 4)
            codes = np.frombuffer(text[a:b].encode("utf-32-le"), dtype="<u4")
            kind = self.classes[codes]
            inside = marks[(marks >= a) & (marks < b)] - a
            kind[inside] = END
            begins = self.begins(codes, kind)[lo - a : hi - a]
            raw = np.frombuffer(text[lo:hi].encode(), dtype=np.uint8)
            codes = codes[lo - a : hi - a]
            width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            upto = np.cumsum(width)
            flags = np.zeros(len(raw), dtype=bool)
            flags[(upto - width)[begins]] = True
            tokens, state = self.machine.run(raw, flags, state, size)
            tokens = np.append(0, np.cumsum(tokens, dtype=np.int64))
            some = np.flatnonzero((ends > lo) & (ends <= hi))
            found[some] = total + tokens[upto[ends[some] - lo - 1]]
            total += int(tokens[-1])
            self.machine.fits.trim()
        return found

    def counts(self, texts: pa.Array, size: int = CHUNK, window: int = WINDOW) -> np.ndarray:
        """Tokens of each text."""
        parts, owner, extra = [], [], np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts.to_pylist()):
            if not t:
                continue
            own = self.special.split(t) if any(h in t for h in self.hints) else [t]
            extra[i] = len(own) - 1
            own = [x for x in own if x]
            parts += own
            owner += [i] * len(own)
        if not parts:
            return extra
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = np.cumsum(sizes + 1) - 1
        upto = self.emitted("\n".join(parts), ends, size, window)
        # The parting line end before a part is one token.
        np.add.at(extra, owner, np.diff(np.append(0, upto)) - np.append(0, np.ones(len(parts) - 1, dtype=np.int64)))
        self.machine.trim()
        return extra


def count_tokens(df: DataFrame, text: str = "text", *, path: str | None = None) -> DataFrame:
    """``df`` without its text, with ``n_bytes`` (UTF-8) and ``n_tokens``."""
    at = tokenizer_path("byte_bpe_50k.json", path)
    ready(df.sparkSession)
    pass_on = [c for c in df.columns if c not in (text, "n_bytes", "n_tokens")]
    plain = df.select(*pass_on, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(("token_count", at), lambda: Counter(at))
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                texts = part.column(text)
                out = [pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(counter.counts(texts))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in pass_on], *out], names=[*pass_on, "n_bytes", "n_tokens"])

    fields = [f for f in plain.schema if f.name != text]
    return plain.mapInArrow(at_end(run), T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > 512)
