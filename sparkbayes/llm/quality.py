"""Quality rules as a learned decision list (operator 5).

Statistics of the whole text are computed once per document. From labelled ones a list of rules is learned by
sequential covering: each rule is a conjunction of thresholds, grown on two thirds of the labelled rows by information
gain over the rows it still covers, then pruned from its end on the other third; the rows it covers are taken away
and the next rule is learned, until a rule is no better than chance. The rules become one Spark expression,
``CASE WHEN rule THEN false ... ELSE true``, that any table with the statistics can use.

Training takes a bounded sample: the ``sample`` labelled documents that come first by a hash of their id.

Defined cases: a null or empty text has no words and all statistics 0; a text of any length is read whole; repeated
rows are judged one by one; of an id with several labels the least counts, of a labelled id with several texts the one
of the least statistics; ties between thresholds go to the earlier statistic and the smaller threshold; with no labels
the list is empty and only the base rules decide; an empty table gives an empty table; columns named like a result are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import at_end, held, ready, slices

SYMBOLS = "#*$%&|<>"
WORD = re.compile(rb"[^\x20\x09-\x0D]")
#: Whole numbers of a text: what the base rules need, then what the learned rules also see.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_letters", "n_distinct_words"]
WINDOW = 5


def repeated(words: list[bytes], size: int = WINDOW) -> tuple[int, int]:
    """(positions inside windows of ``size`` words that the text has twice or more, distinct words). Exact: a window is its words' numbers, packed."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    n = len(ids) - size + 1
    if n < 2 or len(number) == len(ids):
        return 0, len(number)
    bits = max(1, (len(number) - 1).bit_length())
    held = max(1, 64 // bits)
    key = None
    for lo in range(0, size, held):
        part = np.zeros(n, dtype=np.uint64)
        for j in range(lo, min(size, lo + held)):
            part = part << np.uint64(bits) | ids[j : n + j]
        if key is None:
            key = part
        else:  # number the pairs of what is packed so far and the next part
            _, a = np.unique(key, return_inverse=True)
            _, b = np.unique(part, return_inverse=True)
            key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0, len(number)
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[:n] += twice
    edge[size : size + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum()), len(number)


def statistics(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    covered, distinct = repeated(words)
    lines = [x for x in raw.split(b"\n") if WORD.search(x)]
    upper = digits = letters = 0
    plain = raw.translate(CLASSES)
    upper, digits, letters = plain.count(b"U"), plain.count(b"9"), plain.count(b"a") + plain.count(b"U")
    stops = sum(raw.count(x) for x in (b".", b"!", b"?"))
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len({*lines}), covered, len(lines), upper, digits, stops, letters, distinct


#: Bytes by class: U upper case, a other letters and bytes beyond ASCII, 9 digits, the rest a point.
CLASSES = bytes(ord("U") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else ord(".") for b in range(256))


def measure(docs: DataFrame, text: str = "text", *, keep_text: bool = False) -> DataFrame:
    """``docs`` with COUNTS; without ``text`` unless it is to be kept."""
    ready(docs.sparkSession)
    pass_on = [c for c in docs.columns if c not in COUNTS and (keep_text or c != text)]
    plain = docs.select(*pass_on, *([] if keep_text else [text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality", lambda: None)
        for batch in batches:
            for part in slices(batch, text):
                got = [statistics(t or "") for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in pass_on], *(pa.array(x, pa.int64()) for x in zip(*got, strict=True))], names=[*pass_on, *COUNTS])

    fields = [plain.schema[c] for c in pass_on]
    return plain.mapInArrow(at_end(run), T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


#: Ratios by which the learned rules judge: name, above, below.
RATIOS = [
    ("symbols_per_word", "n_symbols", "n_words"),
    ("repeated_share", "n_repeat_words", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("distinct_share", "n_distinct_words", "n_words"),
    ("mean_word", "word_chars", "n_words"),
    ("upper_share", "n_upper", "n_letters"),
    ("digit_share", "n_digits", "word_chars"),
    ("stops_per_word", "n_stops", "n_words"),
    ("letter_share", "n_letters", "word_chars"),
]
FEATURES = ["n_words", *(r[0] for r in RATIOS)]


def features() -> dict[str, Column]:
    return {"n_words": F.col("n_words").cast("double")} | {name: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double") for name, a, b in RATIOS}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    at: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.at if self.above else x[self.feature] <= self.at

    def column(self, columns: dict[str, Column]) -> Column:
        return columns[self.feature] > self.at if self.above else columns[self.feature] <= self.at

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.at:.6g}"


Conjunction = tuple[Test, ...]


def covers(rule: Conjunction, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for test in rule:
        out &= test.covers(x)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Conjunction:
    """Add the test of most information gain until only bad rows are covered."""
    rule: list[Test] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, found = 1e-9, None
        for name in FEATURES:
            v, b = x[name][inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            p, n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
            for above in (True, False):
                pc, nc = (p0 - p, n0 - n) if above else (p, n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pc > 0, pc * (np.log2(pc / (pc + nc)) - np.log2(p0 / (p0 + n0))), -1.0)
                i = int(gain.argmax())
                if gain[i] > best:
                    best, found = float(gain[i]), Test(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if found is None:
            break
        rule.append(found)
        inside &= found.covers(x)
    return tuple(rule)


def prune(rule: Conjunction, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Conjunction, float]:
    """The first tests of the rule that do best on rows it wasn't grown on, by (bad - good) / covered."""

    def worth(r: Conjunction) -> float:
        inside = covers(r, x, len(bad))
        return float(((inside & bad).sum() - (inside & ~bad).sum()) / max(1, inside.sum()))

    kept = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
    return kept, worth(kept)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, most_rules: int = 12, most_tests: int = 4, purity: float = 0.9) -> list[Conjunction]:
    """Rules in order; each rejects. purity: the least worth of a rule on the pruning rows, in shares of rows that are bad."""
    rng = np.random.default_rng(11)
    rules: list[Conjunction] = []
    for _ in range(most_rules):
        if bad.sum() < 5:
            break
        fold = rng.permutation(len(bad)) % 3
        part = lambda keep: {k: v[keep] for k, v in x.items()}
        g, p = fold < 2, fold == 2
        rule = grow(part(g), bad[g], most_tests)
        if not rule:
            break
        rule, worth = prune(rule, part(p), bad[p])
        inside = covers(rule, x, len(bad))
        if worth < 2 * purity - 1 or (inside & bad).sum() < purity * inside.sum():
            break
        rules.append(rule)
        x, bad = {k: v[~inside] for k, v in x.items()}, bad[~inside]
    return rules


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = 6000) -> list[Conjunction]:
    """Rules from the first ``sample`` labelled documents by hash of their id (quality 0: bad)."""
    known = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(quality).cast("int").alias("_q")).groupBy("_id").agg(F.min("_q").alias("_q"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # at most ``sample`` pairs of numbers
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    made = features()
    seen = measure(rows, "_text").select("_id", "_q", F.struct(*[c.alias(f"f_{k}") for k, c in made.items()]).alias("f"))
    seen = seen.groupBy("_id", "_q").agg(F.min("f").alias("f")).select("_id", "_q", "f.*").orderBy("_id").toPandas()  # a row per chosen id, however often it is met
    if seen.empty:
        return []
    return learn({k: seen[f"f_{k}"].to_numpy() for k in FEATURES}, seen["_q"].to_numpy() == 0)


def verdict(rules: list[Conjunction]) -> Column:
    """True where no rule rejects."""
    columns, out = features(), None
    for rule in rules:
        test = F.lit(True)
        for t in rule:
            test = test & t.column(columns)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Conjunction], text: str = "text", *, keep_text: bool = False) -> DataFrame:
    """``docs`` with COUNTS, ``base_failed`` and ``kept``; without ``text`` unless it is to be kept."""
    seen = measure(docs, text, keep_text=keep_text)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return seen.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = train(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
