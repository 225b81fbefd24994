"""Language identification (operator 4).

A text's features are the relative frequencies of character n-grams inside its words, runs of letters padded by a blank
on either side, weighted by inverse document frequency and hashed into ``2**bits`` places. A sparse multinomial
logistic regression is trained on them, one example at a time, by follow-the-regularised-leader with per-coordinate
rates and elastic-net penalties: the l1 part leaves most weights at exactly zero. The constant is one more
coordinate, without penalties. A temperature fitted on labelled documents held back from training then calibrates
the probabilities; their labels are softened by one example's worth of doubt, so that it also has a best value
where every one of them is predicted right.

Texts are read whole, in slices of bounded bytes, a long one in windows of bounded length; nothing is kept of them
between slices.

Training takes a bounded sample: of each language the different labelled texts that come first by hash, ``sample``
texts in all, each one featurised on the executors into at most ``2**bits`` counts. The document frequencies are
those of the sample, as they are part of the fit. All other documents only are predicted.

Defined cases: null text, or one without a letter, is ``und`` with score 0; ties go to the language that sorts
first; equal texts get equal predictions; a text of any length is read to its end; an empty table gives an empty
table; with no labelled document at all every text is ``und`` with score 0; columns named like a result are
replaced, other columns pass through.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import at_end, held, ready, slices

MULTIPLIERS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]
WINDOW = 1 << 18  # code points read at a time


@cache
def in_words() -> np.ndarray:
    """For each code point, whether it is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def codes_of(text: str) -> np.ndarray:
    """Lower-cased code points between two blanks; all that is no letter is a blank."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(in_words()[codes], codes, np.uint32(32))


def grams(codes: np.ndarray, most: int, bits: int, lo: int, hi: int) -> np.ndarray:
    """The places of all n-grams of up to ``most`` characters that begin at lo .. hi - 1 and hold a blank at their ends only."""
    found = []
    part = codes[lo : min(len(codes), hi + most - 1)]
    blank = part == 32
    n_starts = min(hi, len(codes)) - lo
    key = np.zeros(len(part), dtype=np.uint32)
    inner = np.zeros(len(part), dtype=bool)  # whether a blank lies before the last character and behind the first
    for n in range(1, most + 1):
        m = min(n_starts, len(part) - n + 1)
        if m <= 0:
            break
        key = key[:m] * np.uint32(0x01000193) + part[n - 1 : n - 1 + m] * MULTIPLIERS[(n - 1) % len(MULTIPLIERS)]
        if n > 2:
            inner = inner[:m] | blank[n - 2 : n - 2 + m]
        fine = ~blank[:m] if n == 1 else ~(inner[:m] | blank[:m] & blank[n - 1 : n - 1 + m])
        h = key[fine] ^ np.uint32(n)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append(((h ^ (h >> np.uint32(13))) & np.uint32((1 << bits) - 1)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def tallied(text: str, most: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of a whole text."""
    codes = codes_of(text)
    if len(codes) <= WINDOW:
        places = grams(codes, most, bits, 0, len(codes))
        if len(places) < 1 << bits:
            return np.unique(places, return_counts=True)
        total = np.bincount(places, minlength=1 << bits)
    else:
        total = np.zeros(1 << bits, dtype=np.int64)
        for lo in range(0, len(codes), WINDOW):
            total += np.bincount(grams(codes, most, bits, lo, min(lo + WINDOW, len(codes))), minlength=1 << bits)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # places x languages, already times the inverse document frequency
    bias: np.ndarray
    temperature: float
    most: int
    bits: int

    def scores(self, text: str) -> np.ndarray:
        """Each language's evidence, before the temperature: sums of weights over the n-grams, by their number."""
        codes, total, n = codes_of(text), np.zeros(len(self.languages)), 0
        for lo in range(0, len(codes), WINDOW):
            at = grams(codes, self.most, self.bits, lo, min(lo + WINDOW, len(codes)))
            step = max(1, (1 << 20) // len(self.languages))
            for a in range(0, len(at), step):
                total += self.weights[at[a : a + step]].sum(axis=0, dtype=np.float64)
            n += len(at)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text):
            return "und", 0.0
        p = softmax(self.scores(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def features(docs: DataFrame, text: str, lang: str, most: int, bits: int) -> DataFrame:
    """(lang, places, counts): hashed n-gram counts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("langid", lambda: None)
        for batch in batches:
            for part in slices(batch, 0):
                got = [tallied(t, most, bits) for t in part.column(0).to_pylist()]
                lists = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([g[0].astype(np.int32) for g in got], lists), pa.array([g[1].astype(np.int32) for g in got], lists)], names=["lang", "places", "counts"])

    return docs.select(text, lang).mapInArrow(at_end(run), "lang string, places array<int>, counts array<int>")


def sampled(docs: DataFrame, text: str, lang: str, sample: int) -> DataFrame:
    """(text, lang): of each language the same number of different texts, those that come first by hash; ``sample`` in all, at least one of each."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    keyed = labelled.withColumn("_h", F.xxhash64("text"))
    # The bounds first, on two values a row; the texts are then read for the chosen rows alone.
    n = keyed.select("lang").distinct().count()
    if not n:
        return labelled.limit(0)
    most, bounds = max(1, sample // n), keyed.select("lang", "_h").distinct()
    for salt in ([F.pmod("_h", F.lit(64))], []):  # a language's hashes meet in one task only after each salt has kept its first
        rank = F.row_number().over(Window.partitionBy("lang", *salt).orderBy("_h"))
        bounds = bounds.withColumn("_r", rank).where(F.col("_r") <= most).select("lang", "_h")
    bounds = bounds.groupBy("lang").agg(F.max("_h").alias("_last"))
    chosen = keyed.join(F.broadcast(bounds), "lang").where(F.col("_h") <= F.col("_last"))  # a row per language
    return chosen.groupBy("_h").agg(F.min("text").alias("text"), F.min("lang").alias("lang")).select("text", "lang")


class Ftrl:
    """Follow the regularised leader, per coordinate, for one softmax."""

    def __init__(self, places: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.squares = np.zeros((places, classes)), np.zeros((places, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.squares[at])) / self.alpha + self.l2))

    def update(self, at, w: np.ndarray, gradient: np.ndarray) -> None:
        grown = self.squares[at] + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(self.squares[at])) / self.alpha * w
        self.squares[at] = grown


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], *, most: int, bits: int, passes: int, alpha: float, beta: float, l1: float, l2: float, scale: float) -> Model:
    """The model of (language, places, counts) examples, in the order given by a fixed permutation."""
    languages = sorted({r[0] for r in rows})
    frequency = np.zeros(1 << bits)
    for _, at, _ in rows:
        frequency[at] += 1
    idf = np.where(frequency > 0, np.log((1 + len(rows)) / (1 + frequency)) + 1, 0.0)
    order = np.random.default_rng(7).permutation(len(rows))
    back = {*order[::8].tolist()} if len(rows) >= 16 else set()
    data = [(languages.index(y), at, scale * n * idf[at] / n.sum()) for y, at, n in rows]
    main = Ftrl(1 << bits, len(languages), alpha, beta, l1, l2)
    constant = Ftrl(1, len(languages), alpha, beta, 0.0, 0.0)
    for _ in range(passes):
        for i in order:
            if int(i) in back:
                continue
            y, at, x = data[i]
            w, b = main.weights(at), constant.weights([0])
            p = softmax(x @ w + b[0])
            p[y] -= 1.0
            main.update(at, w, x[:, None] * p[None, :])
            constant.update([0], b, p[None, :])
    weights, bias = main.weights(slice(None)), constant.weights([0])[0]
    check = [data[i] for i in sorted(back)] or data
    scores = np.array([x @ weights[at] + bias for _, at, x in check])
    temperature = calibrate(scores, np.array([y for y, _, _ in check]))
    return Model(languages, (weights * idf[:, None] * scale).astype(np.float32), bias, temperature, most, bits)


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    *,
    sample: int = 1500,
    most: int = 3,
    bits: int = 16,
    passes: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.2,
    l2: float = 0.01,
    scale: float = 20.0,
) -> Model | None:
    """A model of the languages of ``sample`` labelled documents; None if there is none.

    alpha, beta: the per-coordinate learning rate is alpha / (beta + root of the squared gradients' sum).
    scale: by how much relative frequencies are multiplied, so that penalties mean the same at every text length.
    """
    got = features(sampled(docs, text, lang, sample), "text", "lang", most, bits).collect()
    rows = [(r.lang, np.array(r.places, dtype=np.int64), np.array(r.counts, dtype=float)) for r in sorted(got, key=lambda r: (r.lang, r.places, r.counts)) if r.places]
    return fit(rows, most=most, bits=bits, passes=passes, alpha=alpha, beta=beta, l1=l1, l2=l2, scale=scale) if rows else None


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def calibrate(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm; the labels together hold one example's doubt, spread over all classes."""
    n, k = scores.shape
    target = np.full((n, k), 1 / (k * (n + 1)))
    target[np.arange(n), truth] += n / (n + 1)

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        top = s.max(axis=1, keepdims=True)
        return float(np.mean((target * (np.log(np.exp(s - top).sum(axis=1, keepdims=True)) + top - s)).sum(axis=1)))

    lo, hi, ratio = np.log(1e-3), np.log(1e3), (5**0.5 - 1) / 2
    for _ in range(80):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def predict(docs: DataFrame, model: Model | None, text: str = "text", *, keep_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; without ``text`` unless it is to be kept."""
    ready(docs.sparkSession)
    pass_on = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text)]
    plain = docs.select(*pass_on, *([] if keep_text else [text]))
    if model is None:
        return plain.select(*pass_on, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits places by the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("langid", lambda: None)
        own = sent.value
        for batch in batches:
            for part in slices(batch, text):
                got = [own.predict(t) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in pass_on], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*pass_on, "lang_pred", "score"])

    fields = [plain.schema[c] for c in pass_on]
    return plain.mapInArrow(at_end(run), T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model)
