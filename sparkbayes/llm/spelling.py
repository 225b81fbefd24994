"""Spelling variants grouped by words one edit apart (operator 11).

Words are counted over all texts. Every word has a mask of letter parities: each letter flips one bit, so one edit
flips at most two bits of a mask, and of its three bands at least one stays as it was. Letters are dealt to the bands
by how often words hold them, so that the bands tell about equally much. Words meet where a band is equal and their
lengths differ by one at most; a band's key also carries the first or the last half of the shorter word, one of which
an edit leaves alone, so that few words meet for nothing. What meets is verified by its edit distance, once for each pair.

A word's form is its most frequent near word, if that is frequent enough; forms are followed to their ends by pointer
doubling, in as many rounds as the logarithm of the longest chain, which is itself at most log2 of the largest count.

Defined cases: a null, empty or letterless text has no words; a null id counts as an empty one in the hash; repeated
rows count each; ties between near words go to the one first in code-point order; a text or a run of any length is read
whole; an empty table gives no words; columns other than the id and the text are not used.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_end, discard, ready, slices, stored, table

#: Everything that isn't part of a run, once A-Z are lower-cased; runs may hold the letters from U+00C0 to U+00FF.
BETWEEN = "[^a-zÀ-ÿ]+"
LETTERS = 256  # code points below this can occur in a word
BAND = 21  # bits of each of the three bands
LONG = 64  # bytes of a run up to which hashes are computed many at a time


def crc_table() -> np.ndarray:
    """CRC-32 of each byte, by the reflected polynomial."""
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, (rest >> 1) ^ np.uint32(0xEDB88320), rest >> 1).astype(np.uint32)
    return rest


def hashes(prefixes: list[bytes], runs: list[bytes], of_prefix: np.ndarray, of_run: np.ndarray) -> np.ndarray:
    """CRC-32 of prefix and run together, for every pair of numbers.

    A checksum is linear: that of the whole is that of the prefix moved on by as many zero bytes as the run has, xor that of the run.
    """
    table, size = crc_table(), np.array([len(r) for r in runs], np.int64)
    moved = np.empty((min(int(size.max(initial=0)), LONG) + 1, len(prefixes)), np.uint32)
    moved[0] = [zlib.crc32(p) for p in prefixes]
    for i in range(1, len(moved)):
        moved[i] = (moved[i - 1] >> 8) ^ table[moved[i - 1] & 255]
    out = moved[np.minimum(size, LONG)[of_run], of_prefix] ^ np.array([zlib.crc32(r) for r in runs], np.uint32)[of_run]
    for i in np.flatnonzero(size[of_run] > LONG).tolist():
        out[i] = zlib.crc32(runs[of_run[i]], zlib.crc32(prefixes[of_prefix[i]]))
    return out


def count_slice(part: pa.RecordBatch, doc_id: str, text: str, every: int, least: int) -> Counter:
    """Words of a slice's texts with their numbers; one run in ``every`` (by its hash) loses a letter."""
    import pyarrow.compute as pc

    texts = pc.ascii_lower(part.column(text).cast(pa.string()).fill_null(""))
    cut = pc.split_pattern_regex(texts, BETWEEN)
    runs = cut.flatten().dictionary_encode()
    number, size = runs.indices.to_numpy(), pc.utf8_length(runs.dictionary).to_numpy()
    where = np.repeat(np.arange(part.num_rows), np.diff(cut.offsets.to_numpy()))
    enough = size[number] >= least
    number, where, words = number[enough], where[enough], runs.dictionary.to_pylist()
    ids = ["" if d is None else str(d) for d in part.column(doc_id).to_pylist()]
    h = hashes([f"{d}:".encode() for d in ids], [w.encode() for w in words], where, number)
    whole = h % every != 0
    n = np.bincount(number[whole], minlength=len(words))
    out = Counter({words[i]: int(n[i]) for i in np.flatnonzero(n).tolist()})
    for i, x in zip(number[~whole].tolist(), h[~whole].tolist(), strict=True):
        at = x % len(words[i])
        if len(words[i]) > least:
            out[words[i][:at] + words[i][at + 1 :]] += 1
    return out


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, every: int = 97, least_letters: int = 5, least_n: int = 3, most_words: int = 200_000) -> DataFrame:
    """(word, n) of all words of at least so many letters that occur at least so often; tasks pre-aggregate up to ``most_words`` at a time."""
    ready(docs.sparkSession)

    def sent(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*words], pa.string()), pa.array([*words.values()], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for part in slices(batch, text):
                words.update(count_slice(part, doc_id, text, every, least_letters))
                if len(words) > most_words:
                    yield sent(words)
                    words = Counter()
        yield sent(words)

    plain = docs.select(F.col(doc_id).cast("string").alias(doc_id), text)
    return plain.mapInArrow(at_end(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def letter_bits(words: DataFrame) -> list[int]:
    """The bit each letter flips, by code point: letters from frequent to rare go round the three bands and their bits."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()  # one row a letter, fewer than LETTERS
    bits = [0] * LETTERS
    for i, row in enumerate(sorted(letters, key=lambda r: (-r["count"], r["letter"]))):
        turn, place = divmod(i, 3)
        band = place if turn % 2 == 0 else 2 - place
        bits[ord(row["letter"])] = 1 << (band * BAND + turn % BAND)
    return bits


def mask_of(word: Column, bits: list[int]) -> Column:
    flips = F.array(*[F.lit(b).cast("long") for b in bits])
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(F.element_at(flips, F.ascii(c) + 1)))


def near_pairs(words: DataFrame, least_letters: int = 5) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words one edit apart, once; ``words`` has distinct ``word`` of at least so many letters, and ``n``."""
    bands = [((1 << BAND) - 1) << (BAND * i) for i in range(3)]
    masked = words.select("word", "n", F.char_length("word").alias("size"), mask_of(F.col("word"), letter_bits(words)).alias("mask"))

    def keys(shorter: Column) -> Column:
        """The slot's number and key for three bands and two halves, where the shorter word of a pair has so many letters."""
        half = F.floor(shorter / 2).cast("int")
        halves = [F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), F.col("size") - (shorter - half) + 1, shorter - half)]
        slots = [(2 * i + j, F.col("mask").bitwiseAND(F.lit(band)), anchor) for i, band in enumerate(bands) for j, anchor in enumerate(halves)]
        return F.array(*[F.struct(F.lit(slot).cast("byte").alias("slot"), F.xxhash64(shorter, F.lit(slot), value, anchor).alias("key")) for slot, value, anchor in slots])

    def side(found: DataFrame, role: str) -> DataFrame:
        return found.select("at.key", "at.slot", *[F.col(c).alias(f"{c}_{role}") for c in ("word", "n", "size", "mask")])

    own = masked.withColumn("at", F.explode(keys(F.col("size"))))
    longer = masked.where(F.col("size") > least_letters).withColumn("at", F.explode(keys(F.col("size") - 1)))
    a, b = side(own, "a"), side(own.unionByName(longer), "b")
    flipped = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    changed = [flipped.bitwiseAND(F.lit(band)) != 0 for band in bands]
    half = F.floor(F.col("size_a") / 2).cast("int")
    first_half = F.substring(F.col("word_a"), F.lit(1), half) == F.substring(F.col("word_b"), F.lit(1), half)
    # A pair may meet in several slots: the first band that is equal and the first half that is equal count.
    once = F.when(F.col("slot") < 2, F.lit(True)).when(F.col("slot") < 4, changed[0]).otherwise(changed[0] & changed[1]) & ((F.col("slot") % 2 == 0) | ~first_half)
    ordered = (F.col("size_b") == F.col("size_a") + 1) | ((F.col("size_b") == F.col("size_a")) & (F.col("word_a") < F.col("word_b")))
    met = a.join(b, ["key", "slot"]).where(ordered & (F.bit_count(flipped) <= 2) & once)
    return met.where(F.levenshtein("word_a", "word_b", 1) == 1).select(F.col("word_a").alias("a"), F.col("n_a"), F.col("word_b").alias("b"), F.col("n_b"))


def follow(forms: DataFrame, name: str = "spelling-roots") -> DataFrame:
    """(word, root) from (word, form) by pointer doubling; forms must not go in circles."""
    roots = stored(forms.select("word", F.col("form").alias("root")), name)
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), name)
        discard(roots)
        roots = moved
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, times: int = 2, every: int = 97, least_letters: int = 5, least_n: int = 3) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words: a form is the most frequent near word, if at least ``times`` as frequent."""
    words = stored(word_counts(docs, doc_id, text, every=every, least_letters=least_letters, least_n=least_n), "spelling-words")
    pairs = near_pairs(words, least_letters)
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("word"), (-F.col(f"n_{y}")).alias("less"), F.col(y).alias("near")) for x, y in ("ab", "ba")]))
    near = pairs.select(ways.alias("at")).groupBy("at.word").agg(F.count("*").alias("n_near"), F.min(F.struct("at.less", "at.near")).alias("best"))
    known = words.join(near, "word", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    known = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "spelling-forms")
    discard(words)
    roots = follow(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::UINTEGER AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents) GROUP BY 1, 2),
hexed AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 5),
hashed AS (SELECT run, n, xor(4294967295::UINTEGER, list_reduce(list_prepend(4294967295::UINTEGER, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INT + 1, 2))::UINTEGER)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM hexed, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM words, range(length(word)) t(i)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS form, max(near_n) AS form_n FROM near GROUP BY word),
known AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
ways AS (SELECT word, word AS at, form AS ahead FROM known UNION ALL SELECT w.word, k.word, k.form FROM ways w JOIN known k ON k.word = w.ahead)
SELECT k.word, k.form, w.at AS root, k.n, k.n_near, k.form_n FROM known k JOIN ways w ON k.word = w.word WHERE w.ahead IS NULL
"""
