"""Exact Jaccard join on word shingles by token-combination prefixes (operator 9).

Tokens are 64-bit hashes of shingles, and sets are compared by them: two shingles of one hash would count as equal. One pass counts in how many different texts each token is; bit maps of fixed
size carry the result to every task, one for each class: tokens that at least 2, 4, 16 .. texts may share, and
frequent ones, which more than ``frequent`` texts may share. False bits cost work and never a link. All sets are
ordered alike: unshared tokens, then rare ones by class, then frequent ones, by hash within each class.

Two sets with an overlap of at least o share their k smallest common tokens within the first n - o + k places of
both. With k = 1, that place range without frequent tokens is indexed by its single rare tokens; a set whose first
unshared tokens fill it can have no partner and is left out. A set that reaches into its frequent tokens extends the
range by k - 1 places and indexes all k-combinations of the frequent ones there, beside all of its rare tokens.
Sets of ``long`` tokens or more index single frequent tokens instead, sets of nearly that size do both.

Texts with equal sets are one node. Nodes with a common key are candidates, and what counts is each node's component,
so pairs inside a component needn't be looked at: in a few rounds one pivot per key, the node with the fewest tokens
of its own, is verified against the other components' members of the key. What then is left, pairs of one key in
different components of which at most one is the key's largest, is verified in full. Every pair at or above the
threshold ends in one component. Wherever two sets meet at a key, the places of its tokens bound their overlap, as if
no smaller common key existed; a pair out of reach is left to its smaller keys. No key's group comes to a single task, and nothing but the bit maps to the driver.

Defined cases: null and empty texts, and texts of white space, have empty sets and are linked with nothing; a text of
any length is read whole; one of fewer words than a shingle has its whole word sequence as its only token; repeated rows are one node, each with
its own row in the result; component_id is the least non-null id; an empty table gives an empty table; other columns
are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_end, cut_blocks, discard, ready, slices, stored
from .common import held as keep

FLUSH = 1_500_000
SEEDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted different tokens."""
    words, numbers, bounds = cut_blocks(pc.ascii_lower(texts.fill_null("")))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    at = numbers.astype(np.int64)
    flat = hashes[at] if len(at) else np.zeros(0, dtype=np.uint64)
    ends = bounds.astype(np.int64) - int(bounds[0])
    if "" in words:  # what stands before leading and behind trailing white space
        real = at != words.index("")
        flat, ends = flat[real], np.append(0, np.cumsum(real))[ends]
    whole = np.zeros(max(0, len(flat) - width + 1), dtype=np.uint64)
    for j in range(width):
        whole = mixed(whole * np.uint64(SEEDS[j % len(SEEDS)]) + flat[j : len(whole) + j])
    for lo, hi in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        if hi - lo >= width:
            yield np.unique(whole[lo : hi - width + 1])
        elif hi == lo:
            yield flat[:0]
        else:
            one = np.array([hi - lo], dtype=np.uint64)
            for j in range(hi - lo):
                one = mixed(one * np.uint64(SEEDS[j % len(SEEDS)]) + flat[lo + j])
            yield one


def identity(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def counts(docs: DataFrame, width: int, bucket_bits: int, frequent: int) -> DataFrame:
    """(bucket, blob): sorted 32-bit tails of the tokens of different texts, as differences in byte planes."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held) >> np.uint64(32 - bucket_bits))
        new = np.append(True, keys[1:] != keys[:-1])
        rank = np.arange(len(keys)) - np.flatnonzero(new)[np.cumsum(new) - 1]  # how often the key came before
        keys = keys[rank <= frequent]
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        tails = keys.astype(np.uint32)
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        blobs = []
        for lo, hi in zip(starts, np.append(starts[1:], len(keys)), strict=True):
            steps = np.diff(tails[lo:hi], prepend=np.uint32(0)).astype("<u4")
            blobs.append(steps.view(np.uint8).reshape(-1, 4).T.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("jaccard", lambda: None)
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        total = 0
        for batch in batches:
            for part in slices(batch, 0):
                for tokens in sets(part.column(0), width):
                    if len(tokens) and (own := identity(tokens)) not in seen:
                        seen.add(own)
                        held.append(tokens)
                        total += len(tokens)
                        if total >= FLUSH:
                            yield emit(held)
                            held, total = [], 0
        if held:
            yield emit(held)

    return docs.select("text").mapInArrow(at_end(run), "bucket int, blob binary")


def levels_of(frequent: int) -> list[int]:
    """Least numbers of texts of the classes above the unshared tokens; the last class is the frequent one."""
    return [*(x for x in (2, 4, 16, 64, 256) if x <= frequent), frequent + 1]


def map_bits(bits: int, bucket_bits: int, level: int) -> int:
    """Tokens that many texts share are few: maps beyond the first have a sixteenth of its bits."""
    return bits if level == 0 else max(bits - 4, bucket_bits + 3)


def bit_maps(counted: DataFrame, bits: int, bucket_bits: int, frequent: int) -> list[bytes]:
    """For each level the bits of the tokens that so many texts may share, by a token's first bits."""
    import zlib

    levels = levels_of(frequent)
    wide = [map_bits(bits, bucket_bits, k) for k in range(len(levels))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blobs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tails = np.sort(np.concatenate([np.cumsum(np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint64).astype(np.uint32) for b in blobs]))
                out = []
                for least, w in zip(levels, wide, strict=True):
                    hit = tails[least - 1 :][tails[least - 1 :] == tails[: len(tails) - least + 1]] if len(tails) >= least else tails[:0]
                    cells = np.zeros(1 << (w - bucket_bits), dtype=np.uint8)
                    cells[(hit.astype(np.uint64) >> np.uint64(32 - w + bucket_bits)).astype(np.int64)] = 1
                    out.append(zlib.compress(np.packbits(cells).tobytes(), 1) if len(hit) else b"")
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([out], pa.list_(pa.binary()))], names=["bucket", "maps"])

    maps = [bytearray((1 << w) // 8) for w in wide]
    grouped = counted.groupBy("bucket").agg(F.collect_list("blob").alias("blobs"))
    for row in grouped.mapInArrow(at_end(run), "bucket int, maps array<binary>").collect():
        for to, packed in zip(maps, row[1], strict=True):
            if packed:
                raw = zlib.decompress(packed)
                to[row[0] * len(raw) : (row[0] + 1) * len(raw)] = raw
    return [bytes(m) for m in maps]


def marked(tokens: np.ndarray, bit_map: np.ndarray) -> np.ndarray:
    """Whether each token's bit is set in a map of a power of two of bits."""
    bits = (8 * len(bit_map)).bit_length() - 1
    cell = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    return (bit_map[cell >> 3] & (np.uint8(128) >> (cell & 7).astype(np.uint8))) != 0


def keys_of(tokens: np.ndarray, maps: list[np.ndarray], k: int, percent: int, long: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray] | None:
    """A set's index keys, the most tokens it can share with a set that it shares no smaller key with, its number of tokens that no or few other texts share, and its shared tokens; None if it can have no partner."""
    n = len(tokens)
    need = -(-percent * n // 100)
    reach = n - need + 1
    shared = tokens[marked(tokens, maps[0])]
    dead = n - len(shared)
    if dead >= reach or n < 2:
        return None
    level = np.zeros(len(shared), dtype=np.int8)
    for i, m in enumerate(maps[1:], 1):
        level[marked(shared, m)] = i
    own = dead + int((level == 0).sum())
    order = np.lexsort((shared, level))
    rare = shared[order[level[order] < len(maps) - 1]]
    if dead + len(rare) >= reach:
        return rare[: reach - dead], n - dead - np.arange(reach - dead), own, shared
    common = shared[order[level[order] == len(maps) - 1]]
    before = dead + len(rare)
    keys, most = [rare], [n - dead - np.arange(len(rare))]
    if n < long:
        some = common[: reach - 1 + k - dead - len(rare)]
        left, right = np.triu_indices(len(some), 1)
        combined = mixed(some[left] * np.uint64(SEEDS[0]) + some[right])
        if k != 2:
            raise ValueError("combinations of two are indexed")
        keys.append(combined)
        most.append(n - before - right + 1)
    if 100 * n >= percent * long:
        keys.append(common[: reach - before])
        most.append(n - before - np.arange(len(keys[-1])))
    return np.concatenate(keys), np.concatenate(most), own, shared


def indexed(docs: DataFrame, maps, width: int, k: int, percent: int, long: int) -> DataFrame:
    """(doc_id, sid, n, keys, most, tokens, own) per row; what follows n once a task for each set that may have partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("jaccard", lambda: None)
        bit_maps_ = [np.frombuffer(x, np.uint8) for x in maps.value]
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, 1):
                sids, ns, keys, most, toks, owns = [], [], [], [], [], []
                for tokens in sets(part.column(1), width):
                    sid = identity(tokens) if len(tokens) else None
                    sids.append(sid)
                    ns.append(len(tokens))
                    got = None
                    if sid is not None and sid not in seen:
                        seen.add(sid)
                        got = keys_of(tokens, bit_maps_, k, percent, long)
                    if got is not None and len(got[0]):
                        keys.append(got[0].view(np.int64))
                        toks.append(got[3].view(np.int64))
                        most.append(got[1])
                        owns.append(got[2])
                    else:
                        keys.append(None)
                        most.append(None)
                        toks.append(None)
                        owns.append(None)
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sids, pa.binary()), pa.array(ns, pa.int64()), pa.array(keys, lists), pa.array(most, lists), pa.array(toks, lists), pa.array(owns, pa.int64())], names=["doc_id", "sid", "n", "keys", "most", "tokens", "own"])
        bit_maps_.clear()
        del maps._value  # a worker keeps what it has read of a broadcast; the next task reads it again

    return docs.select("doc_id", "text").mapInArrow(at_end(run), "doc_id long, sid binary, n long, keys array<long>, most array<long>, tokens array<long>, own long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each edge's component, by alternating large and small stars until all edges form stars.

    Edges are stars when every node but the centres leads to one other node, and that one leads nowhere.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "stars-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, now = now, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars-small")
        discard(large, before)
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("leads"), F.lit(0).alias("led")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("leads"), F.lit(1).alias("led")))
        if not ends.groupBy("x").agg(F.sum("leads").alias("leads"), F.max("led").alias("led")).where("leads > 1 OR leads + led > 1").head(1):
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._stored_at = now._stored_at
            return out


def possible(n: Column, most: Column, n2: Column, most2: Column, percent: int) -> Column:
    """Whether two sets can reach the threshold if the key at hand is their smallest common one; those that do meet at that key too."""
    both = F.least(most, most2)
    return 100 * both >= percent * (n + n2 - both)


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those at or above the threshold; only nodes of a pair bring their tokens."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets_ = nodes.select("id", "tokens", "n").join(used, "id", "left_semi")
    left = sets_.select(F.col("id").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    right = sets_.select(F.col("id").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def clusters(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    frequent: int = 1000,
    k: int = 2,
    long: int = 2000,
    most_bits: int = 28,
    rounds: int = 3,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row.

    percent: least Jaccard similarity in hundredths. frequent: texts that share a token which is not rare. long: see
    the module. most_bits: the first bit map has 2**most_bits bits at most, the others a sixteenth (a broadcast of 42 MB by default).
    rounds: of pivots, before all that is left is verified.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bucket_bits = min(16, max(6, math.ceil(math.log2(max(1, size) / 6 / 500_000 + 1))))
    bits = min(most_bits, max(bucket_bits + 3, 16, math.ceil(math.log2(8 * size / 6 + 1))))
    maps = spark.sparkContext.broadcast(bit_maps(counts(rows, width, bucket_bits, frequent), bits, bucket_bits, frequent))
    all_rows = stored(indexed(rows, maps, width, k, percent, long), "jaccard-rows")
    alive = all_rows.where(F.col("keys").isNotNull())
    merged_rows = alive.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "keys", "most", "tokens", "own")])
    nodes = stored(merged_rows.withColumn("id", F.monotonically_increasing_id()), "jaccard-nodes")
    slim = stored(all_rows.select("doc_id", "sid", "n"), "jaccard-texts")
    discard(all_rows)
    all_rows = slim
    each = F.explode(F.arrays_zip("keys", "most")).alias("e")
    entries = nodes.select("id", "n", "own", each).select("id", F.col("n").cast("int").alias("n"), F.col("own").cast("int").alias("own"), F.col("e.keys").alias("key"), F.col("e.most").cast("int").alias("most"))
    used, done, roots = [nodes], None, None
    for step in range(rounds + 1):
        at = entries.withColumn("root", F.col("id")) if roots is None else entries.join(roots, "id")
        orders = F.struct(*(["own"] if step == 0 else []), F.xxhash64("id", F.lit(step)).alias("h"), "id", "root", "n", "most")
        keys = at.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(orders).alias("p")).where("r0 <> r1")
        still = at.join(keys.select("key", F.col("p.id").alias("p_id"), F.col("p.root").alias("p_root"), F.col("p.n").alias("p_n"), F.col("p.most").alias("p_most")), "key")
        still = stored(still, f"jaccard-open-{step}")
        used.append(still)
        if not still.head(1):
            break
        entries = still.select("id", "n", "own", "key", "most")  # a key inside one component has nothing left to find
        if step < rounds:
            near = possible(F.col("n"), F.col("most"), F.col("p_n"), F.col("p_most"), percent)
            found = still.where((F.col("root") != F.col("p_root")) & near).select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b"))
        else:
            in_key = still.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
            every = still.select("id", "n", "key", "most", "root").join(in_key.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("top")), "key")
            few = every.where(F.col("root") != F.col("top")).select(F.col("key").alias("k"), F.col("id").alias("s"), F.col("root").alias("r"), F.col("n").alias("x"), F.col("most").alias("y"))
            near = possible(F.col("n"), F.col("most"), F.col("x"), F.col("y"), percent)
            met = every.join(few, (F.col("key") == F.col("k")) & (F.col("root") != F.col("r")) & ((F.col("root") == F.col("top")) | (F.col("id") < F.col("s"))) & near)
            found = met.select(F.least("id", "s").alias("a"), F.greatest("id", "s").alias("b"))
        pairs = found.distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = stored(pairs, f"jaccard-pairs-{step}")
        done = pairs if done is None else done.unionByName(pairs)
        links = stored(verified(pairs, nodes, percent), f"jaccard-links-{step}")
        used += [pairs, links]
        if links.head(1):
            ends = links
            if roots is not None:
                known = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
                ends = links.join(known, "a").join(known.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            merged = components(ends)
            before = nodes.select("id", F.col("id").alias("root")) if roots is None else roots
            roots = stored(before.join(merged.withColumnRenamed("root", "up"), F.col("root") == F.col("node"), "left").select("id", F.coalesce("up", "root").alias("root")), f"jaccard-roots-{step}")
            discard(merged, before)
    roots = nodes.select("id", F.col("id").alias("root")) if roots is None else roots
    of_root = nodes.select("sid", "id").join(roots, "id").join(nodes.select(F.col("id").alias("root"), F.col("sid").alias("root_sid")), "root").select("sid", F.col("root_sid").alias("root"))
    of_root = stored(of_root, "jaccard-roots")
    discard(*used, roots)
    own = all_rows.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("least"))
    linked = own.join(of_root, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = linked.join(least, "root").select("sid", "component_id")
    full = all_rows.where(F.col("sid").isNotNull()).join(labels, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    bare = all_rows.where(F.col("sid").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(bare)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return clusters(table(spark, sf_dir, "documents"))
