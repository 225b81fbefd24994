"""Exact top-k inner products by norm-sorted search (operator 10).

Vectors become integers, floor(scale * x), and are rotated by the eigenvectors of their Gram matrix (the right
singular vectors of the whole table), largest first, so that leading coordinates hold most of every length. Rows
are ordered by descending length and cut into numbered blocks, which the queries meet in rounds, each of some times as
many blocks as the one before. A query's floor is its k-th best score so far. Before anything but block numbers moves,
a pair of blocks whose greatest lengths' product is below all the queries' floors is passed over; in what meets, so
is, row by row, a candidate whose partial sum over the leading coordinates plus the Cauchy-Schwarz bound on the rest,
product of the residual lengths, is below the floor. What is left is scored exactly in integers. Bounds carry a margin
above the rounding error of the rotation. The search ends with the round that no pair of blocks is left for.

No task holds more than one block of queries and one of candidates, and the best k of a pair of blocks go on to one
top-k per query and round.

Defined cases: a null vector, or one with a null or non-finite component, takes no part; a vector shorter than the
longest one counts as if zeros followed; components of any size are scored exactly, and a score beyond the range of a
long counts as the nearest long; a query's own row, by its id, is no candidate; ties in score go to the smaller id;
equal vectors are kept apart by their ids; a row without an id takes no part; an empty table gives no rows; with
fewer than k candidates all are returned; other columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, ready, stored

MOST, LEAST = (1 << 63) - 1, -(1 << 63)
ROTATED = 2048  # components up to which the Gram matrix is formed


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(vec_id, v): usable vectors as arrays of whole doubles, which hold the integers exactly."""
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(fine, F.lit(False)))
    # Beyond 2**53 every double is whole, and floor to a long would end at a long's range.
    return rows.select("vec_id", F.transform("x", lambda e: F.when(F.abs(e * scale) < float(1 << 53), F.floor(e * scale).cast("double")).otherwise(e * scale)).alias("v"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column as rows of ``d`` doubles, zeros behind shorter ones."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def gram(rows: DataFrame, d: int) -> np.ndarray:
    """Sum of outer products: d x d numbers a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0), d)
                v = v / np.maximum(1.0, np.abs(v).max(axis=1, keepdims=True) / (1 << 40))  # any rotation gives right bounds
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([*total], pa.list_(pa.float64()))], names=["i", "row"])

    summed = rows.select("v").mapInArrow(run, "i int, row array<double>").groupBy("i").agg(*[F.sum(F.get("row", F.lit(j))).alias(f"g{j}") for j in range(d)])
    out = np.zeros((d, d))
    for r in summed.collect():
        out[r[0]] = r[1:]
    return out


def lengths(v: np.ndarray) -> np.ndarray:
    """Rows' lengths; those of rows whose squares leave the range are infinite."""
    with np.errstate(over="ignore"):
        return np.sqrt((v * v).sum(axis=1))


BLOCK = "block long, ids binary, v binary, r binary, rest binary, longest double, n int"


def blocks(rows: DataFrame, rotation: np.ndarray | None, d: int, lead: int, size: int) -> DataFrame:
    """Rows already cut by ``block`` and sorted inside partitions, as one row of matrices for each ``size`` of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            which = batch.column(0).to_numpy()
            cuts = np.flatnonzero(which[1:] != which[:-1]) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(which)), strict=True):
                for a in range(lo, hi, size):
                    part = batch.slice(a, min(size, hi - a))
                    v = matrix(part.column(2), d)
                    with np.errstate(over="ignore", invalid="ignore"):
                        turned = v @ rotation if rotation is not None else v
                        rest = np.sqrt((turned[:, lead:] ** 2).sum(axis=1))
                    kind = "<i4" if np.abs(v).max(initial=0.0) < 1 << 31 else "<f8"
                    out = [[int(which[a])], [part.column(1).to_numpy().astype("<i8").tobytes()], [v.astype(kind).tobytes()], [turned[:, :lead].astype("<f8").tobytes()], [rest.astype("<f8").tobytes()], [float(lengths(v).max())], [part.num_rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int32()), strict=True)], names=["block", "ids", "v", "r", "rest", "longest", "n"])

    return rows.select("block", "vec_id", "v").mapInArrow(run, BLOCK)


def dots(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole doubles as longs."""
    if np.abs(c).max(initial=0.0) * np.abs(q).max(initial=0.0) * max(1, len(q)) < 1 << 62:
        return c.astype(np.int64) @ q.astype(np.int64)
    own = [int(x) for x in q.tolist()]
    return np.array([max(LEAST, min(MOST, sum(int(x) * y for x, y in zip(row, own, strict=True)))) for row in c.tolist()], dtype=np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one query: highest score, then smallest id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def meet(pairs: DataFrame, d: int, lead: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each pair of blocks, at or above the query's floor."""

    def vectors(raw: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw, "<i4" if len(raw) == 4 * n * d else "<f8").reshape(n, d).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                qid, cid = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q, c = vectors(row["q_v"], len(qid)), vectors(row["v"], len(cid))
                qr, cr = (np.frombuffer(row[x], "<f8").reshape(-1, lead) for x in ("q_r", "r"))
                q_rest, c_rest = np.frombuffer(row["q_rest"], "<f8"), np.frombuffer(row["rest"], "<f8")
                floors = np.frombuffer(row["q_floor"], "<i8")
                q_length = lengths(q)
                out_q, out_c, out_s = [], [], []
                with np.errstate(over="ignore", invalid="ignore"):
                    # What has left the range is no number, and no bound.
                    alive = np.flatnonzero(~(q_length * row["longest"] * (1 + 1e-9) + 1e-3 < floors))
                for lo in range(0, len(alive), 256):
                    some_q = alive[lo : lo + 256]
                    with np.errstate(over="ignore", invalid="ignore"):
                        bound = qr[some_q] @ cr.T + q_rest[some_q, None] * c_rest[None, :]
                        margin = 1e-9 * q_length[some_q] * row["longest"] + 1e-3
                        open_ = ~(bound + margin[:, None] < floors[some_q, None])
                    open_ &= qid[some_q, None] != cid[None, :]
                    for i, j in enumerate(some_q):
                        some = np.flatnonzero(open_[i])
                        if not len(some):
                            continue
                        scores = dots(c[some], q[j])
                        top = best(scores, cid[some], k)
                        out_q += [int(qid[j])] * len(top)
                        out_c += cid[some[top]].tolist()
                        out_s += scores[top].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_q, out_c, out_s)], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    vectors: DataFrame,
    queries: Column,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: float = 256.0,
    k: int = 5,
    size: int = 2048,
    lead_share: float = 0.5,
    growth: int = 4,
) -> DataFrame:
    """The k best candidates of each row for which ``queries`` (of the id) holds: query_id, rank, vec_id, score.

    size: most rows of a block. lead_share: share of the rotated coordinates in the partial sums. growth: how many
    times as many blocks a round has as the one before.
    """
    spark = ready(vectors.sparkSession)
    rows = integers(vectors, vec_id, embedding, scale)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d, n = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).head()
    if not n:
        return empty
    d = max(1, d)
    lead = max(1, math.ceil(d * lead_share))
    rotation = np.ascontiguousarray(np.linalg.eigh(gram(rows, d))[1][:, ::-1]) if d <= ROTATED else None
    rows = rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    # Descending length: range partitions are cut into blocks, which are numbered in their order.
    placed = rows.repartitionByRange(max(1, math.ceil(n / size)), F.desc("norm"), F.col("vec_id")).withColumn("block", F.spark_partition_id().cast("long"))
    cut = stored(blocks(placed, rotation, d, lead, size).withColumn("part", F.monotonically_increasing_id()), "topk-cut")
    slim = stored(numbered(cut.select("block", "part", "longest")), "topk-blocks")
    candidates = stored(cut.drop("block", "longest").join(slim, "part").drop("part"), "topk-candidates")
    discard(cut)
    asked = rows.where(queries)
    spread = asked.repartitionByRange(max(1, math.ceil(n / size / 16)), "vec_id").withColumn("block", F.spark_partition_id().cast("long"))
    q = blocks(spread, rotation, d, lead, size).withColumn("q_block", F.monotonically_increasing_id()).withColumnsRenamed({c: f"q_{c}" for c in ("ids", "v", "r", "rest", "n", "longest")}).drop("block")
    q = stored(q, "topk-queries")
    total = slim.count()
    found, lo, hi = None, 0, 1
    tasks = spark.sparkContext.defaultParallelism * 4
    while lo < total:
        floors = stored(with_floors(q, found, k), "topk-floors")
        numbers = floors.select("q_block", "q_longest", "least", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(min(hi, total) - 1).cast("long"))).alias("block"))
        cells = numbers.join(slim.select("block", "longest"), "block").where(~(F.col("longest") * F.col("q_longest") * (1 + 1e-9) + 1e-3 < F.col("least"))).select("q_block", "block")
        cells = stored(cells, "topk-cells")
        if cells.isEmpty():
            discard(floors, cells)
            break  # lengths only fall from here on, and floors stay
        whole = q.drop("q_longest").join(floors.select("q_block", "q_floor"), "q_block")
        pairs = cells.repartition(tasks).join(candidates, "block").join(whole, "q_block")
        met = ranked(meet(pairs, d, lead, k), k).select("query_id", "vec_id", "score")
        before, found = found, stored(ranked(met if found is None else met.unionByName(found), k).select("query_id", "vec_id", "score"), "topk-found")
        discard(floors, cells, *([before] if before is not None else []))
        lo, hi = min(hi, total), hi + growth * (hi - lo)
    discard(q, slim, candidates)
    return ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def numbered(cut: DataFrame) -> DataFrame:
    """Blocks by (range partition, part) with a number without gaps, from 0: their place inside the partition plus the partitions' sizes before."""
    inside = cut.withColumn("_i", F.row_number().over(Window.partitionBy("block").orderBy("part")) - 1)  # a partition has few blocks
    sizes = cut.groupBy("block").count()
    # One row a partition: a prefix sum over groups of partitions, then inside them.
    group = F.floor(F.col("block") / 1024)
    sizes = sizes.withColumn("_g", group)
    ahead = sizes.groupBy("_g").agg(F.sum("count").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("count").over(Window.partitionBy("_g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_in", within).join(ahead.select("_g", "_before"), "_g").select("block", (F.col("_in") + F.col("_before")).alias("_start"))
    return inside.join(starts, "block").select("part", "longest", (F.col("_start") + F.col("_i")).cast("long").alias("block"))


def with_floors(q: DataFrame, found: DataFrame | None, k: int) -> DataFrame:
    """(q_block, q_longest, q_floor, least): each query's floor in the block's order, the least long where it has none yet, and the least of them."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(got), pa.int64()), pa.array(np.arange(len(got)), pa.int64()), pa.array(got, pa.int64())], names=["q_block", "at", "query_id"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(x, dtype="<i8").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["q_block", "q_floor"])

    listed = q.select("q_block", "q_ids").mapInArrow(ids, "q_block long, at long, query_id long")
    if found is None:
        listed = listed.withColumn("floor", F.lit(LEAST).cast("long"))
    else:
        floor = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("floor")).where(F.col("c") >= k).select("query_id", "floor")
        listed = listed.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST).cast("long")))
    # A block has at most ``size`` queries.
    sets = listed.groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("at", "floor"))).alias("s"))
    floors = sets.select("q_block", F.col("s.floor").alias("f")).mapInArrow(pack, "q_block long, q_floor binary")
    return q.select("q_block", "q_longest").join(floors, "q_block").join(sets.select("q_block", F.array_min("s.floor").alias("least")), "q_block")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
    SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]), 0)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""
