"""Parquet sources and mini-batches of them, and saved models.

A batch is a group of rows with one number. Without shuffling, a table's partitions pass as they are; with it, rows
are dealt to batches by the order of a hash of a row's place and the epoch, within buckets, so no step sorts the whole table.
"""

from __future__ import annotations

import json
import math
import tempfile
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType)


def parquet_source(spark: SparkSession, directory: str, *, columns: list[str] | None = None, pattern: str = "*.parquet") -> DataFrame:
    """Numeric columns of a directory's Parquet files; only they are read."""
    path = directory if directory.endswith(".parquet") else f"{directory}/{pattern}"
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise ValueError(f"no file matches {path}") from e
        raise
    columns = columns or df.columns
    check_columns(df.schema, columns)
    return df.select(*columns)


def check_columns(schema: T.StructType, columns: list[str]) -> None:
    there = {f.name: f.dataType for f in schema.fields}
    missing = [c for c in columns if c not in there]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {sorted(there)}")
    wrong = [c for c in columns if not isinstance(there[c], NUMERIC)]
    if wrong:
        raise ValueError(f"columns {wrong} are neither numbers nor booleans")


def placed(df: DataFrame) -> DataFrame:
    """``df`` with ``_id``, a row's partition and place; written once, as rows and their totals must be read from the same places."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="sparkbayes-"))
    return df.withColumn("_id", F.monotonically_increasing_id()).checkpoint()


def dealt(rows: DataFrame, batch_size: int, *, seed: int = 0, epoch: int = 0, buckets: int | None = None) -> DataFrame:
    """``placed`` rows with ``batch`` instead of ``_id``."""
    n = rows.count()
    buckets = buckets or min(10_000, max(1, n // (100 * batch_size)))
    hashed = rows.withColumn("_h", F.xxhash64("_id", F.lit(seed), F.lit(epoch))).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    totals = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    before = totals.select("_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", "_id")) - 1)
    numbered = inside.join(before, "_b").withColumn("_r", F.col("_r") + F.col("_before")).where(F.col("_r") < n - n % batch_size)
    return numbered.withColumn("batch", F.expr(f"_r div {batch_size}")).select(*[c for c in rows.columns if c != "_id"], "batch")


def batches(df: DataFrame, batch_size: int, *, seed: int = 0, epoch: int = 0, buckets: int | None = None) -> DataFrame:
    """``df`` with ``batch``, in an order that seed and epoch set; only the rows beyond the last full batch of all are left out.

    Rows are dealt to buckets by a hash of their places, not their values, and numbered inside them from the total of
    the buckets before, so each window is over one bucket and a batch may span two. The order is the same again where
    ``df`` gives its rows in the same partitions and order. buckets: about one for every hundred batches, and 10,000
    at most, if not given.
    """
    return dealt(placed(df), batch_size, seed=seed, epoch=epoch, buckets=buckets)


def source_blocks(df: DataFrame) -> Iterator[np.ndarray]:
    """A source's rows as arrays (rows x columns, null as NaN), block after block as its tasks read them: a Parquet file's row groups, or parts of them.

    Blocks come to the driver as whole Arrow messages, a partition at a time, the next one fetched ahead.
    """
    check_columns(df.schema, df.columns)

    def packed(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            if block.num_rows:
                to = pa.BufferOutputStream()
                with pa.ipc.new_stream(to, block.schema) as out:
                    out.write_batch(block)
                yield pa.RecordBatch.from_arrays([pa.array([to.getvalue().to_pybytes()], pa.binary())], names=["block"])

    plain = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
    for row in plain.mapInArrow(packed, "block binary").toLocalIterator(prefetchPartitions=True):
        table = pa.ipc.open_stream(bytes(row[0])).read_all()
        yield np.column_stack([column.to_numpy() for column in table.columns])


def memory_source(spark: SparkSession, data, columns: list[str] | None = None) -> DataFrame:
    """A table of what the driver holds: an array (rows x columns), a list of arrays, a function that gives an iterator of arrays, or such an iterator.

    An iterator can be read once: handing it over a second time is an error. Rows of no column names are x0, x1 ...
    """
    if callable(data):
        data = data()
    if isinstance(data, Iterator):
        blocks = [*data]
        if not blocks:
            raise RuntimeError("the iterator gives no block; one that has been read before can't be read again")
    else:
        blocks = [data] if isinstance(data, np.ndarray) else [*data]
    blocks = [np.asarray(b, dtype=float) for b in blocks]
    blocks = [b[:, None] if b.ndim == 1 else b for b in blocks]
    widths = {b.shape[1] for b in blocks}
    if len(widths) != 1 or any(b.ndim != 2 for b in blocks):
        raise ValueError("blocks are rows of the same columns")
    columns = columns or [f"x{i}" for i in range(widths.pop())]
    return spark.createDataFrame(pa.concat_tables([pa.table([pa.array(b[:, i]) for i in range(len(columns))], names=columns) for b in blocks]))


@dataclass
class DataLoader:
    """Batches as arrays (rows x columns), epoch after epoch; re-iterable.

    Without shuffling, the source's blocks pass in their order, cut to batch_size at most; no row is left out.
    total_size: "auto" counts the rows; a number is taken as given; None warns, as a likelihood scaled by it is biased.
    """

    df: DataFrame
    batch_size: int
    shuffle: bool = False
    seed: int = 0
    total_size: int | str | None = "auto"
    epoch: int = 0
    _rows: DataFrame | None = field(default=None, init=False, repr=False)

    def __post_init__(self):
        check_columns(self.df.schema, self.df.columns)
        if self.batch_size < 1:
            raise ValueError("batch_size is at least 1")
        if self.total_size == "auto":
            self.total_size = self.df.count()
            if self.total_size == 0:
                raise ValueError("the source has no rows")
        elif self.total_size is None:
            warnings.warn("without total_size a mini-batch likelihood can't be scaled and is biased", stacklevel=2)

    def __len__(self) -> int:
        if self.total_size is None:
            raise TypeError("the number of rows isn't known")
        return int(self.total_size) // self.batch_size

    def __iter__(self) -> Iterator[np.ndarray]:
        self.epoch += 1
        if not self.shuffle:
            for block in source_blocks(self.df):
                for lo in range(0, len(block), self.batch_size):
                    yield block[lo : lo + self.batch_size]
            return
        self._rows = self._rows or placed(self.df)
        shuffled = dealt(self._rows, self.batch_size, seed=self.seed, epoch=self.epoch)
        values = F.collect_list(F.array(*[F.col(c).cast("double") for c in self.df.columns]))
        for row in shuffled.groupBy("batch").agg(values.alias("rows")).toLocalIterator(prefetchPartitions=True):
            yield np.array(row["rows"], dtype=float)


def save_tables(tables: dict[str, DataFrame], at: str, attributes: dict) -> None:
    """One Parquet folder per table, and their attributes."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}")
    spark.createDataFrame([(json.dumps(attributes | {"tables": sorted(tables)}, sort_keys=True),)], "attributes string").coalesce(1).write.mode("overwrite").parquet(f"{at}/_attributes")


def load_tables(spark: SparkSession, at: str, *, expect_id: str | None = None) -> tuple[dict[str, DataFrame], dict]:
    attributes = json.loads(spark.read.parquet(f"{at}/_attributes").head()[0])
    if expect_id is not None and attributes.get("id") != expect_id:
        raise ValueError(f"the saved model has the id {attributes.get('id')}, not {expect_id}: its configuration differs")
    return {name: spark.read.parquet(f"{at}/{name}") for name in attributes["tables"]}, attributes


def mask_missing(df: DataFrame, columns: list[str], sentinel: float | None = None) -> DataFrame:
    """Null, NaN and infinite values (and a sentinel, if given) become null."""
    out = df
    for c in columns:
        x = F.col(c).cast("double")
        bad = F.isnan(x) | (F.abs(x) == float("inf"))
        bad = bad | (x == sentinel) if sentinel is not None else bad
        out = out.withColumn(c, F.when(~bad, x))
    return out
