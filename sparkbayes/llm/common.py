"""What the operators share: table access, the shared folder, worker imports and memos bounded by bytes."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of an Arrow batch that goes to a Python worker: ``ready`` lowers the session's setting to this, as texts may be long.
BATCH, MOST_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def tokenizer_path(name: str, path: str | None = None) -> str:
    """Where a public tokenizer's file is: ``path``, or the installed package's copy of ``name``."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package also when the driver found it through sys.path only, and bound what they get at a time."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    now = spark.conf.get(BATCH)
    if now.removesuffix("b").isdigit() and int(now.removesuffix("b")) > MOST_BATCH:
        spark.conf.set(BATCH, str(MOST_BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a local one, if all runs on one machine."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sparkbayes-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so lost executors cost no earlier stage."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing that is still to run reads it; other tables are left as they are."""
    for df in tables:
        if hasattr(df, "_stored_at"):
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(batch, column: str | int, most_bytes: int = 2 << 20, most_rows: int = 2000) -> Iterator:
    """An Arrow batch in slices of at most so many rows and bytes of text; a text longer than that is alone in its slice."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = min(lo + most_rows, max(lo + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def cut_blocks(texts) -> tuple:
    """An Arrow array's texts cut at ASCII white space: different blocks (list), numbers of all blocks in order and bounds of the texts (arrays)."""
    import pyarrow.compute as pc

    cut = pc.ascii_split_whitespace(texts.fill_null("") if texts.null_count else texts)
    coded = cut.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), cut.offsets.to_numpy()


_slot: dict = {}


def held(key, make: Callable):
    """What an operator keeps in a Python worker between batches and tasks.

    A worker outlives its stage, so it keeps one operator's state at a time and gives the memory of the last one back.
    """
    if key not in _slot:
        if _slot:
            _slot.clear()
            release()
        _slot[key] = make()
    return _slot[key]


def at_end(run: Callable) -> Callable:
    """A function on batches that gives freed memory back at the end of its task, as workers wait beside later stages."""

    def go(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return go


def release() -> None:
    """Give freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass


class Memo(dict):
    """A function's results by argument, kept in two generations of about ``most_bytes`` in all.

    ``trim`` between rows turns a young generation of half the bytes into the old one; an entry met again moves back.
    """

    ENTRY = 200  # bytes of an entry's place in the table and of its objects' heads

    def __init__(self, compute: Callable, most_bytes: int = 32 << 20):
        super().__init__()
        self.compute, self.most_bytes, self.old, self.size = compute, most_bytes, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        self[key] = value
        self.size += self.ENTRY + self.bytes_of(key) + self.bytes_of(value)

    def add(self, keys: list, values: list) -> None:
        """Many strings and their bytes at a time."""
        self.update(zip(keys, values, strict=True))
        self.size += self.ENTRY * len(keys) + sum(map(len, keys)) + sum(map(len, values))

    def moved(self, keys) -> dict:
        """What the old generation has of ``keys``, put into the young one."""
        old = self.old
        found = {k: old[k] for k in keys if k in old} if old else {}
        if found:
            self.add([*found], [*found.values()])
        return found

    @staticmethod
    def bytes_of(x) -> int:
        return len(x) if isinstance(x, (str, bytes)) else 40 * len(x) if isinstance(x, tuple) else 0

    def trim(self) -> None:
        if 2 * self.size > self.most_bytes:
            self.old = dict(self)
            self.clear()
            self.size = 0
