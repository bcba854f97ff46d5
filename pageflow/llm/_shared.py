"""Helpers shared by the training-data operators: scratch folders in the shared
store, word splitting, and Arrow batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one output batch; bounds a Python worker's memory.
OUT_ROWS = 2048
#: Rows of one input batch.
IN_ROWS = 512
#: Numbers of a block of summed(), and tasks that add blocks up.
BLOCK, SUM_TASKS = 1 << 16, 16


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset (local tests) a folder of this machine is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        root = getattr(context, "_pageflow_root", None)
        if root is None:
            if context.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = context._pageflow_root = "file://" + tempfile.mkdtemp(prefix="pageflow-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def unswept(spark: SparkSession, name: str) -> str:
    """A new folder of the shared store."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """The same for one run of one operator, which sweep() removes; its result may be read from there."""
    path = unswept(spark, name)
    made = getattr(spark.sparkContext, "_pageflow_scratch", None)
    if made is None:
        made = spark.sparkContext._pageflow_scratch = {}
    made.setdefault(_OWNER[-1], []).append(path)
    return path


_OWNER: list[str | None] = [None]


@contextmanager
def owned(spark: SparkSession, owner: str) -> Iterator[None]:
    """Removes the owner's earlier scratch folders, whose results must be written by now,
    and makes it the owner of those made inside.  Others' are left alone."""
    sweep(spark, owner)
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def sweep(spark: SparkSession, owner: str | None = None) -> None:
    """Removes the scratch folders made by an owner so far (None: by queries run alone)."""
    for path in getattr(spark.sparkContext, "_pageflow_scratch", {}).pop(owner, []):
        drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back: lineage ends at the files."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI: local, HDFS, S3 and GCS alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else "file://" + uri)


def put_file(uri: str, blocks: Iterable[bytes]) -> int:
    """Writes ``blocks`` to ``uri`` through a temporary name and a rename, so a
    retried or speculative task leaves one whole file.  Returns its bytes."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    size = 0
    with store.open_output_stream(part, compression=None) as out:
        for block in blocks:
            size += out.write(block)
    store.move(part, path)
    return size


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Just the named columns, cast; the rest may clash with what is added."""
    small_batches(df.sparkSession)
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches to Python of ``IN_ROWS`` rows at most: long texts stay few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > IN_ROWS:
        spark.conf.set(name, str(IN_ROWS))


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = OUT_ROWS, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows and about ``most`` bytes of binary."""
    held: list[tuple] = []
    n_bytes = 0
    for row in rows:
        held.append(row)
        n_bytes += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= size or n_bytes >= most:
            yield _batch(held, schema)
            held, n_bytes = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def summed(df: DataFrame, counted: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int) -> np.ndarray:
    """Sum of the int64 vectors that ``counted`` makes of each task's batches: exact, so the same in any order.

    Blocks are added up by tasks; the driver gets ``length`` numbers, however many tasks there are."""
    schema, spec = pa.schema([("block", pa.int32()), ("width", pa.int32()), ("part", pa.binary())]), "block int, width int, part binary"

    def packed(block: int, x: np.ndarray) -> Iterator[tuple]:
        if x.any():
            width = 4 if -(1 << 31) < x.min() and x.max() < 1 << 31 else 8
            yield block, width, pa.compress(x.astype(f"<i{width}").tobytes(), codec="zstd", asbytes=True)

    def numbers(block: int, width: int, part: bytes) -> np.ndarray:
        size = min(BLOCK, length - block * BLOCK)
        return np.frombuffer(pa.decompress(part, size * width, codec="zstd", asbytes=True), f"<i{width}")

    def made(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = counted(found)
        yield from batches((r for b in range(-(-length // BLOCK)) for r in packed(b, x[b * BLOCK : (b + 1) * BLOCK])), schema)

    def added(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for row in rows_of(found):
            x = numbers(*row)
            sums[row[0]] = sums[row[0]] + x if row[0] in sums else x.astype(np.int64)
        yield from batches((r for b, x in sums.items() for r in packed(b, x)), schema)

    out = np.zeros(length, np.int64)
    for row in df.mapInArrow(made, spec).repartition(SUM_TASKS, "block").mapInArrow(added, spec).collect():
        x = numbers(*row)
        out[row.block * BLOCK : row.block * BLOCK + len(x)] = x
    return out


def rows_of(found: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, in order, converted a slice at a time."""
    for batch in found:
        for at in range(0, batch.num_rows, 512):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 512).columns))


def words(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8: just what bytes.split() parts at."""
    return (text or "").encode("utf-8", "replace").split()


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased and no other letter changed."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
