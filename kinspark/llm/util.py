"""What several operators share: tables written between steps, size-checked broadcasts, text batches as bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  # largest table of narrow rows that is ever broadcast
HOT_KEYS = 20_000  # a key is hot if it has more than one in so many of all rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A local master, whose executors are in the driver's own process,
    may do without that setting; elsewhere its absence is an error, as results would be lost."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    at = at or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kinspark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (stored, so cheap to count) with a broadcast hint if it has at most limit rows; otherwise as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def by_key(rows: DataFrame, table: DataFrame, key: str, how: str = "left", n: str | None = None, limit: int = BROADCAST_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """rows joined with table (stored, one row for each key, its other columns not in rows), "left" or "inner"; no key's rows meet in one task.

    A table of at most limit rows is broadcast. Of a larger one, keys that hold more than one in hot_keys of all rows are: there can't be more
    than hot_keys of them. The other keys are shuffled, and rows that have their values by then go anywhere. n: the column of table with the
    number of the key's rows, counted here if it isn't named. Null keys find nothing."""
    if table.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(table), key, how)
    values = [c for c in table.columns if c != key]
    if n is None:
        n = "__n"
        table = stored(table.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias(n)), key), "counted")
    least = (table.agg(F.sum(n)).first()[0] or 0) / hot_keys
    packed = lambda t, name: t.select(F.col(key).alias(f"__{name}_key"), F.struct(*values).alias(f"__{name}"))
    out = rows.join(F.broadcast(packed(table.where(F.col(n) > least), "hot")), F.col(key) == F.col("__hot_key"), "left")
    out = out.withColumn("__salt", F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), F.xxhash64(*rows.columns).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    cold = packed(table.where(F.col(n) <= least), "cold").withColumn("__none", F.lit(0).cast("long"))
    out = out.join(cold, (F.col(key) == F.col("__cold_key")) & (F.col("__salt") == F.col("__none")), "left").withColumn("__got", F.coalesce("__hot", "__cold"))
    if how == "inner":
        out = out.where(F.col("__got").isNotNull())
    return out.select(key, *[c for c in rows.columns if c != key], *[F.col("__got")[c].alias(c) for c in values])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text or binary column as one byte array and n+1 offsets into it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes, one row at least: numpy's temporaries stay small however large a batch is."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def release() -> None:
    """Gives memory that Arrow and numpy have freed back to the system, so that a worker stays small between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def binary_rows(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: row i holds data[ends[i-1]:ends[i]] as bytes."""
    raw = np.ascontiguousarray(data).view(np.uint8) if data.size else np.zeros(0, np.uint8)
    offsets = np.concatenate([[0], np.asarray(ends, np.int64) * data.dtype.itemsize]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
