"""Helpers the text operators share: shared-folder checkpoints, Arrow batches as byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that one numpy pass works on.
SLICE_BYTES = 1 << 20
#: Rows and bytes of one Arrow batch between Spark and a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir or the context's checkpoint folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found


def bounded(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, from now on: rows of these operators may hold whole texts or sets of hashes.
    Lazy results need the bounds when they are read, so they aren't taken back; batches that are smaller stay so."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key))
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


#: With this on, the shuffle files of a query go when it has ended, not when the driver's objects are collected.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spill(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here, and losing an
    executor costs nothing that was written. The folder's owner clears it. tidy: see TIDY."""
    return _spill(df, f"{shared_dir(df.sparkSession).rstrip('/')}/t-{uuid.uuid4().hex}", tidy)


def _spill(df: DataFrame, path: str, tidy: bool) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(TIDY, "false")
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables between the jobs of one operator: spill() as above, and all of them are deleted at the end of the block,
    when nothing reads them any more."""

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.tidy, self.path = spark, tidy, f"{shared_dir(spark).rstrip('/')}/s-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def spill(self, df: DataFrame) -> DataFrame:
        return _spill(df, f"{self.path}/t-{uuid.uuid4().hex}", self.tidy)

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def skewed_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join, both of whose sides adaptive execution reads straight from a shuffle, so that it can split
    the rows of a hot key; right must be no aggregate by the same key in the same job (spill it), or it would share
    its shuffle."""
    return left.join(right.hint("merge"), on, how)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no cut holds more than limit bytes of the column, except single longer values."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> list[bytes]:
    """The values as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def joined(texts: list[bytes], mark: bytes = b"\x01") -> tuple[np.ndarray, np.ndarray]:
    """The texts as one byte array with a mark before, between and after them; the places of the marks."""
    buf = np.frombuffer(bytearray(mark + mark.join(texts) + mark), np.uint8)
    marks = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)))
    return buf, marks


def spaced(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one byte array with spaces between; start and end of every run of bytes that are no ASCII white
    space; and how many of these come before each text, and in all."""
    a, marks = joined(texts, b" ")
    on = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.diff(on.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return a, start, end, np.searchsorted(start, marks)


def append_columns(df: DataFrame, fields: T.StructType, column: str, make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """One narrow pass that adds the columns of make(batch) to every row, in slices bounded by the bytes of
    column. An input column with the name of a result column is replaced by it."""
    bounded(df.sparkSession)
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    if column in names:
        raise ValueError(f"{column!r} is a result column and can't be the text column")
    out = T.StructType(kept + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for whole in batches:
            for batch in slices(whole, column):
                made = make(batch)
                columns = [batch.column(f.name) for f in kept] + [
                    x if isinstance(x, pa.Array) else pa.array(x, schema.field(f.name).type) for x, f in zip(made, fields, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([c.cast(s.type) for c, s in zip(columns, schema, strict=True)], names=schema.names)

    return df.mapInArrow(run, out)


def word_table(letters_only: bool = False) -> np.ndarray:
    """Byte to byte: A-Z lower-cased, word bytes (0-9, a-z, 0x80 and above) kept, all else a space."""
    t = np.full(256, 32, np.uint8)
    keep = [*range(0x61, 0x7B), *range(0x80, 0x100)] + ([] if letters_only else [*range(0x30, 0x3A)])
    t[keep] = keep
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: a polynomial one, from one running sum, up to 512 bytes; longer spans,
    for which such hashes have known collisions, are hashed one by one."""
    step = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(step), -1, 1 << 64))
    n = len(data)
    up, down = np.full(n + 1, step, np.uint64), np.full(n + 1, back, np.uint64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(54)))
    long, view = np.flatnonzero(ends - starts > 512), memoryview(np.ascontiguousarray(data))
    if len(long):
        h[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
