"""Helpers shared by the training-data operators: shared storage, Arrow batches, table access."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Text bytes an Arrow slice hands to numpy at once; a single longer document is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch, about; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a default of its own, since a
    machine-local folder isn't visible to the executors of a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(os.getcwd(), "spark-warehouse", "shared")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under :func:`shared_root`, removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a work folder that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read again: lineage ends here and no executor holds it."""
    spark = df.sparkSession
    path = work_dir(spark, name) + "/data"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and plain path of a shared path, for tasks that write files themselves."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def put(path: str, chunks: Iterable[bytes]) -> None:
    """Write a file whole or not at all: a retried or doubled task only ever renames equal content."""
    fs, plain = filesystem(path)
    fs.create_dir(plain.rpartition("/")[0], recursive=True)
    part = f"{plain}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(part, plain)


def open_file(path: str) -> pa.NativeFile:
    """Random access to a file of shared storage."""
    fs, plain = filesystem(path)
    return fs.open_input_file(plain)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` of each slice holds about ``most`` bytes."""
    for batch in batches:
        offsets = text_ends(batch.column(batch.schema.get_field_index(column)))
        start, n = 0, batch.num_rows
        while start < n:
            end = start + 1
            base = offsets[start]
            while end < n and offsets[end + 1] - base <= most:
                end += 1
            yield batch.slice(start, end - start)
            start = end


def text_ends(column: pa.Array) -> list[int]:
    """Running byte counts of a string or binary column: n + 1 numbers from 0."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = [0]
    total = 0
    for size in sizes:
        total += int(size)
        ends.append(total)
    return ends


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of bounded size: Spark's defaults of 10,000 rows and 64 MB a batch, which the
    JVM and the worker each hold more than once, are lowered unless the session has set them.
    """
    conf = df.sparkSession.conf
    for key, given, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(BATCH_BYTES))):
        if conf.get(key, given) == given:
            conf.set(key, most)
    return df.mapInArrow(run, schema)


def map_rows(
    df: DataFrame, columns: list[str], rows: Callable[[list[list]], list[list]], schema: pa.Schema, ddl: str, text: str = "text", raw: bool = False
) -> DataFrame:
    """``mapInArrow`` over bounded slices: ``rows`` gets the columns as lists and gives the output columns.

    raw: strings arrive as their UTF-8 bytes.
    """

    def values(column: pa.Array) -> list:
        return (column.cast(pa.binary()) if raw and pa.types.is_string(column.type) else column).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            got = rows([values(c) for c in part.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, schema.types)], schema=schema)

    return map_arrow(df.select(*columns), run, ddl)


def small(df: DataFrame, most: int) -> bool:
    """Whether a stored table has at most ``most`` rows, so that it may be broadcast."""
    return df.limit(most + 1).count() <= most
