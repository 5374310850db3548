"""Helpers that the corpus operators share: table reads, scratch tables, text patterns."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

#: Fixed value: the characters that separate words.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset a temporary one, which only a
    session whose executors run in the driver's process may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="tempora-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tempora/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partitions_by: list[str] | None = None) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back. The path is in the attribute scratch."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitions_by) if partitions_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_scratch(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable) -> Callable:
    """A task's function over batches that hands unused memory back when it ends: workers live on, and what they hold while idle
    counts against the tasks that follow."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim is not None:
                trim(0)

    return whole


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs outside WORD_GAP; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: lambdas otherwise evaluate it for each element."""
    return F.transform(F.array(value), body)[0]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Stored bytes of input that one task of a shuffle may hold in memory, a few times that as arrays.
TASK_BYTES = 32 << 20


def width_for(df: DataFrame) -> int:
    """Partitions for a shuffle whose tasks hold their share in memory: the session's, or more where the bytes that df reads
    ask for it. Inputs that are not stored tables have no known size and count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(shuffle_width(df.sparkSession), -(-sum(s for s in sizes if s < 1 << 60) // TASK_BYTES))


def running(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """Adds <value>_upto for each of values (longs, not negative): its sum over the rows up to this one, in order of columns
    that tell rows apart. A range sort, whose partitions add up on their own; one row of sums for each goes to the driver.
    The result reads the table in its attribute scratch."""
    spark, names = df.sparkSession, df.columns
    schema = StructType(list(df.schema.fields)).add("__part", IntegerType())
    for v in values:
        schema = schema.add(f"{v}_upto", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        before, part = dict.fromkeys(values, 0), TaskContext.get().partitionId()
        for batch in batches:
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, dtype=np.int32))]
            for v in values:
                sums = before[v] + np.cumsum(batch.column(v).to_numpy(zero_copy_only=False).astype(np.int64))
                before[v] = int(sums[-1]) if len(sums) else before[v]
                columns.append(pa.array(sums))
            yield pa.RecordBatch.from_arrays(columns, [*names, "__part", *(f"{v}_upto" for v in values)])

    ordered = df.repartitionByRange(width_for(df), *order).sortWithinPartitions(*order)
    parts = written(ordered.mapInArrow(lean(run), schema), "running")
    ends = parts.groupBy("__part").agg(*[F.max(f"{v}_upto").alias(v) for v in values]).collect()
    total, starts = [0] * len(values), []
    for part, *sums in sorted(map(tuple, ends)):
        starts.append((part, *total))
        total = [a + b for a, b in zip(total, sums, strict=True)]
    told = spark.createDataFrame(starts, ", ".join(["__part int", *(f"__{v}_before long" for v in values)]))
    whole = parts.join(F.broadcast(told), "__part")
    out = whole.select(*names, *[(F.col(f"{v}_upto") + F.col(f"__{v}_before")).alias(f"{v}_upto") for v in values])
    out.scratch = parts.scratch
    return out
