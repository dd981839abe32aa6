"""What the operators of this subpackage share: scratch tables, row numbers, running sums and a few expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Words are what lies between these six characters: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; only where that is unset (tests), one of our own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-factloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.
    compression: the session's, unless given."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/factloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for work columns: the ones given, each behind as many underscores as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def number_rows(df: DataFrame, order: list[str], label: str, to: str) -> tuple[DataFrame, int]:
    """Number all rows from 0 in the order given, in a new column `to`, and count them, without one task that sees them all.

    The rows are range-sorted, written, and given their place in their partition plus the rows of the partitions before.
    Rows that are equal in `order` may be split over partitions (a running number is the last sort key), so a key that
    holds a third of all rows does no harm; such rows get consecutive numbers in no particular order.
    """
    spark = df.sparkSession
    spread, at, part, start = unused(df, "spread", "at", "part", "start")
    placed = (
        df.withColumn(spread, F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), *order, spread)
        .sortWithinPartitions(*order, spread)
        .drop(spread)
        .withColumn(at, F.monotonically_increasing_id())
    )
    placed = materialise(placed, label)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition, so both the window and the broadcast are small whatever the input
    counts = placed.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count("*").alias("n"))
    starts = counts.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    numbered = (
        placed.withColumn(part, F.shiftright(at, 33))
        .join(F.broadcast(starts), part)
        .withColumn(to, F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(part, start, at)
    )
    return numbered, placed.count()


def running_sums(df: DataFrame, order: list[str], values: dict[str, str], label: str) -> DataFrame:
    """df with, for each column in `values`, the sum of it over all rows up to and with this one in the order given, under
    the name that `values` maps it to; without one task that sees all rows.

    The rows are range-sorted, summed as they pass (Arrow batches, nothing is held) and written; the sums of the partitions
    before are added. Rows that are equal in `order` may be split over partitions and follow each other in no particular order.
    """
    spark = df.sparkSession
    spread, part = unused(df, "spread", "part")
    begin = [f"{part}_{k}" for k in range(len(values))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = dict.fromkeys(values, 0)
        me = TaskContext.get().partitionId()
        for batch in batches:
            batch = batch.append_column(part, pa.array([me] * batch.num_rows, pa.int32()))
            for name, to in values.items():
                sums = np.cumsum(batch.column(name).to_numpy(zero_copy_only=False)) + totals[name]
                totals[name] = sums[-1] if len(sums) else totals[name]
                batch = batch.append_column(to, pa.array(sums))
            yield batch

    ordered = df.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order, spread).sortWithinPartitions(*order, spread).drop(spread)
    schema = StructType([*df.schema.fields, StructField(part, IntegerType()), *[StructField(to, df.schema[name].dataType) for name, to in values.items()]])
    summed = materialise(ordered.mapInArrow(add, schema), label)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition, so both the window and the broadcast are small whatever the input
    ends = summed.groupBy(part).agg(*[F.sum(name).alias(b) for name, b in zip(values, begin)])
    starts = ends.select(part, *[F.coalesce(F.sum(b).over(before), F.lit(0)).alias(b) for b in begin])
    return summed.join(F.broadcast(starts), part).withColumns({to: F.col(to) + F.col(b) for to, b in zip(values.values(), begin)}).drop(part, *begin)


def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text; none where it is null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def row_hash(df: DataFrame, seed: int) -> Column:
    """A hash of the whole row (maps, which Spark does not hash, left out): equal only for equal rows, save for chance."""
    names = sorted(f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString())
    return F.xxhash64(F.lit(seed).cast("long"), *[F.col(f"`{n}`") for n in names])
