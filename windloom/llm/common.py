"""Helpers shared by the corpus operators: scratch tables, Arrow column access and input guards."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Python step inside an Arrow batch, so that a batch of long texts is worked off in bounded memory.
STEP_ROWS = 512

#: A key is heavy if it holds over one in HEAVY of the rows, so that there are always fewer than HEAVY heavy keys.
HEAVY = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, set here only where it is unset and Spark is one process (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="windloom-"))  # one process: it shares any folder with itself
        found = sc.getCheckpointDir()
    return found


class Scratch:
    """Written tables that cut lineage. They lie in the shared folder, so losing an executor loses none of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path(name))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def join_heavy(rows: DataFrame, side: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` (``total`` of them) with ``side``, where one key may hold a large part of the rows.

    Column ``n`` of ``side`` tells how many of the rows have its key. The side's few heavy keys are broadcast, so their rows
    stay where they are; all other rows meet by a shuffle. ``side`` should be a written table of few rows a key.
    """
    heavy = side.where(F.col(n) > total // HEAVY)
    hot = rows.join(F.broadcast(heavy), on)
    cold = rows.join(F.broadcast(heavy.select(*on).distinct()), on, "left_anti").join(side.where(F.col(n) <= total // HEAVY), on)
    return hot.unionByName(cold)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` would also change letters beyond ASCII."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_steps(texts: pa.Array, size: int = 4 << 20):
    """(first, end) of stretches of rows that hold about ``size`` bytes of text at most, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield a, z
        a = z


def whole_row(docs: DataFrame) -> Column:
    """All columns of a document in one struct, under names that can't clash with those a step adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def texts_of(rows: pa.Array, column: str = "text") -> pa.Array:
    """The texts inside an Arrow array of such structs, nulls as empty texts."""
    return pc.fill_null(rows.field(column).cast(pa.string()), "") if rows.null_count == 0 else pc.fill_null(pc.struct_field(rows, column).cast(pa.string()), "")


def steps(n: int, size: int = STEP_ROWS):
    return ((i, min(n, i + size)) for i in range(0, n, size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
