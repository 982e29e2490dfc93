"""What the operators share: the shared folder, written cuts of lineage, size checks."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that an operator broadcasts; beyond it every operator has a way that doesn't.
BROADCAST_BYTES = 32 << 20

#: Rows and bytes that a Python worker gets at once, at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where that is unset one of this machine's own, if there is no other machine."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="tabulon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write `df` as Parquet under the shared folder and read it again. Survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabulon/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, size_bytes: int) -> DataFrame:
    """`df` with a broadcast hint if its proven size is within the bound."""
    return F.broadcast(df) if size_bytes <= BROADCAST_BYTES else df


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ship(spark: SparkSession) -> None:
    """Give executors this package, once: functions that run there refer to it. And bound what they get at once, as texts may be long."""
    for name, most in BATCH.items():
        now = int(spark.conf.get(name, str(most)).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
    sc = spark.sparkContext
    if getattr(sc, "_tabulon_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tabulon-"), "tabulon_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._tabulon_shipped = True


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for other work, and what it keeps adds to its executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy_batches(run: Callable) -> Callable:
    """For mapInArrow: memory is given back after a partition."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


#: Seconds between two times that memory is given back after groups, of which a task may have thousands; when it last was.
PAUSE = 0.3
_given = [0.0]


def _give_back_now_and_then() -> None:
    if time.monotonic() - _given[0] >= PAUSE:
        give_back()
        _given[0] = time.monotonic()


def tidy_group(run: Callable) -> Callable:
    """For grouped functions: memory is given back after a group, but not after each of many small ones."""

    def one(pdf):
        out = run(pdf)
        _give_back_now_and_then()
        return out

    def two(key, pdf):
        out = run(key, pdf)
        _give_back_now_and_then()
        return out

    return two if run.__code__.co_argcount == 2 else one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; what is done with it may run on executors, so they get the package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
