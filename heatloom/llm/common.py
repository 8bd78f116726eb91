"""What the operators of this subpackage share: table access and lineage cuts."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words and are stripped from line ends: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
RELEASE_SECONDS = 5.0
_released = 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct: names of an operator's own columns can't clash with them."""
    return F.struct(*[column(c).alias(c) for c in df.columns])


def unpacked(names: list[str], row: str = "row", **replaced: Column) -> list[Column]:
    """The columns of a whole_row; some of them replaced."""
    return [replaced.get(c, F.col(row).getField(c)).alias(c) for c in names]


def whole_numbers(df: DataFrame, name: str) -> None:
    """The operator's ids must be integers."""
    if df.schema[name].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"column {name!r} must hold whole numbers, not {df.schema[name].dataType.simpleString()}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where none is named, and only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def write_cut(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: later jobs do not recompute what made it,
    and the loss of an executor does not lose it. Also gives the path."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    return write_cut(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of write_cut that no later job reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so when the driver's garbage is collected.
    At most once in RELEASE_SECONDS, as a collection stops the driver."""
    global _released
    if time.monotonic() - _released >= RELEASE_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _released = time.monotonic()


#: A key is hot if it has more than this share of all rows: so many keys can be hot at most.
HOT_KEYS = 1000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique and not null. The keys that hold over 1 / HOT_KEYS of left's rows (HOT_KEYS
    at most, hence the broadcast) meet right's rows where they are; only the others are shuffled. left and right are read
    more than once: written tables, or cheap."""
    many = left.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = left.count()
    hot = many.where(F.col("__n") * HOT_KEYS > total).drop("__n")
    hot = hot.join(F.broadcast(right.join(F.broadcast(hot), keys)), keys, how)
    names = [c for c in right.columns if c not in keys]
    marked = left.join(F.broadcast(hot.withColumn("__hot", F.struct(F.lit(True), *names)).drop(*names)), keys, "left")
    near = marked.where("__hot is not null").select(*left.columns, *[F.col("__hot").getField(c).alias(c) for c in names])
    far = marked.where("__hot is null").drop("__hot").join(right, keys, how).select(*left.columns, *names)
    return near.unionByName(far)


def give_back() -> None:
    """Let this process return the memory that it no longer needs: Python workers outlive their tasks and hold it beside the JVM."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidy(run):
    """run (of mapInPandas or mapInArrow), after which the worker's free memory is given back."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def slices(sizes, most: int):
    """(start, stop) runs of rows whose sizes add up to about `most`; a larger row is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
