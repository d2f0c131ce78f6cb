"""Shared-storage helpers: cutting lineage with written tables.

Every intermediate that is reused, or that an iterative job needs, is written
as Parquet below the folder named by ``spark.checkpoint.dir``.  A lost executor
then costs a re-read, never a recomputation of the whole job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a local master gets a temporary one and a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="earshot-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and return a reader of the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/earshot-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables written by ``materialize`` that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_written_at", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts may be long: keep the Arrow batches that Python workers hold small.

    Spark has this bound for a session only, so it stays set for what runs
    later; every operator of this subpackage sets the same.  A batch is also
    bounded in bytes, by spark.sql.execution.arrow.maxBytesPerBatch.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def join_even(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", merge: bool = True) -> DataFrame:
    """Equi-join whose hot keys AQE may split.

    Skew splitting needs a plain exchange below both sides, and an aggregate
    that is already partitioned by the key has none.  A second key derived from
    the first makes the planner deal out both sides for the join itself.  With
    ``merge`` it is a sort-merge join at every size, so that no plan changes
    when one side outgrows the broadcast limit; without, Catalyst chooses.
    """
    salt = free_name("_even", left, right)
    h = F.pmod(F.xxhash64(*on), F.lit(1 << 20))
    right = right.withColumn(salt, h)
    return left.withColumn(salt, h).join(right.hint("merge") if merge else right, [*on, salt], how).drop(salt)


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, or with more of its first letter as long as a frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = name[0] + name
    return name


def every(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """Each row of ``df`` as the struct _row, beside ``more``: helpers can't clash with its columns; ``_row.*`` gives them back."""
    return df.select(F.struct(*every(df)).alias("_row"), *[v.alias(k) for k, v in more.items()])


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of ``docs``; a null text counts as empty."""
    cols = columns or ("doc_id", "text")
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "text" else F.col(c) for c in cols])
