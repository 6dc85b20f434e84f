"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space between words: the blank and U+0009 to U+000D.
SPACE = r"[ \t\n\x0B\f\r]+"

#: Rows of narrow tables up to which they are broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="meshloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/meshloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.meshloom_path = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``written`` gave, once all that was made of them is written too."""
    for table in tables:
        delete(table.sparkSession, table.meshloom_path)


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has no more than ``most`` rows; else joined by key."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """A stored copy of ``df`` with consecutive numbers from 0 in ``order``: sorted spans, and in each the numbers after those of the spans before.

    ``order`` should tell all rows apart, so that no span becomes longer than the others.
    """
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    span = F.shiftright("_m", 33)
    # one row for each span
    before = F.sum("_c").over(W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
    starts = rows.groupBy(span.alias("_span")).agg(F.count("*").alias("_c")).select("_span", F.coalesce(before, F.lit(0)).alias("_start"))
    out = rows.withColumn("_span", span).join(F.broadcast(starts), "_span")
    out = out.withColumn(name, F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_span", "_start")
    out.meshloom_path = rows.meshloom_path
    return out


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")
