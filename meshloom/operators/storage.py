"""Tables between jobs of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir; where that is unset, in a temporary folder in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="meshloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/meshloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` stored in buckets of ``keys``: joins and groupings on these keys read it without an exchange."""
    spark, path, name = df.sparkSession, shared_path(df.sparkSession), f"meshloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved; the files stay when the catalog forgets the name
    spark.sql(f"DROP TABLE {name}")
    return out


#: Rows of a table dealt by a key that one task gets.
ROWS = 1_000_000


def parts_of(count: int) -> int:
    """In how many parts a table of ``count`` rows is dealt by a key, so that what a task holds does not grow with the table; 0: as Spark does, as all of it is one part."""
    return -(-count // ROWS) if count > ROWS else 0


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into that many parts before anything is grouped or sorted: a task that reads many rows hands them on and keeps none. 0: ``df`` itself."""
    return df.repartition(parts, *keys) if parts else df


#: Rows of a table of one row for each mesh up to which it is sent to all tasks, and the parts that a mesh is split into beyond that.
MESHES, PARTS = 10_000, 64


def with_mesh(rows: DataFrame, per_mesh: DataFrame, how: str = "inner", keys: tuple[str, ...] = ("mesh_id",), parts: int = PARTS) -> DataFrame:
    """``rows`` with the columns of a table that has one row for each mesh (or each of ``keys``).

    That table is counted: up to ``MESHES`` rows it is sent to all tasks, so that no vertex or face is shuffled. Beyond, it is joined by
    mesh and part, so that a large mesh is spread over ``parts`` tasks.
    """
    few = per_mesh.limit(MESHES + 1).toArrow()
    if few.num_rows <= MESHES:
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame(few, per_mesh.schema)), list(keys), how)
    if parts == 1:
        return rows.join(per_mesh, list(keys), how)
    each = per_mesh.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.lit(parts)).cast("int")).join(each, [*keys, "_part"], how).drop("_part")
