"""STL files: read into corners, written from faces.

corners: mesh_id, fid, corner, x, y, z, nx, ny, nz (floats); the facet's normal stands at its three corners.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions import geometry as g
from meshloom.operators import topology

HEADER, RECORD = 84, 50
FACET = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])
VERTEX = re.compile(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)")
NORMAL = re.compile(rb"facet\s+normal\s+(\S+)\s+(\S+)\s+(\S+)")
CORNERS = "mesh_id string, fid long, corner int, x float, y float, z float, nx float, ny float, nz float"
#: Facets in a batch of rows, and in a chunk of a written file.
BATCH = 20_000


class StlError(ValueError):
    pass


def is_ascii(data: bytes) -> bool:
    """Starts with ``solid`` and has not the size that its facet count would give a binary file."""
    if not data[:80].strip().startswith(b"solid"):
        return False
    return not (len(data) > HEADER and abs(len(data) - (HEADER + RECORD * struct.unpack_from("<I", data, 80)[0])) < 10)


def parse(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(corners n x 3 x 3, facet normals n x 3). Raises StlError for files that are short, empty or not finite."""
    if is_ascii(data):
        try:
            xyz, normals = (np.array([[float(x) for x in m.groups()] for m in found.finditer(data)], np.float32).reshape(-1, 3) for found in (VERTEX, NORMAL))
        except ValueError as error:
            raise StlError(f"the file has a line that is no point: {error}") from None
        if len(xyz) % 3:
            raise StlError("the file ends within a facet")
        xyz = xyz.reshape(-1, 3, 3)
        # facets without a line of their own have no normal
        normals = np.concatenate([normals[: len(xyz)], np.zeros((max(len(xyz) - len(normals), 0), 3), np.float32)])
    else:
        if len(data) < HEADER:
            raise StlError("the file is shorter than its header")
        n = struct.unpack_from("<I", data, 80)[0]
        if len(data) < HEADER + RECORD * n:
            raise StlError(f"the file ends before its {n} facets")
        facets = np.frombuffer(data, FACET, n, HEADER)
        xyz, normals = facets["corners"], facets["normal"]
    if not len(xyz):
        raise StlError("the file has no facets")
    if not np.isfinite(xyz).all():
        raise StlError("the file has coordinates that are no numbers")
    return xyz, normals


def corner_batches(mesh: str, xyz: np.ndarray, normals: np.ndarray, first: int = 0, attributes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of CORNERS of facets numbered from ``first``, with their attributes if given."""
    for at in range(0, len(xyz), BATCH):
        p, n = xyz[at : at + BATCH], normals[at : at + BATCH]
        k = len(p)
        columns = [pa.array([mesh] * (3 * k)), pa.array(np.repeat(np.arange(first + at, first + at + k), 3)), pa.array(np.tile(np.arange(3, dtype=np.int32), k))]
        columns += [pa.array(np.ascontiguousarray(p.reshape(-1, 3)[:, c])) for c in range(3)] + [pa.array(np.repeat(n[:, c], 3)) for c in range(3)]
        names = ["mesh_id", "fid", "corner", "x", "y", "z", "nx", "ny", "nz"]
        if attributes is not None:
            columns, names = [*columns, pa.array(np.repeat(attributes[at : at + BATCH].astype(np.int32), 3))], [*names, "attribute"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def decode(files: DataFrame) -> DataFrame:
    """(path, content) -> corners; a task holds one file. For stores that only Spark opens; ``read`` takes ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from corner_batches(path, *parse(content))

    return files.select("path", "content").mapInArrow(run, CORNERS)


def read(spark: SparkSession, path: str, facets: int | None = None) -> DataFrame:
    """Corners of all ``*.stl`` files under a path; mesh_id is the file's path. Large binary files are read by ranges of ``facets`` records.

    Where pyarrow has no file system for the path, Spark's own reader hands each file to a task.
    """
    from meshloom.sources import stl_files

    try:
        stl_files.opened(path)
    except (pa.ArrowInvalid, OSError):
        return decode(spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][tT][lL]").option("recursiveFileLookup", "true").load(path))
    spark.dataSource.register(stl_files.StlFiles)
    return spark.read.format("stl").option("facets", facets or stl_files.FACETS).load(path).drop("attribute")


def load(corners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corners in millimetres, welded: (vertices, faces)."""
    return topology.weld(topology.scaled(corners))


def facet_rows(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh_id, fid, normal, corners and attribute of each face: coloured by the mean of the corners' deviation where vertices have one."""
    colour = "deviation" in vertices.columns
    rows = topology.gather(faces, vertices, ("x", "y", "z", "deviation") if colour else ("x", "y", "z"))
    a, b, c = topology.corner_points()
    return rows.select("mesh_id", "fid", *[n.cast("float").alias(f"n{k}") for n, k in zip(g.face_normal(a, b, c), "xyz", strict=True)], *[F.col(f"{c}{k}").cast("float").alias(f"{c}{k}") for k in range(3) for c in "xyz"],
                       (g.rgb555((F.col("deviation0") + F.col("deviation1") + F.col("deviation2")) / 3) if colour else F.lit(0)).cast("int").alias("attribute"))


def save(faces: DataFrame, vertices: DataFrame, path: str, parts: int | None = None, title: str = "meshloom") -> None:
    """Writes each mesh as STL files ``path``/<mesh_id>/part-<n>.stl in the order of fid, coloured where vertices have a deviation; each part by its own task.

    ``stl_files.joined`` makes one file of a mesh's parts.
    """
    from meshloom.sources import stl_files

    rows, order = facet_rows(faces, vertices), ("mesh_id", "fid")
    rows = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    faces.sparkSession.dataSource.register(stl_files.StlFiles)
    rows.write.format("stl").option("title", title).mode("overwrite").save(path)
