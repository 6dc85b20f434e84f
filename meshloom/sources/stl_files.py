"""STL files as a Spark data source: read by ranges of records, written by parts.

``spark.dataSource.register(StlFiles)``, then ``spark.read.format("stl").load(folder)`` and ``facets.write.format("stl").save(folder)``.

Reading: the driver lists names and sizes only. A binary file becomes ranges of ``facets`` records, each a partition that seeks to
its first record; small files share a partition; an ASCII file is parsed as a whole by the partition that holds its start.

Writing: facets (mesh_id, fid, nx .. nz, x0 .. z2, attribute), in the order in which they come, become one file for each partition and mesh,
``<mesh_id>/part-<partition>.stl``, each a whole binary STL file. Tasks write into a folder of their own, and a commit moves what was written into
place, so failed and repeated tasks leave nothing. ``joined`` makes one file of a mesh's parts, in a task.

Files are opened through pyarrow's file systems, on the executors.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from meshloom.sources import stl

#: Records in a partition.
FACETS = 250_000
#: Bytes that are copied at a time when parts are joined.
COPY = 8 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


@dataclass
class Ranges(InputPartition):
    """(path, size, first facet, facets) of each range."""

    parts: list[tuple[str, int, int, int]] = field(default_factory=list)


def ranges_of(files: list[tuple[str, int]], facets: int) -> list[Ranges]:
    """Partitions of some ``facets`` records each; files that are smaller share one."""
    out, open_, room = [], Ranges(), 0
    for path, size in files:
        n = max(-(-(size - stl.HEADER) // stl.RECORD), 1)
        if n < facets:
            if n > room:
                open_, room = Ranges(), facets
                out.append(open_)
            open_.parts.append((path, size, 0, n))
            room -= n
        else:
            out += [Ranges([(path, size, at, min(facets, n - at))]) for at in range(0, n, facets)]
    return out


def header_of(data: bytes, size: int) -> int | None:
    """The facets that a binary file's header tells, or None for an ASCII file. ``data``: the first bytes of a file of ``size``."""
    solid = data[:80].strip().startswith(b"solid")
    n = struct.unpack_from("<I", data, 80)[0] if len(data) >= stl.HEADER else None
    if solid and not (size > stl.HEADER and n is not None and abs(size - (stl.HEADER + stl.RECORD * n)) < 10):
        return None
    if n is None:
        raise stl.StlError("the file is shorter than its header")
    if size < stl.HEADER + stl.RECORD * n:
        raise stl.StlError(f"the file ends before its {n} facets")
    if not n:
        raise stl.StlError("the file has no facets")
    return n


def read_range(path: str, size: int, first: int, facets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first, corners, normals, attributes) of the facets in a range of a file, ``stl.BATCH`` at a time."""
    fs, at = opened(path)
    with fs.open_input_file(at) as file:
        n = header_of(file.read_at(stl.HEADER, 0), size)
        if n is None:
            if first == 0:
                xyz, normals = stl.parse(file.read_at(size, 0))
                yield 0, xyz, normals, np.zeros(len(xyz), np.uint16)
            return
        for k in range(first, min(first + facets, n), stl.BATCH):
            m = min(stl.BATCH, first + facets - k, n - k)
            rows = np.frombuffer(file.read_at(stl.RECORD * m, stl.HEADER + stl.RECORD * k), stl.FACET)
            if not np.isfinite(rows["corners"]).all():
                raise stl.StlError("the file has coordinates that are no numbers")
            yield k, rows["corners"], rows["normal"], rows["attribute"]


class StlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.facets = options["path"], int(options.get("facets", FACETS))

    def partitions(self) -> list[Ranges]:
        fs, root = opened(self.path)
        # names as they were given: a file system strips what stands before its own paths
        given = "file:" if self.path.startswith("file:") else self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        names = sorted((given + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(".stl") and "/_" not in f.path[len(root) :])
        return ranges_of(names, self.facets)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, size, first, facets in partition.parts:
            for k, xyz, normals, colours in read_range(path, size, first, facets):
                yield from stl.corner_batches(path, xyz, normals, k, colours)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class StlWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.title, self.overwrite = options["path"], options.get("title", "meshloom"), overwrite
        self.stage = posixpath.join(self.path, f"_temporary-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        fs, stage = opened(self.stage)
        counts: dict[str, int] = {}
        # the count stands before the records: these are spooled by mesh, then copied behind their header
        for batch in iterator:
            frame = batch.to_pandas()
            for mesh, rows in frame.groupby("mesh_id", sort=False):
                out = np.zeros(len(rows), stl.FACET)
                out["normal"] = rows[["nx", "ny", "nz"]].to_numpy(np.float32)
                out["corners"] = rows[[f"{c}{k}" for k in range(3) for c in "xyz"]].to_numpy(np.float32).reshape(-1, 3, 3)
                out["attribute"] = rows["attribute"].to_numpy(np.uint16)
                folder = posixpath.join(stage, quote(mesh, safe=""))
                fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(posixpath.join(folder, f"{part}-{attempt}-{counts.get(mesh, 0)}.records")) as file:
                    file.write(out.tobytes())
                counts[mesh] = counts.get(mesh, 0) + len(rows)
        files = []
        for mesh, n in counts.items():
            name = quote(mesh, safe="")
            folder, target = posixpath.join(stage, name), posixpath.join(stage, name, f"part-{part:05d}-{attempt}.stl")
            prefix = f"{part}-{attempt}-"
            spools = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.startswith(prefix) and f.base_name.endswith(".records")]
            spools.sort(key=lambda p: int(posixpath.basename(p)[len(prefix) : -len(".records")]))
            with fs.open_output_stream(target) as out:
                out.write(self.title.encode()[:80].ljust(80, b"\0") + struct.pack("<I", n))
                for spool in spools:
                    copied(fs, spool, out)
            for spool in spools:
                fs.delete_file(spool)
            files.append((target, posixpath.join(name, f"part-{part:05d}.stl")))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        _, stage = opened(self.stage)
        fs.create_dir(root, recursive=True)
        old = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.path != stage]
        if old and not self.overwrite:
            # appended parts come after those that are there
            run = f"{uuid.uuid4().hex[:8]}-"
        else:
            run = ""
            for f in old:
                (fs.delete_dir if f.type == pafs.FileType.Directory else fs.delete_file)(f.path)
        for m in messages:
            for source, name in m.files if m else ():
                folder, base = posixpath.split(name)
                fs.create_dir(posixpath.join(root, folder), recursive=True)
                fs.move(source, posixpath.join(root, folder, run + base))
        if fs.get_file_info(stage).type == pafs.FileType.Directory:
            fs.delete_dir(stage)

    def abort(self, messages: list[Written | None]) -> None:
        fs, stage = opened(self.stage)
        if fs.get_file_info(stage).type == pafs.FileType.Directory:
            fs.delete_dir(stage)


class StlFiles(DataSource):
    """Options: path, facets (records in a partition that is read), title (of written files)."""

    @classmethod
    def name(cls) -> str:
        return "stl"

    def schema(self) -> str:
        return f"{stl.CORNERS}, attribute int"

    def reader(self, schema) -> StlReader:
        return StlReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> StlWriter:
        return StlWriter(dict(self.options), overwrite)


def copied(fs: pafs.FileSystem, path: str, out) -> None:
    with fs.open_input_stream(path) as file:
        while data := file.read(COPY):
            out.write(data)


def joined(spark: SparkSession, path: str, target: str) -> DataFrame:
    """One binary STL file ``target``/<mesh>.stl for each mesh in the folder ``path`` that the data source wrote; (mesh_id, facets). A task copies one mesh."""
    fs, root = opened(path)
    meshes = [posixpath.basename(f.path) for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.Directory]
    opened(target)[0].create_dir(opened(target)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                fs, folder = opened(posixpath.join(path, name))
                parts = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".stl"))
                n = sum((f.size - stl.HEADER) // stl.RECORD for f in fs.get_file_info(parts))
                to, place = opened(posixpath.join(target, f"{name}.stl"))
                with to.open_output_stream(place + ".part") as out:
                    for k, part in enumerate(parts):
                        with fs.open_input_stream(part) as file:
                            head = file.read(stl.HEADER)
                            if not k:
                                out.write(head[:80] + struct.pack("<I", n))
                            while data := file.read(COPY):
                                out.write(data)
                to.move(place + ".part", place)
                yield pa.RecordBatch.from_arrays([pa.array([unquote(name)]), pa.array([n])], names=["mesh_id", "facets"])

    rows = spark.createDataFrame([(m,) for m in meshes], "name string").repartition(max(len(meshes), 1), "name")
    return rows.mapInArrow(run, "mesh_id string, facets long")
