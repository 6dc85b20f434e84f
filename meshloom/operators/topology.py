"""Joins and groupings over the faces, edges and vertices of meshes.

vertices: mesh_id, vid, x, y, z (and nx, ny, nz), floats. faces: mesh_id, fid, i0, i1, i2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.functions import geometry as g
from meshloom.operators.graph import connected_components
from meshloom.operators.storage import PARTS, dealt, parts_of, stored, with_mesh


def corners(faces: DataFrame) -> DataFrame:
    """(mesh_id, fid, corner, vid): three rows for each face."""
    return faces.select("mesh_id", "fid", F.posexplode(F.array("i0", "i1", "i2")).alias("corner", "vid"))


def gather(faces: DataFrame, vertices: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Faces with the columns of their corners as x0, y0, z0, x1, ...: one join of corners with vertices, then one grouping."""
    rows = corners(faces).join(vertices.select("mesh_id", "vid", *columns), ["mesh_id", "vid"])
    at = lambda c, k: F.max(F.when(F.col("corner") == k, F.col(c)))
    return rows.groupBy("mesh_id", "fid").agg(*[at("vid", k).alias(f"i{k}") for k in range(3)], *[at(c, k).alias(f"{c}{k}") for k in range(3) for c in columns])


def soup(faces: DataFrame, vertices: DataFrame, parts: int = 0) -> DataFrame:
    """Corners (mesh_id, fid, corner) with the other columns of their vertices, ids left out, as an STL file has them; joined in so many parts, 0 as Spark does."""
    points = dealt(vertices, parts, "mesh_id", "vid")
    # few bytes of a source may stand for many vertices: they are not sent to all tasks for that
    return dealt(corners(faces), parts, "mesh_id", "vid").join(points.hint("shuffle_hash") if parts else points, ["mesh_id", "vid"]).drop("vid")


def corner_points() -> tuple[g.Vec, g.Vec, g.Vec]:
    return g.point(suffix="0"), g.point(suffix="1"), g.point(suffix="2")


def _sides() -> Column:
    return F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("i0", "i1"), ("i1", "i2"), ("i2", "i0"))])


def edge_uses(faces: DataFrame) -> DataFrame:
    """(mesh_id, a, b, uses) of undirected edges, a <= b: in how many faces each is a side."""
    sides = faces.select("mesh_id", F.explode(_sides()).alias("s"))
    return sides.groupBy("mesh_id", F.least("s.a", "s.b").alias("a"), F.greatest("s.a", "s.b").alias("b")).agg(F.count("*").alias("uses"))


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edge_uses(faces).filter("uses = 1").select("mesh_id", "a", "b")


def boundary_vertices(faces: DataFrame) -> DataFrame:
    return boundary_edges(faces).select("mesh_id", F.explode(F.array("a", "b")).alias("vid")).distinct()


def adjacency(faces: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(mesh_id, src, dst) of distinct directed edges; with vertices, also their length w."""
    rows = edge_uses(faces).filter("a <> b")
    rows = rows.select("mesh_id", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("mesh_id", "e.*")
    if vertices is None:
        return rows
    ends = vertices.select("mesh_id", "vid", "x", "y", "z")
    for name, tag in (("src", "s"), ("dst", "d")):
        rows = rows.join(ends.select("mesh_id", F.col("vid").alias(name), *[F.col(c).alias(c + tag) for c in "xyz"]), ["mesh_id", name])
    return rows.select("mesh_id", "src", "dst", g.distance(g.point(suffix="s"), g.point(suffix="d")).alias("w"))


def neighbours(edges: DataFrame, vid: int) -> DataFrame:
    return edges.filter(F.col("src") == vid).select("mesh_id", F.col("dst").alias("vid"), "w")


def boundary_loops(faces: DataFrame) -> DataFrame:
    """(mesh_id, loop, vid, n_vertices, is_rim): components of the boundary; the rim is the largest, of equal ones that of the least vertex."""
    loops = connected_components(boundary_edges(faces)).withColumnRenamed("component", "loop")
    sizes = loops.groupBy("mesh_id", "loop").agg(F.count("*").alias("n_vertices"))
    rim = sizes.groupBy("mesh_id").agg(F.max(F.struct("n_vertices", (-F.col("loop")).alias("x"))).alias("m")).select("mesh_id", (-F.col("m.x")).alias("loop"), F.lit(True).alias("is_rim"))
    return loops.join(sizes, ["mesh_id", "loop"]).join(rim, ["mesh_id", "loop"], "left").select("mesh_id", "loop", F.col("node").alias("vid"), "n_vertices", F.coalesce("is_rim", F.lit(False)).alias("is_rim"))


def face_components(faces: DataFrame) -> DataFrame:
    """Faces with component (least vertex) and is_largest: faces that share vertices belong together; of equal ones the one seen first wins."""
    pairs = faces.select("mesh_id", F.explode(F.array(F.struct(F.col("i0").alias("a"), F.col("i1").alias("b")), F.struct(F.col("i1").alias("a"), F.col("i2").alias("b")))).alias("e")).select("mesh_id", "e.*")
    labels = connected_components(pairs).withColumnRenamed("node", "i0")
    rows = faces.join(labels, ["mesh_id", "i0"], "left").withColumn("component", F.coalesce("component", "i0"))
    best = rows.groupBy("mesh_id", "component").agg(F.count("*").alias("n"), F.min("fid").alias("first"))
    best = best.groupBy("mesh_id").agg(F.max(F.struct(F.col("n"), (-F.col("first")).alias("x"), F.col("component"))).alias("m")).select("mesh_id", F.col("m.component").alias("largest"))
    return with_mesh(rows, best).select(*faces.columns, "component", (F.col("component") == F.col("largest")).alias("is_largest"))


def used_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The vertices that ``faces`` use, with their ids kept."""
    return vertices.join(corners(faces).select("mesh_id", "vid").distinct(), ["mesh_id", "vid"], "left_semi").select(*vertices.columns)


#: Places in the order of a mesh that are numbered in one group.
SPAN = 1 << 17


def numbered(rows: DataFrame, order: str, name: str, parts: int = 0) -> DataFrame:
    """rows with dense numbers from 0 in the order of a column of each mesh (integers from 0, each once): numbers in spans of it, after the counts of the spans before.

    The spans are dealt into so many parts, 0 as Spark does.
    """
    rows = rows.withColumn("_span", F.expr(f"{order} div {SPAN}"))
    counts = rows.groupBy("mesh_id", "_span").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("mesh_id").orderBy("_span").rowsBetween(W.unboundedPreceding, -1))  # one row for each span
    counts = counts.select("mesh_id", "_span", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("mesh_id", "_span").orderBy(order)) - 1 + F.col("_before")
    rows, counts = (dealt(t, parts, "mesh_id", "_span") for t in (rows, counts))
    return rows.join(counts, ["mesh_id", "_span"]).withColumn(name, place.cast("long")).drop("_span", "_before")


def compacted(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Used vertices and faces with new ids from 0 in the order of first use."""
    first = corners(faces).groupBy("mesh_id", "vid").agg(F.min(F.col("fid") * 3 + F.col("corner")).alias("first"))
    ids = numbered(first, "first", "new").select("mesh_id", "vid", "new")
    out = faces
    for c in ("i0", "i1", "i2"):
        out = out.join(ids.select("mesh_id", F.col("vid").alias(c), F.col("new").alias(f"_{c}")), ["mesh_id", c])
    rest = [c for c in vertices.columns if c not in ("mesh_id", "vid")]
    return vertices.join(ids, ["mesh_id", "vid"]).select("mesh_id", F.col("new").alias("vid"), *rest), out.select("mesh_id", "fid", *[F.col(f"_i{k}").alias(f"i{k}") for k in range(3)])


def unit_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vertices with nx, ny, nz as doubles: normalised sums of the cross products of their faces, so large faces weigh more."""
    points = vertices.select("mesh_id", "vid", "x", "y", "z")
    a, b, c = corner_points()
    normal = g.cross(g.sub(b, a), g.sub(c, a))
    each = gather(faces, points).select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("vid"), *[n.alias(f"n{k}") for n, k in zip(normal, "xyz", strict=True)])
    sums = each.groupBy("mesh_id", "vid").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"])
    unit = g.normalized(tuple(F.coalesce(F.col(f"n{k}"), F.lit(0.0)) for k in "xyz"))
    return points.join(sums, ["mesh_id", "vid"], "left").select("mesh_id", "vid", "x", "y", "z", *[n.alias(f"n{k}") for n, k in zip(unit, "xyz", strict=True)])


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``unit_normals`` stored as floats."""
    return unit_normals(vertices, faces).select("mesh_id", "vid", "x", "y", "z", *[F.col(f"n{k}").cast("float").alias(f"n{k}") for k in "xyz"])


def cells(vertices: DataFrame, target_faces: int) -> DataFrame:
    """vertices with the grid cell (bigint) that vertex clustering puts them in; about target_faces / 2 cells."""
    res = max(10, -(-round((target_faces / 2) ** (1 / 3) * 1e9) // 10**9))
    box = vertices.groupBy("mesh_id").agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    rows = with_mesh(vertices, box)
    part = []
    for c in "xyz":
        extent = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        step = F.when(extent != 0, extent).otherwise(1e-6) / res
        part.append(F.least(F.lit(res - 1), F.floor((F.col(c).cast("double") - F.col(f"lo_{c}")) / step)))
    cell = part[0] + part[1] * (res + 1) + part[2] * (res + 1) * (res + 1)
    return rows.select(*vertices.columns, cell.cast("long").alias("cell"))


def decimate(vertices: DataFrame, faces: DataFrame, target_faces: int = 300_000) -> tuple[DataFrame, DataFrame]:
    """Vertex clustering: (cell centroids as vertices with n merged, faces between different cells)."""
    placed = cells(vertices, target_faces)
    merged = placed.groupBy("mesh_id", F.col("cell").alias("vid")).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in "xyz"], F.count("*").alias("n"))
    out = corners(faces).join(placed.select("mesh_id", "vid", "cell"), ["mesh_id", "vid"]).groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("corner") == k, F.col("cell"))).alias(f"i{k}") for k in range(3)])
    return merged, out.filter("i0 <> i1 AND i1 <> i2 AND i2 <> i0")


def cluster_means(vertices: DataFrame, attribute: str, target_faces: int = 300_000) -> DataFrame:
    """Mean of an attribute of the vertices in each cell."""
    return cells(vertices, target_faces).groupBy("mesh_id", "cell").agg(F.avg(attribute).alias(attribute))


def _clipped(rows: DataFrame, origin: g.Vec, normal: g.Vec, eps: float) -> DataFrame:
    pts = []
    for k in range(3):
        p = g.point(suffix=str(k))
        pts.append(F.struct(F.col(f"i{k}").alias("i"), *[c.alias(n) for c, n in zip(p, "xyz", strict=True)], g.plane_distance(p, origin, normal).alias("d")))
    ring = F.array(*[F.struct(pts[k].alias("a"), pts[(k + 1) % 3].alias("b")) for k in range(3)])

    def side(e):
        # from the lesser id on, so that both faces of an edge get the same point
        turned = e.a.i > e.b.i
        p = {c: (F.when(turned, e.b[c]).otherwise(e.a[c]), F.when(turned, e.a[c]).otherwise(e.b[c])) for c in "xyzd"}
        t = p["d"][0] / (p["d"][0] - p["d"][1])
        crossing = F.struct(*[(p[c][0] + (p[c][1] - p[c][0]) * t).alias(c) for c in "xyz"])
        end = F.struct(*[e.b[c].alias(c) for c in "xyz"])
        inside_a, inside_b = e.a.d >= -eps, e.b.d >= -eps
        none = F.array_remove(F.array(end), end)
        return F.when(inside_a & inside_b, F.array(end)).when(inside_a, F.array(crossing)).when(inside_b, F.array(crossing, end)).otherwise(none)

    shape = rows.select("mesh_id", "fid", F.flatten(F.transform(ring, side)).alias("p"))
    fans = shape.filter(F.size("p") >= 3).select("mesh_id", "fid", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 2)).alias("part"))
    return fans.select("mesh_id", "fid", "part", *[F.get("p", k)[c].alias(f"{n}{c}") for n, k in (("a", F.lit(0)), ("b", F.col("part")), ("c", F.col("part") + 1)) for c in "xyz"])


def clip(faces: DataFrame, vertices: DataFrame, origin: g.Vec, normal: g.Vec, eps: float = 1e-6) -> DataFrame:
    """Triangles (mesh_id, fid, part, ax .. cz) of what is left of each face on the normal's side of a plane.

    One pass over the corners gives a polygon of at most four points; it is cut into a fan.
    """
    return _clipped(gather(faces, vertices), origin, normal, eps)


def clip_mesh(faces: DataFrame, vertices: DataFrame, planes: DataFrame, eps: float = 1e-6, tolerance: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """What is left of each mesh on its own plane's side (mesh_id, qx .. qz, nx .. nz), as a mesh: (vertices, faces).

    Points that round to the same multiple of the tolerance are one vertex. Face f's triangles are 2 f and 2 f + 1.
    """
    planes = planes.select("mesh_id", *[f"{k}{c}" for k in "qn" for c in "xyz"])
    rows = _clipped(with_mesh(gather(faces, vertices), planes), tuple(F.col(f"q{c}") for c in "xyz"), tuple(F.col(f"n{c}") for c in "xyz"), eps)
    corner = F.posexplode(F.array(*[F.struct(*[F.col(f"{s}{c}").alias(c) for c in "xyz"]) for s in "abc"])).alias("corner", "p")
    rows = rows.select("mesh_id", (F.col("fid") * 2 + F.col("part") - 1).alias("fid"), corner).select("mesh_id", "fid", "corner", "p.x", "p.y", "p.z")
    return weld(rows, tolerance, 6 * faces.count())


def weld(rows: DataFrame, tolerance: float = 1e-6, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """corners (mesh_id, fid, corner, x, y, z and, if wanted, nx, ny, nz) -> (vertices, faces).

    Corners that round to the same multiple of the tolerance are one vertex at the place of the first;
    normals are summed and normalised. Ids are dense in order of first use; degenerate faces stay.
    ``size`` is about the number of corners, which are counted where it is not given. Many are dealt into parts of some ``storage.ROWS``.
    """
    parts = parts_of(rows.count() if size is None else size)
    group = ["mesh_id", "kx", "ky", "kz"]
    keys = [g.round_half_up(F.col(c).cast("double") / tolerance).alias(f"k{c}") for c in "xyz"]
    normal = [c for c in ("nx", "ny", "nz") if c in rows.columns]
    rows = rows.withColumn("seq", F.col("fid") * 3 + F.col("corner")).select("*", *keys)

    def firsts(rows: DataFrame, *by: str) -> DataFrame:
        # min_by keeps numbers alone, so that groups are hashed; the least struct would have all corners sorted
        return dealt(rows, parts, *by).groupBy(*by).agg(F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in "xyz"], *[F.sum(F.col(c).cast("double")).alias(c) for c in normal])

    points = rows.select(*group, F.expr(f"pmod(fid div {SPAN}, {PARTS})").alias("_chunk"), "seq", *"xyz", *normal)
    points = firsts(firsts(points, *group, "_chunk") if parts else points, *group)  # dealt whole, a point of very many corners would be told in one task
    unit = g.normalized(tuple(F.col(c) for c in normal)) if normal else ()
    points = stored(points.select("mesh_id", "seq", *"xyz", *[u.cast("float").alias(c) for u, c in zip(unit, normal, strict=True)]))
    points = numbered(points, "seq", "vid", parts_of(points.count()))
    ids = dealt(points.select("mesh_id", "vid", *keys), parts, *group)  # a vertex has the key of its first corner
    uses = dealt(rows.select(*group, "fid", "corner"), parts, *group).join(ids.hint("shuffle_hash") if parts else ids, group).select("mesh_id", "fid", "corner", "vid")
    faces = dealt(uses, parts, "mesh_id", "fid").groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("corner") == k, F.col("vid"))).alias(f"i{k}") for k in range(3)])
    return points.select("mesh_id", "vid", *"xyz", *normal), faces


def unit_scale(rows: DataFrame) -> DataFrame:
    """(mesh_id, scale): 0.001 for meshes whose bounding box has a diagonal above 5000, 1000 for one below 0.1, else 1."""
    box = rows.groupBy("mesh_id").agg(*[f(F.col(c).cast("double")).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    diagonal = F.sqrt(sum(((F.col(f"hi{c}") - F.col(f"lo{c}")) * (F.col(f"hi{c}") - F.col(f"lo{c}")) for c in "xyz"), F.lit(0.0)))
    return box.select("mesh_id", F.when(diagonal > 5000, 0.001).when(diagonal < 0.1, 1000.0).otherwise(1.0).alias("scale"))


def scaled(rows: DataFrame) -> DataFrame:
    """Coordinates in millimetres by the detected unit."""
    out = with_mesh(rows, unit_scale(rows))
    return out.select(*[(F.col(c).cast("double") * F.col("scale")).cast("float").alias(c) if c in "xyz" else F.col(c) for c in rows.columns])


def bounds(vertices: DataFrame) -> DataFrame:
    """Centroid and bounding box of each mesh."""
    return vertices.groupBy("mesh_id").agg(F.count("*").alias("n"), *[x for c in "xyz" for x in (F.avg(F.col(c).cast("double")).alias(f"c{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))])


def centred(vertices: DataFrame) -> DataFrame:
    """Coordinates less the middle of the bounding box, for display."""
    rows = with_mesh(vertices, bounds(vertices).select("mesh_id", *[((F.col(f"min_{c}").cast("double") + F.col(f"max_{c}")) / 2).alias(f"m{c}") for c in "xyz"]))
    return rows.select("mesh_id", "vid", *[(F.col(c).cast("double") - F.col(f"m{c}")).cast("float").alias(c) for c in "xyz"])


def hull(points: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull of plane points (n, 2), counter-clockwise from the least; points on its sides are none."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    if len(points) <= 3:
        return order

    def half(places) -> list[int]:
        out: list[int] = []
        for k in places:
            while len(out) >= 2:
                (ax, ay), (bx, by) = points[out[-1]] - points[out[-2]], points[k] - points[out[-2]]
                if ax * by - ay * bx > 0:
                    break
                out.pop()
            out.append(int(k))
        return out[:-1]

    return np.array(half(order) + half(order[::-1]), dtype=int)


def boundary_cap(faces: DataFrame, vertices: DataFrame, planes: DataFrame) -> DataFrame:
    """Triangles (mesh_id, part, ax .. cz) from a plane's point (qx .. qz, normal nx .. nz) to the convex hull of the boundary vertices projected on it.

    Each task hands on the hull of its own points, so a mesh's last step holds corners of hulls only.
    """
    n = g.normalized((F.col("nx"), F.col("ny"), F.col("nz")))
    rows = planes.select("mesh_id", "qx", "qy", "qz", *[x.alias(f"n{c}") for x, c in zip(n, "xyz", strict=True)])
    n = tuple(F.col(f"n{c}") for c in "xyz")
    first = F.abs("nx") < 0.9
    u = g.normalized(g.cross(n, (F.when(first, 1.0).otherwise(0.0), F.when(first, 0.0).otherwise(1.0), F.lit(0.0))))
    rows = rows.select("*", *[x.alias(f"u{c}") for x, c in zip(u, "xyz", strict=True)])
    rows = rows.select("*", *[x.alias(f"v{c}") for x, c in zip(g.cross(n, tuple(F.col(f"u{c}") for c in "xyz")), "xyz", strict=True)])
    rim = with_mesh(boundary_vertices(faces).join(vertices.select("mesh_id", "vid", *[F.col(c).cast("double").alias(c) for c in "xyz"]), ["mesh_id", "vid"]), rows)
    d = g.sub(g.point(), tuple(F.col(f"q{c}") for c in "xyz"))
    off = g.dot(d, n)
    flat = rim.select("mesh_id", "qx", "qy", "qz", *[(F.col(c) - off * F.col(f"n{c}")).alias(c) for c in "xyz"], g.dot(d, tuple(F.col(f"u{c}") for c in "xyz")).alias("u"), g.dot(d, tuple(F.col(f"v{c}") for c in "xyz")).alias("v"))

    def some(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, rows in part.groupby("mesh_id"):
                yield rows.iloc[hull(rows[["u", "v"]].to_numpy())]

    def fan(key, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["mesh_id", "part", *[f"{s}{c}" for s in "abc" for c in "xyz"]]
        rows = rows.iloc[hull(rows[["u", "v"]].to_numpy())]
        if len(rows) < 3:
            return pd.DataFrame([], columns=names)
        rows = rows.iloc[np.argsort(np.arctan2(rows["v"].to_numpy(), rows["u"].to_numpy()), kind="stable")]
        p, q = rows[["x", "y", "z"]].to_numpy(), rows[["qx", "qy", "qz"]].to_numpy()
        return pd.DataFrame([(key[0], k, *map(float, q[0]), *map(float, p[k]), *map(float, p[(k + 1) % len(p)])) for k in range(len(p))], columns=names)

    corners_ = flat.mapInPandas(some, flat.schema)
    return corners_.groupBy("mesh_id").applyInPandas(fan, "mesh_id string, part int, " + ", ".join(f"{s}{c} double" for s in "abc" for c in "xyz"))
