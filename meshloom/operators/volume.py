"""Volumes, wear vectors and planes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.functions import geometry as g
from meshloom.operators import fit, topology
from meshloom.operators.select import order_statistics
from meshloom.operators.storage import stored, with_mesh

DENSITY = 0.935


def _cols(prefix: str) -> g.Vec:
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")  # type: ignore[return-value]


def defect_volumes(faces: DataFrame, deviations: DataFrame, sphere: DataFrame, threshold: float = 1.0, density: float = DENSITY) -> DataFrame:
    """Volume between the surface and the sphere over faces whose mean deviation is beyond the threshold, and its mass.

    deviations: vertices with x, y, z, deviation. A prism of face and projection is three tetrahedra.
    """
    rows = with_mesh(topology.gather(faces, deviations, ("x", "y", "z", "deviation")), sphere.select("mesh_id", "cx", "cy", "cz", "radius"))
    p = topology.corner_points()
    s = [g.project_onto_sphere(q, fit.center(), F.col("radius")) for q in p]
    mean = (F.col("deviation0") + F.col("deviation1") + F.col("deviation2")) / 3
    size = F.abs(g.tetra_volume(p[0], p[1], p[2], s[0]) + g.tetra_volume(s[0], p[1], p[2], s[1]) + g.tetra_volume(s[0], s[1], p[2], s[2]))
    part = lambda c: F.coalesce(F.sum(F.when(c & (F.abs(mean) > threshold), size)), F.lit(0.0))
    out = rows.groupBy("mesh_id").agg(part(mean > 0).alias("bump_volume"), part(mean <= 0).alias("dip_volume"))
    return out.select("*", (F.col("bump_volume") + F.col("dip_volume")).alias("total_volume"), (F.col("bump_volume") * density).alias("bump_mass"), (F.col("dip_volume") * density).alias("dip_mass"))


def enclosed_volume(faces: DataFrame, vertices: DataFrame, plane: DataFrame) -> DataFrame:
    """Volume between the surface and a plane (mesh_id, qx .. qz, nx .. nz) over faces that lie wholly on the normal's side."""
    rows = with_mesh(topology.gather(faces, vertices), plane.select("mesh_id", "qx", "qy", "qz", "nx", "ny", "nz"))
    a, b, c = topology.corner_points()
    n = g.normalized(_cols("n"))
    h = [g.plane_distance(p, _cols("q"), n) for p in (a, b, c)]
    area = 0.5 * g.dot(g.cross(g.sub(b, a), g.sub(c, a)), n)
    return rows.filter((h[0] >= 0) & (h[1] >= 0) & (h[2] >= 0)).groupBy("mesh_id").agg(F.abs(F.sum((h[0] + h[1] + h[2]) / 3.0 * area)).alias("enclosed_volume"))


def enclosed_volume_clipped(faces: DataFrame, vertices: DataFrame, origin: tuple[float, float, float], normal: tuple[float, float, float]) -> DataFrame:
    """As ``enclosed_volume`` for one plane, with faces that straddle it cut instead of left out."""
    k = math.sqrt(sum(x * x for x in normal))
    o, n = g.literal(origin), g.literal([x / k for x in normal])
    rows = topology.clip(faces, vertices, o, n)
    a, b, c = (tuple(F.col(f"{s}{k}") for k in "xyz") for s in "abc")
    h = (g.plane_distance(a, o, n) + g.plane_distance(b, o, n) + g.plane_distance(c, o, n)) / 3.0
    return rows.groupBy("mesh_id").agg(F.abs(F.sum(h * 0.5 * g.dot(g.cross(g.sub(b, a), g.sub(c, a)), n))).alias("enclosed_volume"))


def wear_volume(enclosed: DataFrame, sphere: DataFrame, plane: DataFrame) -> DataFrame:
    """Enclosed volume less the commercial sphere's cap over the same plane, not below zero."""
    rows = with_mesh(with_mesh(enclosed, sphere.select("mesh_id", "cx", "cy", "cz", "radius")), plane.select("mesh_id", "qx", "qy", "qz", "nx", "ny", "nz"))
    cap = g.cap_volume(fit.center(), F.col("radius"), _cols("q"), _cols("n"))
    return rows.select("mesh_id", "enclosed_volume", cap.alias("cap_volume"), F.greatest(F.lit(0.0), F.col("enclosed_volume") - cap).alias("wear_volume"))


def wear_vector(points: DataFrame, frame: DataFrame) -> DataFrame:
    """Deepest of the 70 % of bump points nearest the pole: its place, deviation, distance from the pole and angle to the axis.

    points: mesh_id, seq, x, y, z, dev. Of points as near as the last of the 70 %, those of least seq are among them.
    """
    rows = with_mesh(points, frame.select("mesh_id", "px", "py", "pz", "ax", "ay", "az"))
    rows = stored(rows.withColumn("d", g.distance(g.point(), _cols("p"))))
    most = F.greatest(F.lit(1), F.ceil(F.col("total") * 0.7))
    limit = order_statistics(rows, "d", {"limit": most - 1})
    counts = with_mesh(rows, limit).groupBy("mesh_id", "limit").agg(F.count("*").alias("total"), F.count_if(F.col("d") < F.col("limit")).alias("before"))
    near = with_mesh(rows, counts.select("mesh_id", "limit", (most - F.col("before")).alias("ties"))).filter(F.col("d") <= F.col("limit"))
    # the window runs over points of one distance
    tie = F.row_number().over(W.partitionBy("mesh_id", "d").orderBy("seq"))
    near = near.filter(F.col("d") < F.col("limit")).drop("limit", "ties").unionByName(near.filter(F.col("d") == F.col("limit")).withColumn("_tie", tie).filter(F.col("_tie") <= F.col("ties")).drop("limit", "ties", "_tie"))
    best = near.groupBy("mesh_id").agg(F.max(F.struct(F.col("dev"), (-F.col("d")).alias("nd"), (-F.col("seq")).alias("o"), "d", *[F.col(c).cast("double").alias(c) for c in "xyz"], "px", "py", "pz", "ax", "ay", "az")).alias("m")).select("mesh_id", "m.*")
    direction = g.normalized(g.sub(g.point(), _cols("p")))
    return best.select("mesh_id", "x", "y", "z", F.col("dev").alias("max_depth"), F.col("d").alias("distance"), F.degrees(F.acos(g.clamp(g.dot(direction, _cols("a")), -1.0, 1.0))).alias("angle"))


def wear_plane(classified: DataFrame, frame: DataFrame) -> DataFrame:
    """Vertex of greatest depth on the pole's side, and the normal of the plane through it and the pole, across the rim plane; no such vertex: no row.

    ``anchor``: the middle of the pole and the rim point projected onto the plane.
    """
    best = classified.filter("active").groupBy("mesh_id").agg(F.max(F.struct(F.col("deviation"), (-F.col("vid")).alias("v"), *[F.col(c).cast("double").alias(c) for c in "xyz"])).alias("m"))
    rows = with_mesh(best.select("mesh_id", (-F.col("m.v")).alias("vid"), F.col("m.deviation").alias("max_depth"), "m.x", "m.y", "m.z"), frame.select("mesh_id", "px", "py", "pz", "qx", "qy", "qz", "nx", "ny", "nz"))
    normal = g.normalized(g.cross(g.normalized(g.sub(g.point(), _cols("p"))), _cols("n")))
    rows = rows.select("mesh_id", "vid", "max_depth", "x", "y", "z", *[_c for _c in ("px", "py", "pz", "qx", "qy", "qz")], *[e.alias(f"w{c}") for e, c in zip(normal, "xyz", strict=True)])
    off = g.plane_distance(_cols("q"), _cols("p"), _cols("w"))
    return rows.select("mesh_id", "vid", "max_depth", "x", "y", "z", "wx", "wy", "wz", *[((F.col(f"p{c}") + F.col(f"q{c}") - off * F.col(f"w{c}")) / 2).alias(f"anchor_{c}") for c in "xyz"])


def _worn(faces: DataFrame, vertices: DataFrame, sphere: DataFrame) -> DataFrame:
    """Faces with their corners, the sphere, thickness and share: those whose mean distance beyond the sphere is positive."""
    rows = with_mesh(topology.gather(faces, vertices), sphere.select("mesh_id", "cx", "cy", "cz", "radius"))
    thickness = sum((g.distance(p, fit.center()) - F.col("radius") for p in topology.corner_points()), F.lit(0.0)) / 3
    rows = rows.withColumn("thickness", thickness).filter("thickness > 0")
    ends = rows.groupBy("mesh_id").agg(F.min("thickness").alias("lo"), F.max("thickness").alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("thickness") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return with_mesh(rows, ends).withColumn("share", share).drop("lo", "hi")


def wear_solid(faces: DataFrame, vertices: DataFrame, sphere: DataFrame) -> DataFrame:
    """(mesh_id, fid, thickness, share): faces whose mean distance beyond the sphere is positive; share runs from the least to the greatest thickness."""
    return _worn(faces, vertices, sphere).select("mesh_id", "fid", "thickness", "share")


def wear_prisms(faces: DataFrame, vertices: DataFrame, sphere: DataFrame) -> DataFrame:
    """Triangles (mesh_id, fid, part, ax .. cz, red, green, blue) of a closed prism for each worn face: the face, its projection onto the sphere, and three sides of two."""
    rows = _worn(faces, vertices, sphere)
    p = list(topology.corner_points())
    p += [g.project_onto_sphere(q, fit.center(), F.col("radius")) for q in p]
    point = [F.struct(*[c.alias(n) for c, n in zip(q, "xyz", strict=True)]) for q in p]
    # corners 0 to 2 are the face's, 3 to 5 their projections
    parts = [(0, 1, 2), (3, 5, 4)] + [t for k in range(3) for t in ((k, (k + 1) % 3, (k + 1) % 3 + 3), (k, (k + 1) % 3 + 3, k + 3))]
    made = F.posexplode(F.array(*[F.struct(*[point[i].alias(s) for s, i in zip("abc", t, strict=True)]) for t in parts])).alias("part", "t")
    rows = rows.select("mesh_id", "fid", "share", made)
    return rows.select("mesh_id", "fid", "part", *[F.col(f"t.{s}.{c}").alias(f"{s}{c}") for s in "abc" for c in "xyz"], F.lit(1.0).alias("red"), (1 - F.col("share")).alias("green"), F.lit(0.0).alias("blue"))


def wear_mesh(faces: DataFrame, vertices: DataFrame, sphere: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The worn solid as one closed mesh: (vertices, faces with share).

    Vertex v of the surface is 2 v, its projection onto the sphere 2 v + 1. Walls stand only along edges that worn faces do not use as often in
    one direction as in the other, so that walls which two prisms would share are left out, and every edge runs both ways equally often.
    """
    rows = stored(_worn(faces, vertices, sphere))
    used = with_mesh(topology.used_vertices(vertices.select("mesh_id", "vid", *[F.col(c).cast("double").alias(c) for c in "xyz"]), rows), sphere.select("mesh_id", "cx", "cy", "cz", "radius"))
    below = g.project_onto_sphere(g.point(), fit.center(), F.col("radius"))
    both = F.explode(F.array(F.struct((F.col("vid") * 2).alias("vid"), "x", "y", "z"), F.struct((F.col("vid") * 2 + 1).alias("vid"), *[c.alias(n) for c, n in zip(below, "xyz", strict=True)])))
    points = used.select("mesh_id", both.alias("p")).select("mesh_id", "p.*")
    i = [F.col(f"i{k}") * 2 for k in range(3)]
    triangle = lambda fid, a, b, c: F.struct(fid.alias("fid"), a.alias("i0"), b.alias("i1"), c.alias("i2"))
    caps = rows.select("mesh_id", "share", F.explode(F.array(triangle(F.col("fid") * 8, *i), triangle(F.col("fid") * 8 + 1, i[0] + 1, i[2] + 1, i[1] + 1))).alias("t"))
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"i{k}").alias("a"), F.col(f"i{(k + 1) % 3}").alias("b")) for k in range(3)]))
    sides = rows.select("mesh_id", "fid", "share", sides.alias("s")).select("mesh_id", "fid", "share", "s.*").filter("a <> b")
    use = F.struct("fid", "k", "a", "b", "share")
    edges = sides.groupBy("mesh_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.array_sort(F.collect_list(use)).alias("uses"))
    up, down = (F.filter("uses", lambda u: u.a < u.b), F.filter("uses", lambda u: u.a > u.b))
    # the first uses of the direction that has more, as many as it has more
    open_ = edges.select("mesh_id", F.explode(F.when(F.size(up) >= F.size(down), F.slice(up, 1, F.size(up) - F.size(down))).otherwise(F.slice(down, 1, F.size(down) - F.size(up)))).alias("u")).select("mesh_id", "u.*")
    a, b, at = F.col("a") * 2, F.col("b") * 2, F.col("fid") * 8 + F.col("k") * 2
    walls = open_.select("mesh_id", "share", F.explode(F.array(triangle(at + 2, b, a, a + 1), triangle(at + 3, b, a + 1, b + 1))).alias("t"))
    return points, caps.unionByName(walls).select("mesh_id", "t.*", "share")


def cap_tessellation(spark: SparkSession, spheres: DataFrame, rings: int = 32, segments: int = 64) -> DataFrame:
    """Grid points of each sphere's cap beyond a plane (cx .. radius, qx .. nz), ring by ring from the top to the plane; no rows without a cap."""
    rows = spheres.withColumn("d", g.plane_distance(fit.center(), _cols("q"), g.normalized(_cols("n")))).filter("radius + d > 0")
    theta_end = F.acos(g.clamp(-F.col("d") / F.col("radius"), -1.0, 1.0))
    rows = rows.select("*", theta_end.alias("end"), F.explode(F.sequence(F.lit(0), F.lit(rings))).alias("ring")).select("*", F.explode(F.sequence(F.lit(0), F.lit(segments))).alias("segment"))
    u, v, w = g.local_frame(g.normalized(_cols("n")))
    theta, phi = F.col("end") * F.col("ring") / rings, 2 * F.pi() * F.col("segment") / segments
    way = g.add(g.scale(w, F.cos(theta)), g.scale(g.add(g.scale(u, F.cos(phi)), g.scale(v, F.sin(phi))), F.sin(theta)))
    return rows.select("mesh_id", "ring", "segment", *[(c + x * F.col("radius")).alias(k) for c, x, k in zip(fit.center(), way, "xyz", strict=True)])
