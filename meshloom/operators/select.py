"""Choosing faces and vertices: inner surface, rim trim, worn zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.functions import geometry as g
from meshloom.operators import fit, topology
from meshloom.operators.graph import shortest_paths
from meshloom.operators.storage import stored, with_mesh

#: Parts that an interval of values is split into, and rows in one up to which they are sorted.
BUCKETS, SORTED = 4096, 100_000


def _within(values: DataFrame, wants: DataFrame) -> DataFrame:
    """(mesh_id, before, lo, hi, v): a row for each value and each interval of wants that holds it; places in one interval share its rows."""
    lists = wants.groupBy("mesh_id").agg(F.collect_set(F.struct("before", "lo", "hi")).alias("parts"))
    held = F.filter("parts", lambda w: (F.col("v") >= w.lo) & (F.col("v") <= w.hi))
    return with_mesh(values, lists).select("mesh_id", "v", F.explode(held).alias("w")).select("mesh_id", "v", "w.*")


def order_statistics(rows: DataFrame, value: str, shares: dict[str, float | Column], most: int = SORTED) -> DataFrame:
    """(mesh_id, one column for each share q): the value at place floor(n * q) in ascending order, without interpolation; nulls do not count.

    A place may also be given as a column of the mesh's ``total``. The interval that holds a place is split into 4,096 parts and the part
    with the place is the next interval, until it has ``most`` rows at most or one value: only these are sorted, and no values are shuffled before.
    An interval that begins or ends at an infinity or NaN (the greatest of all) is sorted as it is.
    """
    values = stored(rows.select("mesh_id", F.col(value).alias("v")).filter("v IS NOT NULL"))
    box = values.groupBy("mesh_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    places = F.array(*[F.struct(F.lit(k).alias("name"), (q if isinstance(q, Column) else F.floor(F.col("total") * q)).cast("long").alias("at")) for k, q in shares.items()])
    wants = stored(box.select("mesh_id", "lo", "hi", F.col("total").alias("b"), F.lit(0).cast("long").alias("before"), F.explode(places).alias("w")).select("mesh_id", "w.*", "before", "lo", "hi", "b"))
    keys = ["mesh_id", "before"]  # an interval is told by the number of values before it
    by_part = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # 4,096 rows at most
    # halves, as the width itself may be beyond the greatest double
    width = F.col("hi") / 2 - F.col("lo") / 2
    splits = (width > 0) & (width < float("inf"))
    part = F.when(splits, F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * BUCKETS))).otherwise(0).cast("long")
    while wants.filter((F.col("b") > most) & splits).limit(1).count():
        parts = _within(values, wants).groupBy(*keys, part.alias("part")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("b"))
        parts = parts.withColumn("first", F.col("before") + F.coalesce(F.sum("b").over(by_part), F.lit(0)))
        hit = parts.join(wants.select(*keys, "name", "at"), keys).filter((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("b")))
        wants = stored(hit.select("mesh_id", "name", "at", F.col("first").alias("before"), "lo", "hi", "b"))
    counts = _within(values, wants).groupBy(*keys, "v").agg(F.count("*").alias("n"))
    up_to = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("end", F.col("before") + F.sum("n").over(up_to)).join(wants.select(*keys, "name", "at"), keys)
    found = counts.filter("end > at").groupBy("mesh_id", "name").agg(F.min("v").alias("v"))
    return found.groupBy("mesh_id").agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in shares])


def face_facing(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with facing (normal times direction to the vertices' mean) and distance of their centroid to that mean."""
    mean = vertices.groupBy("mesh_id").agg(*[F.avg(F.col(c).cast("double")).alias(f"m{c}") for c in "xyz"])
    rows = with_mesh(topology.gather(faces, vertices), mean)
    a, b, c = topology.corner_points()
    middle = tuple((p + q + r) / 3 for p, q, r in zip(a, b, c, strict=True))
    to = g.sub(tuple(F.col(f"m{k}") for k in "xyz"), middle)
    n = g.length(to)
    far = F.when(n == 0, 1.0).otherwise(n)
    return rows.select("mesh_id", "fid", "i0", "i1", "i2", (g.dot(g.face_normal(a, b, c), to) / far).alias("facing"), far.alias("distance"))


def inner_candidates(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces whose normals face the middle and that are no farther than the third quartile; if there are none, all that face it."""
    rows = stored(face_facing(faces, vertices))
    limits = order_statistics(rows, "distance", {"q1": 0.25, "q3": 0.75})
    limit = F.when(F.col("q3") > 0, F.col("q3")).when(F.col("q1") > 0, F.col("q1")).otherwise(float("inf"))
    near = with_mesh(rows, limits.select("mesh_id", limit.alias("limit"))).withColumn("near", (F.col("facing") > 0.5) & (F.col("distance") <= F.col("limit")))
    some = near.groupBy("mesh_id").agg(F.max("near").alias("any"))
    return with_mesh(near, some).filter(F.when(F.col("any"), F.col("near")).otherwise(F.col("facing") > 0)).select("mesh_id", "fid", "i0", "i1", "i2")


def separate(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with surface 'inner' or 'outer': the largest component of the candidates, swapped if it lies farther out than the rest."""
    largest = topology.face_components(inner_candidates(faces, vertices)).filter("is_largest").select("mesh_id", "fid", F.lit(True).alias("inner"))
    rows = stored(faces.join(largest, ["mesh_id", "fid"], "left").withColumn("inner", F.coalesce("inner", F.lit(False))))
    mean = vertices.groupBy("mesh_id").agg(*[F.avg(F.col(c).cast("double")).alias(f"m{c}") for c in "xyz"])
    used = rows.select("mesh_id", "inner", F.explode(F.array("i0", "i1", "i2")).alias("vid")).distinct()
    far = with_mesh(used.join(vertices, ["mesh_id", "vid"]), mean).withColumn("d", g.distance(g.point(), tuple(F.col(f"m{k}") for k in "xyz")))
    swap = far.groupBy("mesh_id").agg((F.coalesce(F.avg(F.when(F.col("inner"), F.col("d"))), F.lit(0.0)) > F.coalesce(F.avg(F.when(~F.col("inner"), F.col("d"))), F.lit(0.0))).alias("swap"))
    return with_mesh(rows, swap).select("mesh_id", "fid", "i0", "i1", "i2", F.when(F.col("inner") != F.col("swap"), "inner").otherwise("outer").alias("surface"))


def rim_distances(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, vid, dist): length of the shortest edge path from the rim loop; vertices it cannot reach have none."""
    edges = topology.adjacency(faces, vertices)
    rim = topology.boundary_loops(faces).filter("is_rim").select("mesh_id", "vid")
    return shortest_paths(stored(edges), stored(rim), predecessors=False)


def trim(faces: DataFrame, vertices: DataFrame, percent: float = 6.0) -> DataFrame:
    """Faces with kept: all corners farther from the rim than percent of the greatest distance; unreachable corners count as far."""
    dist = stored(rim_distances(faces, vertices))
    most = dist.groupBy("mesh_id").agg(F.max("dist").alias("most"))
    each = topology.corners(faces).join(dist, ["mesh_id", "vid"], "left")
    each = with_mesh(each, most, "left")
    far = F.coalesce(F.col("dist") > percent / 100.0 * F.col("most"), F.lit(True))
    kept = each.groupBy("mesh_id", "fid").agg(F.min(far).alias("kept"))
    return faces.join(kept, ["mesh_id", "fid"])


def height_range(vertices: DataFrame, axis: DataFrame) -> DataFrame:
    """Least and greatest height along the axis (mesh_id, ax, ay, az), from the vertices' mean."""
    mean = vertices.groupBy("mesh_id").agg(*[F.avg(F.col(c).cast("double")).alias(f"m{c}") for c in "xyz"])
    h = g.dot(g.sub(g.point(), tuple(F.col(f"m{k}") for k in "xyz")), (F.col("ax"), F.col("ay"), F.col("az")))
    return with_mesh(with_mesh(vertices, mean), axis).groupBy("mesh_id").agg(F.min(h).alias("min_height"), F.max(h).alias("max_height"))


def rim_frame(inner_faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Centroid and normal of the plane through all boundary vertices: rx, ry, rz, nx, ny, nz."""
    rim = vertices.select("mesh_id", "vid", "x", "y", "z").join(topology.boundary_vertices(inner_faces), ["mesh_id", "vid"], "left_semi")
    n = F.col("eigenvectors")[0]
    return stored(fit.principal(stored(rim)).select("mesh_id", F.col("mx").alias("rx"), F.col("my").alias("ry"), F.col("mz").alias("rz"), *[n[i].alias(f"n{c}") for i, c in enumerate("xyz")]))


def _cols(prefix: str) -> g.Vec:
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")  # type: ignore[return-value]


def pole(vertices: DataFrame, rim: DataFrame) -> DataFrame:
    """rim with the pole (pole_vid, px, py, pz: the vertex farthest from the rim plane on the side of most of the mesh, the first of equal ones), its depth, and the axis ax, ay, az."""
    rows = with_mesh(vertices.select("mesh_id", "vid", "x", "y", "z"), rim)
    d = g.plane_distance(g.point(), _cols("r"), _cols("n"))
    side = rows.groupBy("mesh_id").agg(F.when(F.sum(d) >= 0, 1.0).otherwise(-1.0).alias("side"))
    rows = with_mesh(rows, side)
    best = rows.groupBy("mesh_id").agg(F.max(F.struct((d * F.col("side")).alias("depth"), (-F.col("vid")).alias("v"), *[F.col(c).cast("double").alias(f"p{c}") for c in "xyz"])).alias("m"))
    out = with_mesh(rim, best.select("mesh_id", (-F.col("m.v")).alias("pole_vid"), "m.depth", "m.px", "m.py", "m.pz"))
    axis = g.sub(_cols("p"), _cols("r"))
    n = g.length(axis)
    return out.select("*", *[F.when(n > 1e-12, a / n).otherwise(e).alias(f"a{c}") for a, e, c in zip(axis, (0.0, 1.0, 0.0), "xyz", strict=True)])


def rim_plane(frame: DataFrame, percent: float = 6.0) -> DataFrame:
    """The rim plane moved toward the pole by percent of the pole's depth: qx, qy, qz, and the normal toward the pole as nx, ny, nz."""
    depth = g.dot(g.sub(_cols("p"), _cols("r")), _cols("n"))
    sign = F.when(depth < 0, -1.0).otherwise(1.0)
    shift = percent / 100.0 * F.abs(depth)
    normal = [(F.col(f"n{c}") * sign) for c in "xyz"]
    return frame.select(*[c for c in frame.columns if c not in ("nx", "ny", "nz")], *[(F.col(f"r{c}") + n * shift).alias(f"q{c}") for n, c in zip(normal, "xyz", strict=True)], *[n.alias(f"n{c}") for n, c in zip(normal, "xyz", strict=True)])


def classify(vertices: DataFrame, sphere: DataFrame, plane: DataFrame | None = None, factor: float = 1.02) -> DataFrame:
    """vertices with active, distance, deviation (micrometres) and worn. sphere: mesh_id, cx, cy, cz, radius (the commercial one)."""
    rows = with_mesh(vertices.select("mesh_id", "vid", "x", "y", "z"), sphere.select("mesh_id", "cx", "cy", "cz", "radius"))
    active = F.lit(True)
    if plane is not None:
        rows = with_mesh(rows, plane.select("mesh_id", "qx", "qy", "qz", "nx", "ny", "nz"))
        active = g.plane_distance(g.point(), _cols("q"), _cols("n")) >= 0
    d = g.distance(g.point(), fit.center())
    return rows.select("mesh_id", "vid", "x", "y", "z", active.alias("active"), F.when(active, d).otherwise(F.col("radius")).alias("distance"),
                       F.when(active, (d - F.col("radius")) * 1000).otherwise(0.0).alias("deviation"), (active & (d > F.col("radius") * factor)).alias("worn"))


def wear_summary(classified: DataFrame) -> DataFrame:
    """Worn and unworn vertices and the share of worn ones among active ones, in percent."""
    return classified.groupBy("mesh_id").agg(F.count_if("worn").alias("worn"), (F.count_if("active") - F.count_if("worn")).alias("unworn"), (F.count_if("worn") / F.greatest(F.count_if("active"), F.lit(1)) * 100).alias("worn_percent"))


def strided_extremes(vertices: DataFrame, value: str, most: int = 50_000) -> DataFrame:
    """Vertices with the greatest and the least value among every stride-th vertex, for labels; the first of equal ones."""
    n = vertices.groupBy("mesh_id").agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") / most)).alias("stride"))
    rows = with_mesh(vertices, n).filter("vid % stride = 0")
    return rows.groupBy("mesh_id").agg(F.max_by(F.col("vid"), F.struct(F.col(value), -F.col("vid"))).alias("max_vid"), F.max(value).alias("max_value"), F.min_by(F.col("vid"), F.struct(value, "vid")).alias("min_vid"), F.min(value).alias("min_value"))
