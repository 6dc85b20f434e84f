"""Meridian profiles: sections of a surface by half planes through its axis, as ordered series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.functions import geometry as g
from meshloom.operators import topology
from meshloom.operators.storage import stored, with_mesh

COUNT = 360
MARGIN = math.pi / 36
MOST_POINTS = 500
#: Faces in a task that cuts them by all planes of their mesh.
PART = 50_000
PARTS = ("x", "y", "z", "lat", "pu", "pv")


def _cols(prefix: str) -> g.Vec:
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")  # type: ignore[return-value]


def _framed(frame: DataFrame) -> DataFrame:
    """frame with the local axes u and v as columns: one row for each mesh, so the rows of a mesh carry plain numbers."""
    u, v, _ = g.local_frame(_cols("a"))
    return frame.select("mesh_id", *[f"{k}{c}" for k in "ra" for c in "xyz"], *[x.alias(f"{k}{c}") for k, vec in (("u", u), ("v", v)) for x, c in zip(vec, "xyz", strict=True)])


def angles(vertices: DataFrame, frame: DataFrame) -> DataFrame:
    """vertices with lon (about the axis through the rim's centroid) and lat (height along it). frame: mesh_id, rx .. rz, ax .. az, px .. pz."""
    rows = with_mesh(vertices, _framed(frame))
    return rows.select(*vertices.columns, g.longitude(g.point(), _cols("r"), _cols("u"), _cols("v")).alias("lon"), g.plane_distance(g.point(), _cols("r"), _cols("a")).alias("lat"))


def _placed(vertices: DataFrame, frame: DataFrame) -> DataFrame:
    """vertices with lon, lat, their parts pu and pv along u and v, and near: close to the pole."""
    top = g.dot(g.sub(_cols("p"), _cols("r")), _cols("a")) * 0.85
    rows = with_mesh(vertices.select("mesh_id", "vid", "x", "y", "z"), with_mesh(_framed(frame), frame.select("mesh_id", "px", "py", "pz")).withColumn("top", top).drop("px", "py", "pz"))
    d, lat = g.sub(g.point(), _cols("r")), g.plane_distance(g.point(), _cols("r"), _cols("a"))
    return rows.select("mesh_id", "vid", *[F.col(c).cast("double").alias(c) for c in "xyz"], g.longitude(g.point(), _cols("r"), _cols("u"), _cols("v")).alias("lon"), lat.alias("lat"), g.dot(d, _cols("u")).alias("pu"), g.dot(d, _cols("v")).alias("pv"), (lat > F.col("top")).alias("near"))


def faces_of_meridians(faces: DataFrame, vertices: DataFrame, frame: DataFrame, count: int = COUNT) -> DataFrame:
    """A row for each face and meridian whose plane meets it: geo_id, the corners' x, y, z, lat, pu, pv and signed distances s0, s1, s2 from that plane.

    A range join without a join: the longitudes that a face spans, and five degrees on both sides, become a sequence of
    meridian numbers. Faces at the pole that have a corner on the axis or lie about it, whose longitudes tell little, are
    tried on every meridian. Numbers whose plane leaves all corners on one side are dropped before the rows are made.
    """
    rows = topology.gather(faces, _placed(vertices, frame), ("x", "y", "z", "lon", "lat", "pu", "pv", "near"))
    # a face is tried on up to all meridians, which its few bytes do not tell: dealt to all tasks, not gathered in few by size
    rows = rows.repartition(int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mesh_id", "fid")
    lons = [F.col(f"lon{k}") for k in range(3)]
    middle = F.atan2(sum((F.sin(x) for x in lons), F.lit(0.0)), sum((F.cos(x) for x in lons), F.lit(0.0)))
    rows = rows.withColumn("_m", F.when(middle < 0, middle + 2 * F.pi()).otherwise(middle))
    apart = lambda x: F.when(F.abs(x - F.col("_m")) > F.pi(), 2 * F.pi() - F.abs(x - F.col("_m"))).otherwise(F.abs(x - F.col("_m")))
    rows = rows.withColumn("_reach", F.greatest(*[apart(x) for x in lons]) + MARGIN)
    step = 2 * math.pi / count
    lo, hi = F.ceil((F.col("_m") - F.col("_reach")) / step), F.floor((F.col("_m") + F.col("_reach")) / step)
    every = F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))
    # corners off the axis and within a quarter turn of the middle bound the face's longitudes, at the pole too
    axial = F.least(*[F.col(f"pu{k}") * F.col(f"pu{k}") + F.col(f"pv{k}") * F.col(f"pv{k}") for k in range(3)]) <= 1e-12
    wide = (F.col("near0") | F.col("near1") | F.col("near2")) & (axial | (F.col("_reach") - MARGIN >= math.pi / 2))
    ids = F.when(wide | (hi - lo >= count - 1), every).when(hi >= lo, F.transform(F.sequence(lo, hi), lambda k: F.pmod(k, F.lit(count).cast("long")))).otherwise(F.array().cast("array<bigint>"))

    def sides(k):
        theta = k * (2 * math.pi / count)
        return F.struct(k.alias("geo_id"), F.sin(theta).alias("sin"), F.cos(theta).alias("cos"))

    def cut(e):
        return F.struct(e.geo_id.alias("geo_id"), *[(F.col(f"pu{i}") * e["sin"] - F.col(f"pv{i}") * e["cos"]).alias(f"s{i}") for i in range(3)])

    tried = F.transform(F.transform(ids, sides), cut)
    met = F.filter(tried, lambda e: (F.least(e.s0, e.s1, e.s2) <= 1e-10) & (F.greatest(e.s0, e.s1, e.s2) >= -1e-10))
    rows = rows.select("mesh_id", "fid", *[f"{c}{k}" for k in range(3) for c in PARTS], F.explode(met).alias("_e"))
    return rows.select("mesh_id", "fid", *[f"{c}{k}" for k in range(3) for c in PARTS], "_e.*")


def _crossings(sides: list[Column]) -> Column:
    """Points (PARTS) where the sides of a triangle cross a plane, in the order of the sides; a corner on it counts once."""
    out = []
    for i in range(3):
        j = (i + 1) % 3
        t = sides[i] / (sides[i] - sides[j])
        cut = F.struct(*[(F.col(f"{c}{i}") + t * (F.col(f"{c}{j}") - F.col(f"{c}{i}"))).alias(c) for c in PARTS])
        corner = F.struct(*[F.col(f"{c}{i}").alias(c) for c in PARTS])
        out.append(F.when(sides[i] * sides[j] < 0, cut).when(F.abs(sides[i]) < 1e-10, corner))
    return F.filter(F.array(*out), lambda p: p.isNotNull())


def segments(faces: DataFrame, vertices: DataFrame, frame: DataFrame, count: int = COUNT) -> DataFrame:
    """(mesh_id, geo_id, fid, x0 .. lat0, x1 .. lat1): the two points where each face is cut on the meridian's own side of the axis."""
    rows = faces_of_meridians(faces, vertices, frame, count)
    # exploded, so that the tests below read the points: filters are pushed through a mere projection and would make them again for each use
    cut = rows.select("mesh_id", "geo_id", "fid", F.explode(F.array(_crossings([F.col(f"s{k}") for k in range(3)]))).alias("cut"))
    a, b = F.get("cut", F.lit(0)), F.get("cut", F.lit(1))
    lon = F.atan2((a["pv"] + b["pv"]) / 2, (a["pu"] + b["pu"]) / 2)
    cut = cut.filter(F.size("cut") >= 2).withColumn("off", F.abs(F.when(lon < 0, lon + 2 * F.pi()).otherwise(lon) - F.col("geo_id") * (2 * math.pi / count)))
    own = F.when(F.col("off") > F.pi(), 2 * F.pi() - F.col("off")).otherwise(F.col("off")) < math.pi / 2
    return cut.filter(own).select("mesh_id", "geo_id", "fid", *[e[c].alias(f"{c}{k}") for k, e in ((0, a), (1, b)) for c in ("x", "y", "z", "lat")])


def _kept(xyz: np.ndarray, eps: float) -> np.ndarray:
    """Which of the points (n, 3) in order are farther than eps from the last one kept; the first is kept.

    A point farther than twice eps from the one before it is kept, so only points nearer than that are told one after the other, if there are more than two.
    """
    d = np.diff(xyz, axis=0)
    gap = (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) if len(xyz) else np.zeros(0)
    kept = np.concatenate([[True] * min(len(xyz), 1), gap > eps * eps])
    begins = np.flatnonzero(np.concatenate([[True] * min(len(xyz), 1), gap > 4 * eps * eps]))
    sizes = np.diff(np.append(begins, len(xyz)))
    for at, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        run = xyz[at : at + n].tolist()
        last = run[0]
        for k, p in enumerate(run[1:], at + 1):
            kept[k] = sum(((a - b) * (a - b) for a, b in zip(last, p, strict=True)), 0.0) > eps * eps
            last = p if kept[k] else last
    return kept


def polylines(cuts: DataFrame, frame: DataFrame, most: int | None = MOST_POINTS, eps: float = 1e-6) -> DataFrame:
    """(mesh_id, geo_id, seq, x, y, z): end points from the pole down, without those no farther than eps from the last one kept, led by the pole, thinned to ``most`` (None: all of them).

    A task holds the cuts of one meridian.
    """

    def run(rows: pa.Table) -> pa.Table:
        both = lambda c: np.stack([rows[f"{c}{k}"].to_numpy() for k in (0, 1)], 1).reshape(-1)
        lat, fid = both("lat"), rows["fid"].to_numpy()
        order = np.lexsort((np.stack([fid * 2, fid * 2 + 1], 1).reshape(-1), -lat))
        xyz = np.stack([both(c) for c in "xyz"], 1)[order]
        xyz = xyz[_kept(xyz, eps)]
        # the pole comes before the first point, unless that is the pole
        pole = np.array([[rows[f"p{c}"][0].as_py() for c in "xyz"]], float)
        if sum((xyz[0, i] - pole[0, i]) * (xyz[0, i] - pole[0, i]) for i in range(3)) > 1e-12:
            xyz = np.concatenate([pole, xyz])
        # of more than ``most`` points those at the rounded multiples of (n - 1) / (most - 1)
        seq = r = np.arange(len(xyz))
        if most is not None and len(xyz) > most:
            step = (len(xyz) - 1) / (most - 1)
            seq = np.ceil((r - 0.5) / step).astype(np.int64)
            held = np.floor(seq * step + 0.5) == r
            seq, xyz = seq[held], xyz[held]
        same = {k: pa.chunked_array([rows[k].combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(seq), np.int64)))]) for k in ("mesh_id", "geo_id")}
        return pa.table({**same, "seq": seq.astype(np.int32), **{c: xyz[:, i] for i, c in enumerate("xyz")}})

    rows = with_mesh(cuts, frame.select("mesh_id", "px", "py", "pz"))
    return rows.groupBy("mesh_id", "geo_id").applyInArrow(run, f"mesh_id string, geo_id {cuts.schema['geo_id'].dataType.simpleString()}, seq int, x double, y double, z double")


def series(points: DataFrame, keys: list[str], order: list[str], arc: str, value: str) -> DataFrame:
    """points with d1 and d2: central differences of ``value`` over ``arc`` (one-sided at the ends), and of d1 (0 at the ends); 0 where arc stands still."""
    w = W.partitionBy(*keys).orderBy(*order)

    def slope(v: str, ends: bool) -> Column:
        before, after = F.lag(arc).over(w), F.lead(arc).over(w)
        lo, hi = (F.coalesce(before, F.col(arc)), F.coalesce(after, F.col(arc))) if ends else (before, after)
        v_lo, v_hi = F.lag(v).over(w), F.lead(v).over(w)
        if ends:
            v_lo, v_hi = F.coalesce(v_lo, F.col(v)), F.coalesce(v_hi, F.col(v))
        return F.when(hi - lo > 1e-12, (v_hi - v_lo) / (hi - lo)).otherwise(0.0)

    return points.withColumn("d1", slope(value, True)).withColumn("d2", slope("d1", False))


def profiles(points: DataFrame, frame: DataFrame, vertices: DataFrame) -> DataFrame:
    """points with arc (running length), dev (micrometres from the mean radius of the vertices about the rim's centroid), d1 and d2."""
    center = frame.select("mesh_id", "rx", "ry", "rz")
    mean = with_mesh(vertices.select("mesh_id", "x", "y", "z"), center).groupBy("mesh_id").agg(F.avg(g.distance(g.point(), _cols("r"))).alias("mean_radius"))
    w = W.partitionBy("mesh_id", "geo_id").orderBy("seq")
    gap = F.coalesce(F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in "xyz"), F.lit(0.0))), F.lit(0.0))
    rows = with_mesh(with_mesh(points, center), mean).withColumn("gap", gap)
    rows = rows.withColumn("arc", F.sum("gap").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("dev", (g.distance(g.point(), _cols("r")) - F.col("mean_radius")) * 1000)
    return series(rows.select("mesh_id", "geo_id", "seq", "x", "y", "z", "arc", "dev"), ["mesh_id", "geo_id"], ["seq"], "arc", "dev")


def summaries(points: DataFrame, meshes: DataFrame, count: int = COUNT) -> DataFrame:
    """One row for each meridian, empty ones included: angle, length, extremes, points beyond a micrometre, rms of d2, regular or not.

    Regular: rms of d2 no more than twice the median of the mesh's meridians (of an even number, the upper one).
    """
    each = points.groupBy("mesh_id", "geo_id").agg(F.max("arc").alias("total_length"), F.max("dev").alias("max_dev"), F.min("dev").alias("min_dev"), F.count_if(F.abs("dev") > 1).alias("anomaly_count"), F.sqrt(F.avg(F.col("d2") * F.col("d2"))).alias("rms"))
    all_ = meshes.select("mesh_id").distinct().select("mesh_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("geo_id"))
    rows = all_.join(each, ["mesh_id", "geo_id"], "left").fillna(0, ["total_length", "max_dev", "min_dev", "anomaly_count", "rms"])
    by = W.partitionBy("mesh_id").orderBy("rms", "geo_id")  # ``count`` rows of a mesh
    rows = rows.withColumn("place", F.row_number().over(by) - 1)
    median = F.max(F.when(F.col("place") == count // 2, F.col("rms"))).over(W.partitionBy("mesh_id"))
    return rows.select("mesh_id", "geo_id", (F.col("geo_id") * 360.0 / count).alias("angle"), "total_length", "max_dev", "min_dev", "anomaly_count", "rms", (F.col("rms") <= 2 * median).alias("is_regular"))


def common_pole(points: DataFrame, frame: DataFrame, consistent: bool = False) -> DataFrame:
    """First points moved to their mean, with the deviation there. The second points' arc follows; with ``consistent`` all arcs, d1 and d2 do."""
    head = F.col("seq") == 0
    center = g.distance(g.point(), _cols("r"))
    # the mean radius of which the deviations tell
    radius = center - F.col("dev") / 1000
    first = with_mesh(points.filter(head), frame.select("mesh_id", "rx", "ry", "rz")).groupBy("mesh_id", "rx", "ry", "rz").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], F.avg(radius).alias("radius"))
    first = first.select("mesh_id", "mx", "my", "mz", ((g.distance(_cols("m"), _cols("r")) - F.col("radius")) * 1000).alias("mdev"))
    rows = with_mesh(points, first)
    moved = rows.select("mesh_id", "geo_id", "seq", *[F.when(head, F.col(f"m{c}")).otherwise(F.col(c)).alias(c) for c in ("x", "y", "z", "dev")], "arc", "d1", "d2")
    w = W.partitionBy("mesh_id", "geo_id").orderBy("seq")
    gap = F.coalesce(F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in "xyz"), F.lit(0.0))), F.lit(0.0))
    if not consistent:
        return moved.withColumn("arc", F.when(F.col("seq") == 1, gap).otherwise(F.col("arc")))
    again = moved.withColumn("gap", gap).withColumn("arc", F.sum("gap").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("gap", "d1", "d2")
    return series(again, ["mesh_id", "geo_id"], ["seq"], "arc", "dev")


def shown(meridians: DataFrame, mode: str = "all") -> DataFrame:
    """The meridians that a display mode shows: all, regular, irregular or none."""
    return meridians.filter({"regular": F.col("is_regular"), "irregular": ~F.col("is_regular"), "none": F.lit(False)}.get(mode, F.lit(True)))


def farthest(vertices: DataFrame, frame: DataFrame) -> DataFrame:
    """The vertex farthest along the axis from a centre (mesh_id, cx .. cz, ax .. az), the first of equal ones."""
    rows = with_mesh(vertices, frame.select("mesh_id", "cx", "cy", "cz", "ax", "ay", "az"))
    h = g.plane_distance(g.point(), _cols("c"), _cols("a"))
    best = rows.groupBy("mesh_id").agg(F.max(F.struct(h.alias("h"), (-F.col("vid")).alias("v"))).alias("m"))
    return best.select("mesh_id", (-F.col("m.v")).alias("vid"), F.col("m.h").alias("height"))


def opposite(meridians: DataFrame, count: int = COUNT) -> DataFrame:
    """(mesh_id, geo_a, geo_b): pairs of meridians whose angles differ by 180 degrees to within half a degree, each meridian once."""
    a = meridians.select("mesh_id", F.col("geo_id").alias("geo_a"))
    ids = F.transform(F.array(F.lit(count // 2), F.lit((count + 1) // 2)), lambda h: F.pmod(F.col("geo_a") + h, F.lit(count).cast("long")))
    rows = a.select("*", F.explode(F.array_distinct(ids)).alias("geo_b")).filter("geo_a < geo_b")
    away = F.abs(F.col("geo_b") * 360.0 / count - F.pmod(F.col("geo_a") * 360.0 / count + 180, F.lit(360.0)))
    rows = rows.filter(away < 0.5).join(meridians.select("mesh_id", F.col("geo_id").alias("geo_b")), ["mesh_id", "geo_b"])
    first = rows.groupBy("mesh_id", "geo_a").agg(F.min("geo_b").alias("geo_b"))
    return first.groupBy("mesh_id", "geo_b").agg(F.min("geo_a").alias("geo_a")).select("mesh_id", "geo_a", "geo_b")


def double_profiles(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Points of two opposite meridians as one series, rim to pole to rim: arc is negative on the first side, 0 at the pole."""
    of = lambda side: with_mesh(points, pairs.withColumn("geo_id", F.col(side)), keys=("mesh_id", "geo_id"), parts=1)
    a, b = of("geo_a").withColumn("arc", -F.col("arc")), of("geo_b").filter("seq > 0")
    columns = ["mesh_id", "geo_a", "geo_b", "x", "y", "z", "arc", "dev", "d1", "d2"]
    both = a.select(*columns, (-F.col("seq")).alias("s")).unionByName(b.select(*columns, F.col("seq").alias("s")))
    return both.withColumn("seq", F.row_number().over(W.partitionBy("mesh_id", "geo_a", "geo_b").orderBy("s")) - 1).drop("s")


def nearest_angle(meridians: DataFrame, *wanted: float) -> DataFrame:
    """Meridians within half a degree of one of the wanted angles."""
    test = F.lit(False)
    for a in wanted:
        test = test | (F.abs(F.col("angle") - a) < 0.5)
    return meridians.filter(test)


def irregular_runs(points: DataFrame, keys: list[str], threshold: float, order: str = "seq") -> DataFrame:
    """Runs of neighbouring points with |d2| above the threshold: first and last point, number, and the first of the highest |d2|."""
    w = W.partitionBy(*keys).orderBy(order)
    hit = F.abs("d2") > threshold
    rows = points.withColumn("hit", hit).withColumn("run", F.sum(F.when(hit & ~F.coalesce(F.lag(hit).over(w), F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    best = F.min(F.struct((-F.abs("d2")).alias("h"), F.col(order)))
    return rows.filter("hit").groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), best[order].alias("peak"), (-best["h"]).alias("peak_value"))


def severity(d2: Column, threshold: float) -> Column:
    """How far |d2| is beyond the threshold, as a share of it, 1 at most; null below."""
    return F.when(F.abs(d2) > threshold, F.least((F.abs(d2) - threshold) / threshold, F.lit(1.0)))


def section_frames(points: DataFrame, keys: list[str]) -> DataFrame:
    """The plane of each section (through its first, middle and last point): centroid m, normal n, axes u along first to last and v across.

    Sections of fewer than three points, or straight ones, have no rows.
    """
    n = points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], F.min("seq").alias("s0"))
    rows = with_mesh(points, n, keys=tuple(keys), parts=1)
    place = F.col("seq") - F.col("s0")
    pick = lambda c, at: F.max(F.when(place == at, F.col(c)))
    ends = rows.groupBy(*keys, "n", "mx", "my", "mz").agg(*[pick(c, at).alias(f"{name}{c}") for name, at in (("p", F.lit(0)), ("q", F.floor(F.col("n") / 2)), ("e", F.col("n") - 1)) for c in "xyz"])
    normal = g.cross(g.sub(_cols("q"), _cols("p")), g.sub(_cols("e"), _cols("p")))
    size = g.length(normal)
    u = g.normalized(g.sub(_cols("e"), _cols("p")))
    ends = ends.filter("n >= 3").select(*keys, "mx", "my", "mz", size.alias("size"), *[(x / size).alias(f"n{c}") for x, c in zip(normal, "xyz", strict=True)], *[x.alias(f"u{c}") for x, c in zip(u, "xyz", strict=True)]).filter("size >= 1e-10")
    return ends.select(*[c for c in ends.columns if c != "size"], *[x.alias(f"v{c}") for x, c in zip(g.cross(_cols("n"), _cols("u")), "xyz", strict=True)])


def projected(points: DataFrame, keys: list[str], threshold: float = 0.01) -> DataFrame:
    """A section's points in its own plane, as (u, v) about the centroid."""
    d = g.sub(g.point(), _cols("m"))
    return with_mesh(points, section_frames(points, keys), keys=tuple(keys), parts=1).select(*points.columns, g.dot(d, _cols("u")).alias("u"), g.dot(d, _cols("v")).alias("v"), (F.abs("d2") > threshold).alias("irregular"))


def outer_segments(faces: DataFrame, vertices: DataFrame, points: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fid, au, av, bu, bv): where the plane of each section, laid through the sphere's centre, cuts another surface.

    points: the sections' own points; centers: mesh_id, cx, cy, cz. Only what lies about the section's axis (centre to centroid)
    within 1.3 times its own angle and 0.15 more is kept, and only faces with two such points. Parts of
    a mesh's faces are grouped with all its planes, no more than its meridians, and NumPy drops pairs with the face on one side of the plane.
    """
    others = [k for k in keys if k != "mesh_id"]
    frames = with_mesh(section_frames(points, keys), centers.select("mesh_id", "cx", "cy", "cz"))
    axis = g.sub(_cols("m"), _cols("c"))

    def angle(p: g.Vec) -> Column:
        d = g.sub(p, _cols("c"))
        far = (g.length(d) > 1e-3) & (g.length(axis) > 1e-3)
        return F.when(far, F.acos(g.clamp(g.dot(d, axis) / (g.length(d) * g.length(axis)), -1.0, 1.0)))

    limits = points.join(frames, keys).groupBy(*keys).agg((F.coalesce(F.max(angle(g.point())), F.lit(0.0)) * 1.3 + 0.15).alias("limit"))
    names = [f"{k}{c}" for k in "mnuvc" for c in "xyz"]
    planes = stored(frames.join(limits, keys).select(*keys, *names, "limit"))
    rows = topology.gather(faces, vertices.select("mesh_id", "vid", *[F.col(c).cast("double").alias(c) for c in "xyz"]))
    rows = stored(rows.select("mesh_id", "fid", *[f"{c}{k}" for k in range(3) for c in "xyz"]))
    # no task holds more than some ``PART`` faces of a mesh, and a row of cuts for each plane that meets them
    parts = -(-rows.count() // PART) or 1
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("fid"), F.lit(parts)).cast("int"))
    planes = planes.join(rows.select("mesh_id", F.col("_part").alias("_p")).distinct(), "mesh_id")
    types = {**dict(planes.dtypes), "fid": rows.schema["fid"].dataType.simpleString()}
    schema = ", ".join(f"{k} {types[k]}" for k in (*keys, "fid")) + ", au double, av double, bu double, bv double"
    return rows.groupBy("mesh_id", "_part").cogroup(planes.groupBy("mesh_id", "_p")).applyInArrow(_cut_by_planes(keys), schema)


def _cut_by_planes(keys: list[str]):
    def run(faces: pa.Table, planes: pa.Table) -> pa.Table:
        p = np.array([[faces[f"{c}{k}"].to_numpy() for c in "xyz"] for k in range(3)]).reshape(3, 3, faces.num_rows)
        m, n, u, v, c = (np.array([planes[f"{k}{c}"].to_numpy() for c in "xyz"]).reshape(3, planes.num_rows) for k in "mnuvc")
        limit, axis = planes["limit"].to_numpy(), m - c
        far_axis = np.sqrt(axis[0] * axis[0] + axis[1] * axis[1] + axis[2] * axis[2])
        hits: list[tuple[np.ndarray, ...]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros((3, 0)))]
        for at in range(0, p.shape[2], 512):
            d = np.array([_dot(x[:, at : at + 512, None] - c[:, None], n[:, None]) for x in p])
            f, s = np.nonzero((d.min(0) < 0) & (d.max(0) > 0))
            hits.append((f + at, s, d[:, f, s]))
        f, s, d = (np.concatenate([h[k] for h in hits], axis=-1) for k in range(3))
        # a plane cuts two sides at most: the first of them and the last one
        cut = np.array([d[i] * d[(i + 1) % 3] < 0 for i in range(3)])
        two = cut.sum(0) == 2
        f, s, d, cut = f[two], s[two], d[:, two], cut[:, two]
        keep, flat = np.ones(len(f), bool), []
        for i in (np.where(cut[0], 0, 1), np.where(cut[2], 2, 1)):
            j, each = (i + 1) % 3, np.arange(len(f))
            t = d[i, each] / (d[i, each] - d[j, each])
            q = np.array([p[i, k, f] + t * (p[j, k, f] - p[i, k, f]) for k in range(3)])
            away = q - c[:, s]
            size = np.sqrt(_dot(away, away))
            with np.errstate(divide="ignore", invalid="ignore"):
                angle = np.arccos(np.clip(_dot(away, axis[:, s]) / (size * far_axis[s]), -1.0, 1.0))
            keep &= np.where((size > 1e-3) & (far_axis[s] > 1e-3), angle, 0.0) <= limit[s]
            flat += [_dot(q - m[:, s], u[:, s]), _dot(q - m[:, s], v[:, s])]
        out = {k: planes[k].combine_chunks().take(pa.array(s[keep])) for k in keys}
        return pa.table({**out, "fid": faces["fid"].combine_chunks().take(pa.array(f[keep])), **{k: x[keep] for k, x in zip(("au", "av", "bu", "bv"), flat, strict=True)}})

    return run


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


class _Ends:
    """The free ends of segments (n, 2, 2), found by place: in cells of a segment's length, and in cells of eps where those nearby are empty."""

    def __init__(self, ends: np.ndarray, eps: float):
        self.xy, self.eps, self.free = ends.reshape(-1, 2).tolist(), eps, bytearray(b"\x01") * len(ends)
        size = np.sqrt(((ends[:, 0] - ends[:, 1]) ** 2).sum(1)).mean()
        self.sizes = (min(max(float(size), eps / 1024), eps), eps * 1.001)
        self.cells: list[dict[tuple[int, int], list[int]]] = []
        for h in self.sizes:
            cells: dict[tuple[int, int], list[int]] = {}
            for k, (i, j) in enumerate(np.floor(ends.reshape(-1, 2) / h).astype(np.int64).tolist()):
                cells.setdefault((i, j), []).append(k)
            self.cells.append(cells)

    def nearest(self, x: float, y: float) -> int:
        """The free end nearest to a place and nearer than eps, of equal ones the first; -1 if there is none."""
        for h, cells in zip(self.sizes, self.cells, strict=True):
            i0, j0, best, at = math.floor(x / h), math.floor(y / h), math.inf, -1
            for i in (i0 - 1, i0, i0 + 1):
                for j in (j0 - 1, j0, j0 + 1):
                    held = cells.get((i, j))
                    if not held:
                        continue
                    used = 0
                    for k in held:
                        if not self.free[k >> 1]:
                            used += 1
                            continue
                        p, q = self.xy[k]
                        d = (p - x) * (p - x) + (q - y) * (q - y)
                        if d < best or (d == best and k < at):
                            best, at = d, k
                    if used > len(held) / 2:
                        cells[i, j] = [k for k in held if self.free[k >> 1]]
            # what lies nearer than a cell's size (less what rounding may move over its border) lies in these nine
            if best < (0.999 * h) ** 2:
                break
        return at if best < self.eps * self.eps else -1

    def grown(self, k: int) -> list[list[float]]:
        """Points that follow the end k from segment to segment, always to the nearest free end within eps; takes the segments used."""
        out, at = [], self.xy[k]
        while (k := self.nearest(*at)) >= 0:
            self.free[k >> 1] = 0
            at = self.xy[k ^ 1]
            out.append(at)
        return out


def _joined(lines: list[np.ndarray], eps: float) -> list[np.ndarray]:
    """Lines whose ends lie nearer than three eps as one: each takes the first of those after it, until there is none.

    A joined line has no other ends than its two, so lines before it, which met neither, need no second look.
    """
    heads, tails = np.array([x[0] for x in lines]), np.array([x[-1] for x in lines])
    parts = [[x] for x in lines]
    turned = lambda x: [p[::-1] for p in x[::-1]]
    rest, i = np.arange(len(lines)), 0
    while i < len(rest):
        k, after = rest[i], rest[i + 1 :]
        near = np.array([((p[k] - q[after]) ** 2).sum(1) < 9 * eps * eps for p, q in ((tails, heads), (tails, tails), (heads, heads), (heads, tails))])
        hits = near.any(0)
        if not hits.any():
            i += 1
            continue
        j = int(np.argmax(hits))
        o, way = after[j], int(np.argmax(near[:, j]))
        p, q = parts[k], parts[o]
        parts[k] = (p + q, p + turned(q), turned(q) + p, q + p)[way]
        heads[k], tails[k] = parts[k][0][0].copy(), parts[k][-1][-1].copy()
        rest = np.delete(rest, i + 1 + j)
    return [np.vstack(parts[k]) for k in rest]


def chained(ends: np.ndarray, least: int = 5) -> list[np.ndarray]:
    """Polylines of loose segments (n, 2, 2): grown from each free segment at both ends, joined where ends meet, cut at jumps; those of ``least`` points or more, longest first."""
    if len(ends) < 2:
        return []
    eps = max(0.05, 0.6 * float(np.sqrt(((ends[:, 0] - ends[:, 1]) ** 2).sum(1)).mean()))
    open_, lines = _Ends(ends, eps), []
    for k in range(len(ends)):
        if open_.free[k]:
            open_.free[k] = 0
            after = open_.grown(2 * k + 1)
            before = open_.grown(2 * k)
            lines.append(np.array([*before[::-1], *ends[k].tolist(), *after]))
    lines = _joined(lines, eps)
    out = []
    for line in (x for x in lines if len(x) >= least):
        gaps = np.sqrt((np.diff(line, axis=0) ** 2).sum(1))
        jump = 8 * (np.sort(gaps)[len(gaps) // 2] or 1.0)
        start = 0
        for at, gap in enumerate(gaps, 1):
            if gap > jump and at - start >= least:
                out.append(line[start:at])
                start = at
        if len(line) - start >= least:
            out.append(line[start:])
    return sorted(out, key=len, reverse=True)


def outer_chains(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chain, seq, u, v) of ``outer_segments``; chain 0 is the longest. A task holds the segments of one section, whose order of faces decides."""
    schema = ", ".join(f"{k} {segments.schema[k].dataType.simpleString()}" for k in keys) + ", chain int, seq int, u double, v double"

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fid")
        lines = chained(rows[["au", "av", "bu", "bv"]].to_numpy(float).reshape(-1, 2, 2))
        flat = np.vstack(lines) if lines else np.zeros((0, 2))
        out = pd.DataFrame({k: [v] * len(flat) for k, v in zip(keys, key, strict=True)})
        out["chain"] = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        out["seq"] = np.concatenate([np.arange(len(x)) for x in lines]) if lines else np.zeros(0, int)
        out["u"], out["v"] = flat[:, 0], flat[:, 1]
        return out

    return segments.groupBy(*keys).applyInPandas(run, schema)


def padded_bounds(rows: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """Extent of u and v with padding of a share of each extent (1 where it is 0)."""
    out = rows.groupBy(*keys).agg(*[f(c).alias(f"{k}_{c}") for c in "uv" for k, f in (("min", F.min), ("max", F.max))])
    pad = lambda c: F.when(F.col(f"max_{c}") > F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")).otherwise(1.0) * share
    return out.select(*keys, *[x for c in "uv" for x in ((F.col(f"min_{c}") - pad(c)).alias(f"min_{c}"), (F.col(f"max_{c}") + pad(c)).alias(f"max_{c}"))])


def circle(spheres: DataFrame, samples: int = 120) -> DataFrame:
    """Points (u, v) of the ideal circle of radius ``radius`` about (cu, cv), with the first again at the end."""
    phi = F.col("k") * (2 * math.pi / samples)
    rows = spheres.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("k"))
    return rows.select("mesh_id", "k", (F.col("cu") + F.col("radius") * F.cos(phi)).alias("u"), (F.col("cv") + F.col("radius") * F.sin(phi)).alias("v"))
