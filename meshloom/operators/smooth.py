"""Smoothing by neighbour averages, and filling of small holes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators import topology
from meshloom.operators.storage import bucketed, stored, with_mesh


def neighbour_lists(faces: DataFrame) -> DataFrame:
    """(mesh_id, vid, near): the neighbours of each vertex, stored in buckets of the vertex."""
    return bucketed(topology.adjacency(faces).groupBy("mesh_id", F.col("dst").alias("vid")).agg(F.collect_list("src").alias("near")), "mesh_id", "vid")


def half_step(points: DataFrame, near: DataFrame, factor: float) -> DataFrame:
    """Each vertex moved by factor of the way to its neighbours' mean, as floats.

    ``points`` and ``near`` lie in buckets of the vertex: each vertex sends its place to its neighbours, and these sums are all that is exchanged.
    """
    sent = points.join(near, ["mesh_id", "vid"]).select("mesh_id", F.explode("near").alias("vid"), "x", "y", "z")
    mean = sent.groupBy("mesh_id", "vid").agg(*[F.avg(F.col(c).cast("double")).alias(f"m{c}") for c in "xyz"])
    moved = [F.coalesce(F.col(c).cast("double") + factor * (F.col(f"m{c}") - F.col(c)), F.col(c).cast("double")).cast("float").alias(c) for c in "xyz"]
    return points.join(mean, ["mesh_id", "vid"], "left").select("mesh_id", "vid", *moved)


def _smoothed(vertices: DataFrame, faces: DataFrame, factors: list[float]) -> DataFrame:
    near, points = neighbour_lists(faces), bucketed(vertices.select("mesh_id", "vid", "x", "y", "z"), "mesh_id", "vid")
    for factor in factors:
        points = bucketed(half_step(points, near, factor), "mesh_id", "vid")
    return points


def taubin(vertices: DataFrame, faces: DataFrame, iterations: int = 3, lam: float = 0.5, mu: float = -0.53) -> DataFrame:
    """Taubin smoothing: a shrinking and a growing half step each time; vertices without neighbours stay. Normals are made anew."""
    if iterations <= 0:
        return vertices
    return topology.vertex_normals(_smoothed(vertices, faces, [lam, mu] * iterations), faces)


def laplacian(vertices: DataFrame, faces: DataFrame, iterations: int = 2, alpha: float = 0.25) -> DataFrame:
    """Plain neighbour averaging, for previews."""
    return _smoothed(vertices, faces, [alpha] * iterations) if iterations > 0 else vertices.select("mesh_id", "vid", "x", "y", "z")


def ordered_loop(links: dict[int, list[int]]) -> list[int]:
    """The vertices of one boundary component in walking order, from an end if it has one, else from its least vertex."""
    start = min([v for v, n in links.items() if len(n) == 1], default=min(links))
    out, seen, at = [start], {start}, start
    while True:
        following = [n for n in sorted(links[at]) if n not in seen]
        if not following:
            return out
        at = following[0]
        out.append(at)
        seen.add(at)


def fill_holes(vertices: DataFrame, faces: DataFrame, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """Closes every boundary loop of 3 to ``most`` vertices but the largest with a fan around its centroid, facing as its vertices do.

    A task holds one loop, which ``most`` bounds. New ids follow those of the mesh, in order of the loops.
    """
    loops = stored(topology.boundary_loops(faces))
    small = loops.filter((F.col("n_vertices") >= 3) & (F.col("n_vertices") <= most) & ~F.col("is_rim"))
    points = small.join(vertices, ["mesh_id", "vid"]).select("mesh_id", "loop", "vid", "x", "y", "z", "nx", "ny", "nz")
    sides = topology.boundary_edges(faces).join(small.select("mesh_id", "loop", F.col("vid").alias("a")), ["mesh_id", "a"]).select("mesh_id", "loop", "a", "b")

    def fan(key, p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        columns = ["mesh_id", "loop", "place", "i0", "i1", "x", "y", "z"]
        links: dict[int, list[int]] = {}
        for a, b in zip(e["a"].tolist(), e["b"].tolist(), strict=True):
            links.setdefault(a, []).append(b)
            links.setdefault(b, []).append(a)
        walk = ordered_loop(links) if links else []
        if len(walk) < 3:
            return pd.DataFrame([], columns=columns)
        p = p.set_index("vid").loc[walk]
        xyz, normals = p[["x", "y", "z"]].to_numpy(float), p[["nx", "ny", "nz"]].to_numpy(float)
        middle = xyz.mean(0)
        turn = np.cross(xyz - middle, np.roll(xyz, -1, 0) - middle).sum(0)
        if turn @ normals.sum(0) < 0:
            walk = walk[::-1]
        out = pd.DataFrame([(*key, k, v, walk[(k + 1) % len(walk)], *middle) for k, v in enumerate(walk)], columns=columns)
        return out.astype({"mesh_id": object})

    points, sides = stored(points), stored(sides)  # a cogroup needs two lineages
    fans = points.groupBy("mesh_id", "loop").cogroup(sides.groupBy("mesh_id", "loop")).applyInPandas(fan, "mesh_id string, loop long, place int, i0 long, i1 long, x float, y float, z float")
    fans = stored(fans)
    base = vertices.groupBy("mesh_id").agg((F.max("vid") + 1).alias("next_v")).join(faces.groupBy("mesh_id").agg((F.max("fid") + 1).alias("next_f")), "mesh_id")
    holes = topology.numbered(fans.filter("place = 0").select("mesh_id", "loop"), "loop", "hole")
    sides = topology.numbered(fans.withColumn("_o", F.col("loop") * most + F.col("place")), "_o", "f").join(holes, ["mesh_id", "loop"])
    numbered = with_mesh(sides, base)
    new_points = numbered.filter("place = 0").select("mesh_id", (F.col("next_v") + F.col("hole")).alias("vid"), "x", "y", "z")
    new_faces = numbered.select("mesh_id", (F.col("next_f") + F.col("f")).alias("fid"), "i0", "i1", (F.col("next_v") + F.col("hole")).alias("i2"))
    points, rows = vertices.select("mesh_id", "vid", "x", "y", "z").unionByName(new_points), faces.unionByName(new_faces)
    return topology.vertex_normals(points, rows), rows


def repair(vertices: DataFrame, faces: DataFrame, iterations: int = 2, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """Small holes filled, then smoothed."""
    points, rows = fill_holes(vertices, faces, most)
    points, rows = stored(points), stored(rows)
    return taubin(points, rows, iterations), rows
