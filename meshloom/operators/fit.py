"""Least-squares fits. Points are reduced to moments in one aggregation; the small systems are solved row by row of that result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions import geometry as g
from meshloom.operators.storage import stored, with_mesh

#: Points of a group up to which an iterated fit runs in one task; larger groups iterate with one job each round.
KERNEL_POINTS = 1_000_000
RADII = (14, 16, 18, 20)


def sphere_moments(points: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """The distinct entries of the normal equations of x² + y² + z² = a x + b y + c z + d, as sums."""
    x, y, z = g.point()
    w = F.lit(1.0) if weight is None else weight
    q = x * x + y * y + z * z
    parts = {"n": F.lit(1.0), "x": x, "y": y, "z": z, "xx": x * x, "xy": x * y, "xz": x * z, "yy": y * y, "yz": y * z, "zz": z * z, "q": q, "xq": x * q, "yq": y * q, "zq": z * q}
    return points.groupBy(*keys).agg(*[F.sum(w * p).alias(f"s_{k}") for k, p in parts.items()])


def _solve_spheres(keys: list[str]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                a = np.array([[r.s_xx, r.s_xy, r.s_xz, r.s_x], [r.s_xy, r.s_yy, r.s_yz, r.s_y], [r.s_xz, r.s_yz, r.s_zz, r.s_z], [r.s_x, r.s_y, r.s_z, r.s_n]])
                b = np.array([r.s_xq, r.s_yq, r.s_zq, r.s_q])
                try:
                    s = np.linalg.solve(a, b)
                except np.linalg.LinAlgError:
                    s = np.linalg.pinv(a) @ b
                center = s[:3] / 2
                rows.append((*(getattr(r, k) for k in keys), *center, float(np.sqrt(max(0.0, s[3] + center @ center)))))
            yield pd.DataFrame(rows, columns=[*keys, "cx", "cy", "cz", "radius"])

    return run


def solve_spheres(moments: DataFrame, keys: list[str]) -> DataFrame:
    schema = ", ".join(f"{k} string" for k in keys) + ", cx double, cy double, cz double, radius double"
    return moments.mapInPandas(_solve_spheres(keys), schema)




def center() -> g.Vec:
    return F.col("cx"), F.col("cy"), F.col("cz")


def residual() -> Column:
    return g.distance(g.point(), center()) - F.col("radius")


def fit_sphere(points: DataFrame) -> DataFrame:
    """Algebraic least-squares sphere of each mesh: cx, cy, cz, radius, rms, max_residual."""
    fit = solve_spheres(sphere_moments(points, ["mesh_id"]), ["mesh_id"])
    rows = with_mesh(points.select("mesh_id", "x", "y", "z"), fit)
    return rows.groupBy("mesh_id", "cx", "cy", "cz", "radius").agg(F.sqrt(F.avg(residual() * residual())).alias("rms"), F.max(F.abs(residual())).alias("max_residual"))


def fit_sphere_robust(points: DataFrame, iterations: int = 5) -> DataFrame:
    """Reweighted least squares with Tukey's bisquare at three standard deviations; rms counts points of weight above 0.01."""
    points = points.select("mesh_id", "x", "y", "z")
    fit = fit_sphere(points)
    for _ in range(iterations):
        rows = with_mesh(points, fit)
        u = F.abs(residual()) / (3 * F.greatest(F.col("rms"), F.lit(1e-6)))
        rows = rows.withColumn("weight", F.when(u < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)).select("mesh_id", "x", "y", "z", "weight")
        again = solve_spheres(sphere_moments(rows, ["mesh_id"], F.col("weight")), ["mesh_id"])
        rows = with_mesh(rows, again)
        near = F.col("weight") > 0.01
        fit = stored(rows.groupBy("mesh_id", "cx", "cy", "cz", "radius").agg(F.coalesce(F.sqrt(F.avg(F.when(near, residual() * residual()))), F.lit(0.0)).alias("rms"), F.max(F.abs(residual())).alias("max_residual")))
    return fit


def _fixed_step(p: np.ndarray, c: np.ndarray, r: float) -> np.ndarray:
    d = p - c
    n = np.linalg.norm(d, axis=1)
    ok = n >= 1e-12
    return (p[ok] - d[ok] * (r / n[ok])[:, None]).sum(0) / len(p)


def fixed_radius_center(p: np.ndarray, r: float, iterations: int = 30) -> tuple[np.ndarray, float]:
    """Centre of a sphere of radius r: a fixed-point fit, then moved until no point lies inside (100 moves at most), and the rms."""
    if not len(p):
        return np.zeros(3), 0.0
    c = p.mean(0)
    for _ in range(iterations):
        c = _fixed_step(p, c, r)
    for _ in range(100):
        d = p - c
        n = np.linalg.norm(d, axis=1)
        inside = n < r
        if not inside.any():
            break
        c = c - (d[inside] / np.maximum(n[inside], 1e-12)[:, None] * (r - n[inside])[:, None]).sum(0) / inside.sum()
    return c, float(np.sqrt(np.mean((np.linalg.norm(p - c, axis=1) - r) ** 2)))


def fit_fixed_radius(points: DataFrame, iterations: int = 30, kernel_points: int = KERNEL_POINTS) -> DataFrame:
    """(mesh_id, zone, x, y, z, radius) -> mesh_id, zone, cx, cy, cz, radius, rms."""
    schema = "mesh_id string, zone string, cx double, cy double, cz double, radius double, rms double"
    most = points.groupBy("mesh_id", "zone").count().agg(F.max("count")).first()[0] or 0
    if most <= kernel_points:

        def kernel(key, rows: pd.DataFrame) -> pd.DataFrame:
            r = float(rows["radius"].iloc[0])
            c, rms = fixed_radius_center(rows[["x", "y", "z"]].to_numpy(float), r, iterations)
            return pd.DataFrame([[*key, *c, r, rms]], columns=["mesh_id", "zone", "cx", "cy", "cz", "radius", "rms"])

        return points.select("mesh_id", "zone", "x", "y", "z", "radius").groupBy("mesh_id", "zone").applyInPandas(kernel, schema)
    keys = ("mesh_id", "zone")
    fit = points.groupBy(*keys).agg(*[F.avg(F.col(c).cast("double")).alias(f"c{c}") for c in "xyz"], F.first("radius").alias("r"))
    p, d = g.point(), g.distance(g.point(), center())
    for step in range(iterations + 100):
        rows = with_mesh(points, fit, keys=keys)
        if step < iterations:
            moved = [F.sum(F.when(d >= 1e-12, q - (q - c) * (F.col("r") / d)).otherwise(0.0)) / F.count("*") for q, c in zip(p, center(), strict=True)]
        else:
            inside = d < F.col("r")
            if not rows.filter(inside).limit(1).count():
                break
            push = [F.first(c) - F.coalesce(F.sum(F.when(inside, (q - c) / F.greatest(d, F.lit(1e-12)) * (F.col("r") - d))) / F.count_if(inside), F.lit(0.0)) for q, c in zip(p, center(), strict=True)]
            moved = push
        fit = rows.groupBy(*keys).agg(*[m.alias(f"c{c}") for m, c in zip(moved, "xyz", strict=True)], F.first("r").alias("r"))
    rows = with_mesh(points, fit, keys=keys)
    return rows.groupBy(*keys, "cx", "cy", "cz", F.col("r").alias("radius")).agg(F.sqrt(F.avg((d - F.col("r")) * (d - F.col("r")))).alias("rms"))


def _partial_qr(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for part in parts:
        frame = part.to_pandas()
        for mesh, rows in frame.groupby("mesh_id"):
            x, y, z = (rows[c].to_numpy(float) for c in "xyz")
            a = np.stack([x * x, y * y, z * z, 2 * x * y, 2 * x * z, 2 * y * z, 2 * x, 2 * y, 2 * z, np.ones(len(x))], 1)
            held[mesh] = np.linalg.qr(np.vstack([held[mesh], a]) if mesh in held else a, mode="r")
    rows = [(mesh, row.tolist()) for mesh, r in held.items() for row in r]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["mesh_id", "r"])


def ellipsoid_of(r: np.ndarray) -> tuple:
    """Centre, semi-axes ascending, axes' directions in that order, sphericity, class, definite, algebraic rms; from the R factor of [terms, 1]."""
    q, _, _, _ = np.linalg.lstsq(r[:, :9], r[:, 9], rcond=None)
    left = r[:, :9] @ q - r[:, 9]
    rms = float(np.sqrt(left @ left / max(r[:, 9] @ r[:, 9], 1.0)))  # the last column is all ones: its square sum is n
    m = np.array([[q[0], q[3], q[4]], [q[3], q[1], q[5]], [q[4], q[5], q[2]]])
    v = q[6:9]
    c = -np.linalg.pinv(m) @ v
    k = 1 - v @ c  # 1 + v' Q^-1 v
    values, vectors = np.linalg.eigh(m / k)
    axes = 1 / np.sqrt(np.maximum(np.abs(values), 1e-300))
    order = np.argsort(axes)
    ratio = 100 * axes.min() / axes.max()
    kind = "sphere" if ratio >= 98 else "slight-ellipsoid" if ratio >= 90 else "significant-ellipsoid"
    return c.tolist(), axes[order].tolist(), vectors[:, order].T.tolist(), float(ratio), kind, bool((values > 0).all()), rms


def fit_ellipsoid(points: DataFrame) -> DataFrame:
    """Least-squares ellipsoid of each mesh by a tree of QR factors, without squaring the condition number.

    A task hands on ten numbers by ten for each mesh; a mesh's factors are stacked and reduced once more.
    The directions belong to the semi-axes, and ``definite`` tells whether the quadric is an ellipsoid at all.
    """

    def solve(key, rows: pd.DataFrame) -> pd.DataFrame:
        c, axes, directions, ratio, kind, definite, rms = ellipsoid_of(np.linalg.qr(np.stack(rows["r"].to_numpy()), mode="r"))
        return pd.DataFrame({"mesh_id": [key[0]], "cx": [c[0]], "cy": [c[1]], "cz": [c[2]], "semi_axes": [axes], "directions": [directions], "sphericity": [ratio], "shape": [kind], "definite": [definite], "rms": [rms]})

    factors = points.select("mesh_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).mapInArrow(_partial_qr, "mesh_id string, r array<double>")
    return factors.groupBy("mesh_id").applyInPandas(solve, "mesh_id string, cx double, cy double, cz double, semi_axes array<double>, directions array<array<double>>, sphericity double, shape string, definite boolean, rms double")


def snap_radius(radius: Column, manual: int = 0) -> Column:
    """Commercial radius: the chosen one if it is on offer, else the largest that the fit reaches to within 0.2, else 14."""
    if manual in RADII:
        return F.lit(float(manual))
    out = F.lit(float(RADII[0]))
    for r in RADII:
        out = F.when(~F.isnan(radius) & ((radius >= r) | (r - radius <= 0.2)), F.lit(float(r))).otherwise(out)
    return out


def principal(points: DataFrame) -> DataFrame:
    """Centroid, and the unit eigenvectors of the covariance by ascending eigenvalue, of each mesh."""
    x, y, z = g.point()
    sums = points.groupBy("mesh_id").agg(F.count("*").alias("n"), *[F.avg(e).alias(k) for k, e in {"mx": x, "my": y, "mz": z}.items()])
    rows = with_mesh(points.select("mesh_id", "x", "y", "z"), sums)
    d = g.sub(g.point(), (F.col("mx"), F.col("my"), F.col("mz")))
    cov = rows.groupBy("mesh_id", "n", "mx", "my", "mz").agg(*[F.avg(d[i] * d[j]).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)])

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                m = np.array([[r.c00, r.c01, r.c02], [r.c01, r.c11, r.c12], [r.c02, r.c12, r.c22]])
                values, vectors = np.linalg.eigh(m)
                v = vectors.T * np.sign(np.where(np.abs(vectors.T) == np.abs(vectors.T).max(1, keepdims=True), vectors.T, 0).sum(1))[:, None]
                out.append((r.mesh_id, int(r.n), r.mx, r.my, r.mz, values.tolist(), v.tolist()))
            yield pd.DataFrame(out, columns=["mesh_id", "n", "mx", "my", "mz", "eigenvalues", "eigenvectors"])

    return cov.mapInPandas(solve, "mesh_id string, n long, mx double, my double, mz double, eigenvalues array<double>, eigenvectors array<array<double>>")


def vector(column: str) -> g.Vec:
    return F.col(column)[0], F.col(column)[1], F.col(column)[2]


def cup_axis(vertices: DataFrame, origin: DataFrame) -> DataFrame:
    """Direction of least variance about ``origin`` (mesh_id, ox, oy, oz), turned to the side with fewer vertices: ax, ay, az."""
    rows = stored(with_mesh(vertices.select("mesh_id", "x", "y", "z"), origin).withColumns({c: F.col(c).cast("double") - F.col(f"o{c}") for c in "xyz"}))
    # second moments about the origin, not about the mean
    d = (F.col("x"), F.col("y"), F.col("z"))
    cov = rows.groupBy("mesh_id").agg(*[F.avg(d[i] * d[j]).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)])

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                _, v = np.linalg.eigh(np.array([[r.c00, r.c01, r.c02], [r.c01, r.c11, r.c12], [r.c02, r.c12, r.c22]]))
                out.append((r.mesh_id, *v[:, 0]))
            yield pd.DataFrame(out, columns=["mesh_id", "ax", "ay", "az"])

    axis = cov.mapInPandas(solve, "mesh_id string, ax double, ay double, az double")
    sided = with_mesh(rows, axis)
    a = (F.col("ax"), F.col("ay"), F.col("az"))
    flip = sided.groupBy("mesh_id", "ax", "ay", "az").agg(F.when(F.count_if(g.dot(d, a) > 0) > F.count("*") / 2, -1.0).otherwise(1.0).alias("s"))
    return flip.select("mesh_id", *[(F.col(c) * F.col("s")).alias(c) for c in ("ax", "ay", "az")])
