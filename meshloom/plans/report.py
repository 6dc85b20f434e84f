"""Reports: tidy tables of results, and the sectioned text made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: metric, unit, and the values beyond which it is a warning and a danger (None: it is neither).
METRICS: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("fitted_radius", "mm", None, None), ("radius", "mm", None, None), ("rms", "mm", None, None), ("worn", "vertices", 0, 0), ("worn_percent", "%", 2, 10), ("enclosed_volume", "mm3", None, None),
    ("cap_volume", "mm3", None, None), ("wear_volume", "mm3", 0.1, 0.1), ("wear_mass", "mg", None, None), ("linear_wear", "mm", 0.01, 0.01), ("max_wear_depth", "um", 5, 10),
)


def severity(value: Column, warning: float | None, danger: float | None) -> Column:
    if warning is None:
        return F.lit(None).cast("string")
    return F.when(value > danger, "danger").when(value > warning, "warning").when(value.isNotNull(), "success")


def metrics(results: DataFrame) -> DataFrame:
    """mesh_id, metric, value, unit, severity: the results panel as rows."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(u).alias("unit"), severity(F.col(m), w, a).alias("severity")) for m, u, w, a in METRICS if m in results.columns]
    return results.select("mesh_id", F.explode(F.array(*rows)).alias("r")).select("mesh_id", "r.*")


_CENTRE = [("Sphere Fit", f"Center {c.upper()}", f"c{c}", "mm", None) for c in "xyz"]
_SPHERE = [
    ("Sphere Fit", "Radius", "{fitted}", "mm", None), *_CENTRE, ("Sphere Fit", "RMS Error", "rms * 1000", "um", None), ("Sphere Fit", "Max Error", "max_residual * 1000", "um", None),
]


def _over(value: str, danger: float, warning: float | None = None) -> str:
    middle = f" WHEN {value} > {warning} THEN 'warning'" if warning is not None else ""
    return f"CASE WHEN {value} > {danger} THEN 'danger'{middle} ELSE 'success' END"


#: The panel of each mode: section, name, value, unit and severity as SQL over the row of results; a text where the value is none.
PANEL: dict[str, list[tuple[str, str, str, str | None, str | None]]] = {
    "sphere-bestfit": [
        ("Summary", "Vertices", "inner_vertices", None, None), ("Summary", "Faces", "inner_faces", None, None), ("Summary", "Geodesics", "meridians", None, None),
        ("Summary", "Worn Vertices", "worn", None, _over("worn", 0)), ("Summary", "Worn %", "worn_percent", "%", _over("worn_percent", 5)),
        ("Summary", "Wear Volume", "wear_volume", "mm3", _over("wear_volume", 0.1)), ("Summary", "Linear Wear", "linear_wear * 1000", "um", _over("linear_wear", 0.01)),
        *[(a, b, c.format(fitted="fitted_radius"), d, e) for a, b, c, d, e in _SPHERE],
        ("Commercial Sphere", "Geodesic Radius", "fitted_radius", "mm", None), ("Commercial Sphere", "Commercial Radius", "radius", "mm", None),
        ("Commercial Sphere", "Detection", "CASE WHEN manual THEN 'Manual' WHEN radius > fitted_radius THEN 'Auto (snap up)' ELSE 'Auto (round down)' END", None, None),
        *[("Commercial Sphere", f"Center {c.upper()}", f"c{c}", "mm", None) for c in "xyz"],
        ("Wear Classification", "Threshold", "radius * 1.02", "mm", None), ("Wear Classification", "Worn Vertices", "worn", None, _over("worn", 0)), ("Wear Classification", "Unworn Vertices", "unworn", None, "'success'"),
        ("Wear Classification", "Worn %", "worn_percent", "%", _over("worn_percent", 10, 2)),
        ("Zone Spheres", "Linear Wear", "linear_wear * 1000", "um", "'danger'"), ("Zone Spheres", "Worn Sphere RMS", "worn_rms * 1000", "um", "'danger'"), ("Zone Spheres", "Unworn Sphere RMS", "unworn_rms * 1000", "um", "'success'"),
        ("Wear Volume", "Mesh Enclosed Vol", "enclosed_volume", "mm3", None), ("Wear Volume", "Sphere Cap Vol", "cap_volume", "mm3", None), ("Wear Volume", "Wear Volume", "wear_volume", "mm3", _over("wear_volume", 0.1)),
        ("Wear Volume", "Wear Mass", "wear_mass", "mg", _over("wear_volume", 0.1)),
        ("Maximum Wear Point", "Max Wear Depth", "max_wear_depth", "um", _over("max_wear_depth", 10, 5)), *[("Maximum Wear Point", f"Point {c.upper()}", f"max_wear_{c}", "mm", None) for c in "xyz"],
    ],
    "pure-geodesic": [
        ("Summary", "Vertices", "kept_vertices", None, None), ("Summary", "Faces", "kept_faces", None, None), ("Summary", "Geodesics", "meridians", None, None),
        ("Summary", "Anomaly Points", "anomaly_points", None, "CASE WHEN anomaly_points > 0 THEN 'warning' ELSE 'success' END"), ("Summary", "Wear Clusters", "bump_clusters", None, _over("bump_clusters", 0)),
        *[(a, b, c.format(fitted="radius"), d, e) for a, b, c, d, e in _SPHERE],
        ("Shape Classification", "Sphericity", "sphericity", "%", "CASE WHEN sphericity >= 98 THEN 'success' WHEN sphericity >= 90 THEN 'warning' ELSE 'danger' END"), ("Shape Classification", "Classification", "translate(shape, '-', ' ')", None, None),
        *[("Shape Classification", f"Semi-axis {n}", f"semi_axes[{k}]", "mm", None) for k, n in enumerate("ABC")], *[("Shape Classification", f"Axis ratio ({n}/A)", f"semi_axes[{k}] / semi_axes[0]", None, None) for k, n in ((1, "B"), (2, "C"))],
        ("Wear Analysis", "Max Wear", "max_bump", "um", _over("max_bump", 10, 5)), ("Wear Analysis", "Max Dip", "max_dip", "um", None),
        ("Wear Analysis", "Primary Wear Depth", "primary_depth", "um", "'danger'"), ("Wear Analysis", "Primary Wear Area", "primary_area", "mm2", None),
        ("Volume Analysis", "Wear Volume", "bump_volume", "mm3", _over("bump_volume", 0.1)), ("Volume Analysis", "Wear Mass", "bump_mass", "mg", "'danger'"),
        ("Wear Vector", "Max Depth", "vector_depth", "um", "'danger'"), ("Wear Vector", "Distance to Pole", "vector_distance", "mm", None), ("Wear Vector", "Angle from Axis", "vector_angle", "deg", None),
        *[("Wear Vector", f"Deepest Pt {c.upper()}", f"vector_{c}", "mm", None) for c in "xyz"],
    ],
}
#: Rows that are words.
WORDS = ("Detection", "Classification")


def panel(results: DataFrame, mode: str) -> DataFrame:
    """mesh_id, place, section, metric, value, text, unit, severity: all rows of a mode's panel in their order.

    A value that an analysis does not have, such as a zone without points or a wear vector without bumps, is null and has no severity.
    """
    rows = []
    for k, (section, name, value, unit, judged) in enumerate(PANEL[mode]):
        words = name in WORDS
        number = F.lit(None).cast("double") if words else F.expr(value).cast("double")
        severity_ = F.when(F.expr(value).isNotNull(), F.expr(judged)) if judged else F.lit(None).cast("string")
        rows.append(F.struct(F.lit(k).alias("place"), F.lit(section).alias("section"), F.lit(name).alias("metric"), number.alias("value"), (F.expr(value) if words else F.lit(None)).cast("string").alias("text"), F.lit(unit).cast("string").alias("unit"), severity_.alias("severity")))
    return results.select("mesh_id", F.explode(F.array(*rows)).alias("r")).select("mesh_id", "r.*")


def detail_points(points: DataFrame, meridians: DataFrame, first: int = 20, least: float = 0.5) -> DataFrame:
    """Points beyond ``least`` micrometres of the first meridians that have anomalies."""
    some = meridians.filter("anomaly_count > 0").withColumn("_n", F.dense_rank().over(W.partitionBy("mesh_id").orderBy("geo_id"))).filter(F.col("_n") <= first)
    return points.join(some.select("mesh_id", "geo_id", "angle"), ["mesh_id", "geo_id"]).filter(F.abs("dev") > least).select("mesh_id", "geo_id", "angle", "seq", "arc", "dev", "d1", "d2", "x", "y", "z")


def first_clusters(clusters: DataFrame, n: int = 10) -> DataFrame:
    return clusters.filter(F.col("cluster_id") < n)


def text(mesh_id: str, result: dict, meridians: DataFrame, points: DataFrame, clusters: DataFrame) -> str:
    """The sectioned report of one mesh. Wear volume and mass are the mode's own figures."""
    mine = F.col("mesh_id") == mesh_id
    lines = ["# Summary", *[f"{k},{v:.6f}" if isinstance(v, float) else f"{k},{v}" for k, v in result.items() if k != "mesh_id"], "", "# Geodesic Data", "angle,total_length,max_dev,min_dev,anomaly_count"]
    lines += [f"{r.angle:.1f},{r.total_length:.4f},{r.max_dev:.4f},{r.min_dev:.4f},{r.anomaly_count}" for r in meridians.filter(mine).orderBy("geo_id").toLocalIterator()]
    lines += ["", "# Detailed Geodesic Points", "angle,arc,dev,d1,d2,x,y,z"]
    lines += [f"{r.angle:.1f},{r.arc:.4f},{r.dev:.4f},{r.d1:.6f},{r.d2:.6f},{r.x:.6f},{r.y:.6f},{r.z:.6f}" for r in detail_points(points.filter(mine), meridians.filter(mine)).orderBy("geo_id", "seq").toLocalIterator()]
    lines += ["", "# Anomaly Clusters", "id,type,points,avg_dev,max_dev,min_dev,area,cx,cy,cz"]
    lines += [f"{r.cluster_id},{r.type},{r.n_points},{r.avg_dev:.4f},{r.max_dev:.4f},{r.min_dev:.4f},{r.area:.4f},{r.cx:.6f},{r.cy:.6f},{r.cz:.6f}" for r in clusters.filter(mine).orderBy("cluster_id").toLocalIterator()]
    return "\n".join(lines) + "\n"
