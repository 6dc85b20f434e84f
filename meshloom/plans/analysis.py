"""The two analyses of a cup, from vertices and faces to one row of results for each mesh."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions import geometry as g
from meshloom.operators import cluster, fit, meridian, select, smooth, topology, volume
from meshloom.operators.storage import stored, with_mesh


@dataclass(frozen=True)
class Params:
    meridians: int = 360
    rim_trim_percent: float = 6.0
    repair_inner: bool = False
    smoothing: int = 3
    threshold: float = 1.0
    density: float = volume.DENSITY
    commercial_radius: int = 0


@dataclass
class Prepared:
    """What both analyses start from."""

    inner: DataFrame
    inner_vertices: DataFrame
    kept: DataFrame
    kept_vertices: DataFrame
    smoothed: DataFrame
    frame: DataFrame
    points: DataFrame
    meridians: DataFrame
    sphere: DataFrame


def prepare(vertices: DataFrame, faces: DataFrame, params: Params = Params()) -> Prepared:
    """Separation, optional repair, trim, smoothing, rim and pole, profiles, and the sphere."""
    inner = stored(select.separate(faces, vertices).filter("surface = 'inner'").drop("surface"))
    inner_vertices = stored(topology.used_vertices(vertices, inner))
    if params.repair_inner:
        inner_vertices, inner = (stored(t) for t in smooth.repair(inner_vertices, inner))
    kept = stored(select.trim(inner, inner_vertices, params.rim_trim_percent).filter("kept").drop("kept"))
    kept_vertices = stored(topology.used_vertices(inner_vertices, kept))
    smoothed = stored(smooth.taubin(kept_vertices, kept, params.smoothing))
    rim = stored(select.rim_frame(inner, inner_vertices))
    frame = stored(select.rim_plane(select.pole(smoothed, rim), params.rim_trim_percent))
    lines = stored(meridian.polylines(meridian.segments(kept, smoothed, frame, params.meridians), frame))
    raw = stored(meridian.profiles(lines, frame, smoothed))
    rows = stored(meridian.summaries(raw, kept_vertices, params.meridians))
    points = stored(meridian.common_pole(raw, frame))
    regular = points.join(rows.filter("is_regular").select("mesh_id", "geo_id"), ["mesh_id", "geo_id"], "left_semi").select("mesh_id", "x", "y", "z")
    enough = regular.groupBy("mesh_id").count().filter("count >= 20").select("mesh_id")
    chosen = regular.join(enough, "mesh_id", "left_semi").unionByName(smoothed.select("mesh_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).join(enough, "mesh_id", "left_anti"))
    return Prepared(inner, inner_vertices, kept, kept_vertices, smoothed, frame, points, rows, stored(fit.fit_sphere_robust(stored(chosen))))


def commercial(sphere: DataFrame, params: Params) -> DataFrame:
    return sphere.select("mesh_id", "cx", "cy", "cz", F.col("radius").alias("fitted_radius"), fit.snap_radius(F.col("radius"), params.commercial_radius).alias("radius"))


def best_fit(vertices: DataFrame, faces: DataFrame, params: Params = Params()) -> DataFrame:
    """Wear against the commercial sphere: one row for each mesh. Counts are named for what they count."""
    p = prepare(vertices, faces, params)
    sphere = stored(commercial(p.sphere, params))
    classified = stored(select.classify(p.kept_vertices, sphere, p.frame))
    zones = classified.filter("active").select("mesh_id", F.when(F.col("worn"), "worn").otherwise("unworn").alias("zone"), "x", "y", "z")
    fitted = stored(fit.fit_fixed_radius(with_mesh(zones, sphere.select("mesh_id", "radius"))))
    few = zones.groupBy("mesh_id", "zone").count()
    wear = volume.wear_volume(volume.enclosed_volume(p.inner, p.inner_vertices, p.frame), sphere, p.frame)
    plane = volume.wear_plane(classified, p.frame).select("mesh_id", F.col("vid").alias("max_wear_vid"), F.col("max_depth").alias("max_wear_depth"), *[F.col(c).alias(f"max_wear_{c}") for c in "xyz"])
    out = with_mesh(with_mesh(sphere, p.sphere.select("mesh_id", "rms", "max_residual")), select.wear_summary(classified))
    out = out.join(wear, "mesh_id", "left").join(plane, "mesh_id", "left")
    for zone in ("worn", "unworn"):
        z = fitted.filter(F.col("zone") == zone).join(few.filter("count >= 3").select("mesh_id", "zone"), ["mesh_id", "zone"])
        out = out.join(z.select("mesh_id", *[F.col(f"c{c}").alias(f"{zone}_c{c}") for c in "xyz"], F.col("rms").alias(f"{zone}_rms")), "mesh_id", "left")
        out = out.withColumns({f"{zone}_c{c}": F.coalesce(f"{zone}_c{c}", f"c{c}") for c in "xyz"}).withColumn(f"{zone}_rms", F.coalesce(f"{zone}_rms", F.lit(0.0)))
    linear = g.distance(tuple(F.col(f"worn_c{c}") for c in "xyz"), tuple(F.col(f"unworn_c{c}") for c in "xyz"))
    counts = p.inner_vertices.groupBy("mesh_id").agg(F.count("*").alias("inner_vertices")).join(p.inner.groupBy("mesh_id").agg(F.count("*").alias("inner_faces")), "mesh_id")
    return out.join(counts, "mesh_id").select("*", linear.alias("linear_wear"), F.lit(params.meridians).alias("meridians"), F.lit(params.commercial_radius in fit.RADII).alias("manual"), (F.col("wear_volume") * params.density).alias("wear_mass"), F.lit("sphere-bestfit").alias("mode"))


def pure(vertices: DataFrame, faces: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame, Prepared]:
    """Wear against the fitted sphere: (one row for each mesh, clusters, what they came from)."""
    p = prepare(vertices, faces, params)
    deviations = stored(cluster.vertex_deviations(p.kept_vertices, p.sphere))
    volumes = volume.defect_volumes(p.kept, deviations, p.sphere, params.threshold, params.density)
    found = stored(cluster.anomalies(p.points, params.threshold))
    rows = found.select("mesh_id", "type", (F.col("geo_id") * 1000 + F.col("seq")).alias("id"), "x", "y", "z", "dev")
    members = stored(cluster.dbscan(rows))
    clusters = stored(cluster.cluster_summaries(members))
    vector = volume.wear_vector(members.filter("type = 'bump'").withColumnRenamed("id", "seq"), p.frame)
    shape = fit.fit_ellipsoid(p.kept_vertices).select("mesh_id", "semi_axes", "sphericity", "shape", "definite")
    n = clusters.groupBy("mesh_id").agg(F.count_if(F.col("type") == "bump").alias("bump_clusters"), F.count_if(F.col("type") == "dip").alias("dip_clusters"), F.greatest(F.max(F.when(F.col("type") == "bump", F.col("max_dev"))), F.lit(0.0)).alias("max_bump"), F.least(F.min(F.when(F.col("type") == "dip", F.col("min_dev"))), F.lit(0.0)).alias("max_dip"))
    zone = cluster.primary_zone(clusters).select("mesh_id", F.col("max_dev").alias("primary_depth"), F.col("area").alias("primary_area"))
    out = with_mesh(p.sphere, volumes).join(found.groupBy("mesh_id").agg(F.count("*").alias("anomaly_points")), "mesh_id", "left")
    out = out.join(n, "mesh_id", "left").join(shape, "mesh_id", "left").join(vector.select("mesh_id", F.col("max_depth").alias("vector_depth"), F.col("angle").alias("vector_angle"), F.col("distance").alias("vector_distance"), *[F.col(c).alias(f"vector_{c}") for c in "xyz"]), "mesh_id", "left").join(zone, "mesh_id", "left")
    counts = p.kept_vertices.groupBy("mesh_id").agg(F.count("*").alias("kept_vertices")).join(p.kept.groupBy("mesh_id").agg(F.count("*").alias("kept_faces")), "mesh_id")
    return out.join(counts, "mesh_id").withColumn("meridians", F.lit(params.meridians)).withColumn("mode", F.lit("pure-geodesic")), clusters, p
