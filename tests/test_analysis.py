"""Both analyses from end to end, on a cup and on the same cup turned and moved, in one table; and the reports made of them."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators.storage import stored
from meshloom.plans import analysis, cup, report

PARAMS = analysis.Params(meridians=24)


@pytest.fixture(scope="module")
def cups(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.range(800).select(F.col("id").alias("p_partkey"), (F.col("id") * 7 % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{folder}/part.parquet")
    v, f = cup.cup(spark, folder)
    a, b = 0.7, -1.1
    turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, np.cos(b), -np.sin(b)], [0, np.sin(b), np.cos(b)]])
    moved = [sum((float(turn[i, j]) * F.col(c).cast("double") for j, c in enumerate("xyz")), F.lit((30.0, -12.0, 5.0)[i])).cast("float").alias(d) for i, d in enumerate("xyz")]
    v = stored(v.unionByName(v.select(F.lit("moved").alias("mesh_id"), "vid", *moved)))
    return v, stored(f.unionByName(f.withColumn("mesh_id", F.lit("moved")))), turn


def alike(rows, names, rel=2e-3):
    a, b = (rows[m].asDict() for m in ("cup", "moved"))
    for n in names:
        assert a[n] == pytest.approx(b[n], rel=rel, abs=1e-2), n
    return a, b


def center_moves(a, b, turn):
    assert turn @ np.array([a[f"c{c}"] for c in "xyz"]) + (30.0, -12.0, 5.0) == pytest.approx([b[f"c{c}"] for c in "xyz"], abs=0.1)


def test_best_fit_of_a_cup_wherever_it_lies(spark, cups):
    v, f, turn = cups
    results = stored(analysis.best_fit(v, f, PARAMS))
    rows = {r.mesh_id: r for r in results.collect()}
    a, b = alike(rows, ["radius", "enclosed_volume", "inner_vertices", "inner_faces"])
    alike(rows, ["fitted_radius", "cap_volume", "worn_percent"], 0.02)  # meridians start elsewhere, so the sphere is fitted to other points
    center_moves(a, b, turn)
    assert a["radius"] == 16
    panel = report.panel(results, "sphere-bestfit").orderBy("mesh_id", "place").collect()
    assert len(panel) == 2 * len(report.PANEL["sphere-bestfit"]) and {r.severity for r in panel} <= {None, "success", "warning", "danger"}
    by = {(r.mesh_id, r.section, r.metric): r for r in panel}
    assert by["cup", "Summary", "Worn Vertices"].severity == ("danger" if a["worn"] else "success") and by["cup", "Commercial Sphere", "Detection"].text.startswith("Auto")
    assert by["cup", "Maximum Wear Point", "Point X"].value == pytest.approx(a["max_wear_x"]) and by["cup", "Sphere Fit", "Max Error"].value == pytest.approx(1000 * a["max_residual"])
    flat = {(r.mesh_id, r.metric): r.value for r in report.metrics(results).collect()}
    assert flat["moved", "wear_volume"] == b["wear_volume"]


def test_pure_analysis_of_a_cup_wherever_it_lies(spark, cups):
    v, f, turn = cups
    results, clusters, prepared = analysis.pure(v, f, PARAMS)
    results, clusters = stored(results), stored(clusters)
    rows = {r.mesh_id: r for r in results.collect()}
    a, b = alike(rows, ["kept_vertices", "kept_faces"])  # the ellipsoid's equation is fitted about the origin, so it is not among these
    alike(rows, ["radius", "rms", "bump_volume"], 0.05)  # the dips, between sphere and shell, follow the fitted centre too closely to compare
    center_moves(a, b, turn)
    assert a["anomaly_points"] > 0
    assert a["bump_volume"] + a["dip_volume"] == pytest.approx(a["total_volume"])
    best = {r.mesh_id: r.m for r in clusters.filter("type = 'bump'").groupBy("mesh_id").agg(F.max("max_dev").alias("m")).collect()}
    assert a["max_bump"] == pytest.approx(best["cup"]) == pytest.approx(a["primary_depth"])
    panel = {(r.section, r.metric): r for r in report.panel(results.filter("mesh_id = 'cup'"), "pure-geodesic").collect()}
    axes = sorted(a["semi_axes"])
    assert panel["Shape Classification", "Axis ratio (C/A)"].value == pytest.approx(axes[2] / axes[0]) and panel["Shape Classification", "Classification"].text == a["shape"].replace("-", " ")
    assert panel["Wear Analysis", "Max Wear"].severity == ("danger" if a["max_bump"] > 10 else "warning" if a["max_bump"] > 5 else "success")
    text = report.text("cup", rows["cup"].asDict(), prepared.meridians, prepared.points, clusters)
    sections = dict(part.split("\n", 1) for part in text.split("# ")[1:])
    assert list(sections) == ["Summary", "Geodesic Data", "Detailed Geodesic Points", "Anomaly Clusters"]
    assert len(sections["Geodesic Data"].strip().split("\n")) == 1 + PARAMS.meridians
    n = clusters.filter("mesh_id = 'cup'").count()
    assert len(sections["Anomaly Clusters"].strip().split("\n")) == 1 + n
    some = prepared.meridians.filter("mesh_id = 'cup' AND anomaly_count > 0").orderBy("geo_id").limit(20).select("geo_id")
    points = prepared.points.filter("mesh_id = 'cup' AND abs(dev) > 0.5").join(some, "geo_id").count()
    assert len(sections["Detailed Geodesic Points"].strip().split("\n")) == 1 + points
    assert f"radius,{a['radius']:.6f}" in sections["Summary"]
    assert report.first_clusters(clusters, 3).filter("mesh_id = 'cup'").count() == min(n, 3)


def test_a_panel_without_values():
    assert len({(m[0], m[1]) for m in report.PANEL["pure-geodesic"]}) == len(report.PANEL["pure-geodesic"])
