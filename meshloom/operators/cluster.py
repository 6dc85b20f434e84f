"""Anomalous points and their density clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.functions import geometry as g
from meshloom.operators.graph import connected_components
from meshloom.operators.storage import stored

EPS, MIN_POINTS, NOISE = 0.5, 3, 5.0


def vertex_deviations(vertices: DataFrame, sphere: DataFrame) -> DataFrame:
    """vertices with deviation: micrometres beyond the fitted sphere, as a float."""
    from meshloom.operators.fit import residual
    from meshloom.operators.storage import with_mesh

    return with_mesh(vertices, sphere.select("mesh_id", "cx", "cy", "cz", "radius")).select(*vertices.columns, (residual() * 1000).cast("float").alias("deviation"))


def deviation_statistics(points: DataFrame, value: str = "deviation", threshold: float = 1.0) -> DataFrame:
    """Greatest bump (0 at least), deepest dip (0 at most), mean, population deviation, and the share within the threshold in percent."""
    v = F.col(value).cast("double")
    return points.groupBy("mesh_id").agg(F.greatest(F.max(v), F.lit(0.0)).alias("max_bump"), F.least(F.min(v), F.lit(0.0)).alias("max_dip"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), (F.count_if(F.abs(v) <= threshold) / F.count("*") * 100).alias("within_percent"))


def anomalies(points: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Profile points beyond the threshold, one for each position to four decimals: the first by meridian and place; type by sign."""
    key = [F.format_string("%.4f", F.col(c)) for c in "xyz"]
    w = W.partitionBy("mesh_id", *key).orderBy("geo_id", "seq")
    rows = points.filter(F.abs("dev") > threshold).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return rows.withColumn("type", F.when(F.col("dev") > 0, "bump").otherwise("dip"))


def near_pairs(points: DataFrame, keys: list[str], eps: float = EPS, others: DataFrame | None = None) -> DataFrame:
    """(keys, a, b) of points (id, x, y, z), b among ``others``, no farther apart than eps, themselves included: an equi-join of cells with their 27 neighbours, then the distance."""
    cell = [F.floor(F.col(c) / eps).alias(f"k{c}") for c in "xyz"]
    left = points.select(*keys, F.col("id").alias("a"), *[F.col(c).alias(f"{c}a") for c in "xyz"], *cell)
    shift = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = (points if others is None else others).select(*keys, F.col("id").alias("b"), *[F.col(c).alias(f"{c}b") for c in "xyz"], *cell)
    for c in "xyz":
        right = right.select("*", F.explode(shift).alias("_s")).withColumn(f"k{c}", F.col(f"k{c}") + F.col("_s")).drop("_s")
    d = g.distance(tuple(F.col(f"{c}a") for c in "xyz"), tuple(F.col(f"{c}b") for c in "xyz"))
    return left.join(right, [*keys, "kx", "ky", "kz"]).filter(d <= eps).select(*keys, "a", "b")


CELL = ("_i", "_j", "_k")
#: Pairs of points for each point that open pairs of cells may hold, to be tested as points; and halvings of cells at most before that.
PAIRS, HALVINGS = 16, 12


def _boxes(points: DataFrame, by: list[str]) -> DataFrame:
    """Count, extent and first point of each cell."""
    first = F.min(F.struct("id", *"xyz"))
    return points.groupBy(*by).agg(F.count("*").alias("n"), first.alias("p"), *[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])


def _sided(cells: DataFrame, side: str, keys: list[str]) -> DataFrame:
    return cells.select(*[c if c in keys else F.col(c).alias(f"{c}{side}") for c in cells.columns])


def _apart(eps: float) -> tuple[Column, Column]:
    """(some points of two cells a and b surely lie within eps, some may): by their first points and extents."""
    far = [F.greatest(F.col(f"hi{c}a") - F.col(f"lo{c}b"), F.col(f"hi{c}b") - F.col(f"lo{c}a")) for c in "xyz"]
    near = [F.greatest(F.lit(0.0), F.col(f"lo{c}a") - F.col(f"hi{c}b"), F.col(f"lo{c}b") - F.col(f"hi{c}a")) for c in "xyz"]
    first = g.distance(tuple(F.col(f"pa.{c}") for c in "xyz"), tuple(F.col(f"pb.{c}") for c in "xyz"))
    return (first <= eps) | (g.length(far) <= eps), g.length(near) <= eps


def _dense_links(points: DataFrame, cells: DataFrame, keys: list[str], eps: float, side: float) -> DataFrame:
    """(keys, a, b), stored: links between the nodes of dense ``cells`` that join all whose points come within eps of each other.

    Cells are compared, not points: by one point and the extent of each. Pairs that this leaves open, and that other links do not join, are
    halved again and again, until few points are left in them, which are compared.
    """
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    shifts = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(s, CELL, strict=True)]) for s in steps])
    left = _sided(cells, "a", keys).select("*", F.explode(shifts).alias("s"))
    left = left.select("*", *[(F.col(f"{c}a") + F.col(f"s.{c}")).alias(f"{c}b") for c in CELL]).drop("s")
    sure, may = _apart(eps)
    pairs = left.join(_sided(cells, "b", keys), [*keys, *[f"{c}b" for c in CELL]]).withColumn("sure", sure).filter(F.col("sure") | may)
    pairs = stored(pairs.select(*keys, *[f"{c}{s}" for s in "ab" for c in (*CELL, "n", "node")], "sure"))
    links = pairs.filter("sure").select(*keys, F.col("nodea").alias("a"), F.col("nodeb").alias("b"))
    open_ = pairs.filter("NOT sure")
    if open_.limit(1).count() == 0:
        return links
    # pairs that other links join already need no test
    joined = _components(links, keys)
    for s in "ab":
        open_ = open_.join(joined.select(*keys, F.col("id").alias(f"node{s}"), F.col("seed").alias(f"seed{s}")), [*keys, f"node{s}"], "left")
    open_ = stored(open_.filter(F.coalesce("seeda", "nodea") != F.coalesce("seedb", "nodeb")).drop("seeda", "seedb", "sure"))
    total, level = points.count(), 0
    cell = list(CELL)
    while True:
        count, work = open_.agg(F.count("*"), F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0))).first()
        if not count:
            return links
        if work <= PAIRS * total or level == HALVINGS:
            break
        # the halves of the cells of open pairs
        level += 1
        inside = open_.select(*keys, *[F.col(f"{c}a").alias(c) for c in cell]).union(open_.select(*keys, *[F.col(f"{c}b") for c in cell])).distinct()
        half = [F.floor(F.col(c) / (side / 2**level)).alias(f"{n}{level}") for c, n in zip("xyz", CELL, strict=True)]
        finer = [f"{c}{level}" for c in CELL]
        placed = points.withColumns({f"{n}{k}": F.floor(F.col(c) / (side / 2**k)) for k in range(1, level) for c, n in zip("xyz", CELL, strict=True)}).select("*", *half)
        boxes = stored(_boxes(placed.join(inside, [*keys, *cell], "left_semi"), [*keys, *cell, *finer]))
        rows = open_.select(*keys, *[f"{c}{s}" for s in "ab" for c in (*cell, "node")])
        for s in "ab":
            rows = rows.join(_sided(boxes, s, keys), [*keys, *[f"{c}{s}" for c in cell]])
        rows = stored(rows.withColumn("sure", sure).filter(F.col("sure") | may).select(*keys, *[f"{c}{s}" for s in "ab" for c in (*finer, "n", "node")], "sure"))
        more = stored(rows.filter("sure").select(*keys, F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct())
        links = links.unionByName(more)
        open_ = rows.filter("NOT sure").drop("sure").join(more.select(*keys, F.col("a").alias("nodea"), F.col("b").alias("nodeb")), [*keys, "nodea", "nodeb"], "left_anti")
        open_, cell = stored(open_), finer
    if level:
        points = points.withColumns({f"{n}{level}": F.floor(F.col(c) / (side / 2**level)) for c, n in zip("xyz", CELL, strict=True)})
    rows = open_.select(*keys, *[f"{c}{s}" for s in "ab" for c in (*cell, "node")])
    for s in "ab":
        rows = rows.join(points.select(*keys, *[F.col(c).alias(f"{c}{s}") for c in (*cell, *"xyz")]), [*keys, *[f"{c}{s}" for c in cell]])
    met = rows.filter(g.distance(tuple(F.col(f"{c}a") for c in "xyz"), tuple(F.col(f"{c}b") for c in "xyz")) <= eps)
    return links.unionByName(stored(met.select(*keys, F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()))


def _components(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, seed) of the graphs of each mesh and type: the pair is the graph's name."""
    found = connected_components(links.select(F.to_json(F.struct(*keys)).alias("mesh_id"), "a", "b"))
    name = F.from_json("mesh_id", ", ".join(f"{k} string" for k in keys))
    return found.select(*[name[k].alias(k) for k in keys], F.col("node").alias("id"), F.col("component").alias("seed"))


def dbscan(points: DataFrame, eps: float = EPS, min_points: int = MIN_POINTS, noise: float = NOISE) -> DataFrame:
    """points (mesh_id, type, id, x, y, z, dev) with cluster_id: dense regions, bumps first, then dips, each in order of their first core point.

    A point is core with min_points neighbours, itself included. Other points join the earliest cluster with a core point
    in reach. A point in no cluster is one of its own if |dev| exceeds ``noise``, numbered after the type's dense clusters; else it is left out.

    Points fall into cells so small that those of a cell are neighbours: in a cell of min_points all are core and of one cluster, and stand as one
    node. Only points of the other cells, of which a cell has fewer than min_points, are compared with their neighbours.
    """
    keys = ["mesh_id", "type"]
    side, columns = eps / math.sqrt(3) * (1 - 1e-9), points.columns
    place = [*keys, *CELL]
    points = stored(points.select("*", *[F.floor(F.col(c) / side).alias(n) for c, n in zip("xyz", CELL, strict=True)]))
    cells = stored(_boxes(points, place))
    dense = stored(cells.filter(F.col("n") >= min_points).withColumn("node", F.col("p.id")))
    sparse = stored(points.join(cells.filter(F.col("n") < min_points).select(*place), place, "left_semi"))
    near = stored(near_pairs(points, keys, eps, sparse))
    enough = near.groupBy(*keys, F.col("b").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_points).select(*keys, "id")
    some = stored(sparse.select(*place, "id").join(enough, [*keys, "id"]))
    nodes = dense.select(*place, "node").unionByName(some.groupBy(*place).agg(F.min("id").alias("node")))
    core = points.select(*place, "id").join(dense.select(*place), place, "left_semi").unionByName(some.select(*place, "id"))
    core = stored(core.join(nodes, place).select(*keys, "id", "node"))
    reach = stored(near.join(core.withColumnRenamed("id", "a"), [*keys, "a"]).select(*keys, F.col("b").alias("id"), "node").distinct())
    links = reach.join(core.withColumnRenamed("node", "a"), [*keys, "id"]).select(*keys, "a", F.col("node").alias("b")).unionByName(_dense_links(points, dense, keys, eps, side))
    seeds = stored(_components(links.filter("a <> b").distinct(), keys).withColumnRenamed("id", "node"))
    seeded = lambda rows: rows.join(seeds, [*keys, "node"], "left").withColumn("seed", F.coalesce("seed", "node"))
    # core points have the seed of their node, others the least of those in reach
    labels = seeded(core).select(*keys, "id", "seed").unionByName(seeded(reach).select(*keys, "id", "seed")).groupBy(*keys, "id").agg(F.min("seed").alias("seed"))
    rows = points.drop(*CELL).join(labels, [*keys, "id"], "left")
    alone = F.col("seed").isNull()
    rows = stored(rows.withColumn("late", alone.cast("int")).withColumn("seed", F.coalesce("seed", "id")).filter((F.col("late") == 0) | (F.abs("dev") > noise)))
    order = rows.select(*keys, "late", "seed").distinct()
    ids = order.withColumn("cluster_id", F.row_number().over(W.partitionBy("mesh_id").orderBy("type", "late", "seed")) - 1)  # one row for each cluster
    return rows.join(ids, [*keys, "late", "seed"]).select(*columns, "cluster_id")


def cluster_summaries(members: DataFrame) -> DataFrame:
    """Centroid, extremes and mean of dev, the point of greatest |dev| (first of equal ones), and the area of the disc around the centroid that holds all."""
    center = members.groupBy("mesh_id", "cluster_id").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    far = members.join(center, ["mesh_id", "cluster_id"]).withColumn("r", g.distance(g.point(), (F.col("cx"), F.col("cy"), F.col("cz"))))
    best = F.min(F.struct((-F.abs("dev")).alias("h"), F.col("id"), F.struct("x", "y", "z").alias("p")))["p"]
    return far.groupBy("mesh_id", "cluster_id", "type", "cx", "cy", "cz").agg(F.count("*").alias("n_points"), (F.max("r") * F.max("r") * math.pi).alias("area"), F.avg("dev").alias("avg_dev"), F.max("dev").alias("max_dev"), F.min("dev").alias("min_dev"), best.alias("max_pt"))


def primary_zone(clusters: DataFrame) -> DataFrame:
    """The bump cluster of each mesh with the greatest deviation, the first of equal ones."""
    best = clusters.filter("type = 'bump'").groupBy("mesh_id").agg(F.max(F.struct(F.col("max_dev"), (-F.col("cluster_id")).alias("o"))).alias("m"))
    return clusters.join(best.select("mesh_id", (-F.col("m.o")).alias("cluster_id")), ["mesh_id", "cluster_id"])
