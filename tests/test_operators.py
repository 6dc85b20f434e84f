import heapq
import math
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import geometry as g
from meshloom.operators import cluster, fit, graph, meridian, select, smooth, storage, topology, volume
from meshloom.operators.graph import connected_components, shortest_paths
from meshloom.operators.storage import stored
from meshloom.plans import cup
from meshloom.sources import stl, stl_files


def sheet(spark, n=6, holes=()):
    """A square sheet of 2 n² triangles, some squares left out."""
    v = [("m", i * (n + 1) + j, float(i), float(j), 0.1 * ((i * 7 + j * 3) % 5), 0.0, 0.0, 1.0) for i in range(n + 1) for j in range(n + 1)]
    f = []
    for i in range(n):
        for j in range(n):
            a, b, c, d = i * (n + 1) + j, (i + 1) * (n + 1) + j, (i + 1) * (n + 1) + j + 1, i * (n + 1) + j + 1
            if (i, j) not in holes:
                f += [("m", len(f), a, b, c), ("m", len(f) + 1, a, c, d)]
    return spark.createDataFrame(v, "mesh_id string, vid long, x float, y float, z float, nx float, ny float, nz float"), spark.createDataFrame(f, "mesh_id string, fid long, i0 long, i1 long, i2 long")


def test_components_and_loops(spark):
    _, f = sheet(spark, 6, {(1, 1), (4, 4), (4, 3)})
    loops = topology.boundary_loops(f).collect()
    sizes = {r.loop: (r.n_vertices, r.is_rim) for r in loops}
    assert sorted(sizes.values()) == [(4, False), (6, False), (24, True)]
    two = f.union(f.select(F.lit("m").alias("mesh_id"), F.col("fid") + 1000, *[(F.col(c) + 500) for c in ("i0", "i1", "i2")]).filter("fid > 0").limit(5))
    parts = topology.face_components(two).groupBy("component", "is_largest").count().collect()
    assert sorted(r.is_largest for r in parts)[-1] and sum(r["count"] for r in parts if r.is_largest) == f.count()
    chain = spark.createDataFrame([("a", i, i + 1) for i in range(50)] + [("b", 7, 3)], "mesh_id string, a long, b long")
    got = {(r.mesh_id, r.node): r.component for r in connected_components(chain).collect()}
    assert got == {**{("a", i): 0 for i in range(51)}, ("b", 3): 3, ("b", 7): 3}


def test_shortest_paths_for_any_block_size(spark):
    rng = random.Random(2)
    e = {(rng.randrange(60), rng.randrange(60)): rng.uniform(0.1, 3) for _ in range(150)}
    e |= {(b, a): w for (a, b), w in list(e.items())}
    best, heap = {0: 0.0, 59: 0.0}, [(0.0, 0), (0.0, 59)]
    while heap:
        d, v = heapq.heappop(heap)
        for (a, b), w in e.items():
            if a == v and d + w < best.get(b, 1e9):
                best[b] = d + w
                heapq.heappush(heap, (d + w, b))
    edges = spark.createDataFrame([("m", a, b, w) for (a, b), w in e.items()], "mesh_id string, src long, dst long, w double")
    before = {v: min((a for (a, b), w in e.items() if b == v and a in best and best[a] + w == d), default=None) if d else None for v, d in best.items()}
    for block in (7, 1000):
        got = shortest_paths(edges, spark.createDataFrame([("m", 0), ("m", 59)], "mesh_id string, vid long"), block).collect()
        assert {r.vid: r.dist for r in got} == best
        assert {r.vid: r.pred for r in got} == before


def test_shortest_paths_of_meshes_in_many_blocks(spark):
    rng = random.Random(8)
    links = []
    for mesh, n in (("a", 300), ("b", 40)):  # ids that jump between blocks along every path
        for i in range(n):
            for j in (i + 1, i + 17, i * 7 % n):
                if j < n and i != j:
                    w = rng.choice([1.0, 0.0, rng.random()])
                    links += [(mesh, i * 13 % n, j * 13 % n, w), (mesh, j * 13 % n, i * 13 % n, w)]
    best, heap = {("a", 5): 0.0}, [(0.0, "a", 5)]
    out = {}
    for m, a, b, w in links:
        out.setdefault((m, a), []).append((b, w))
    while heap:
        d, m, v = heapq.heappop(heap)
        for b, w in out.get((m, v), ()) if d == best[m, v] else ():
            if d + w < best.get((m, b), 1e9):
                best[m, b] = d + w
                heapq.heappush(heap, (d + w, m, b))
    edges = spark.createDataFrame(links, "mesh_id string, src long, dst long, w double")
    source = spark.createDataFrame([("a", 5), ("c", 1)], "mesh_id string, vid long")
    got = {(r.mesh_id, r.vid): r.dist for r in shortest_paths(edges, source, 31, predecessors=False).collect()}
    assert got == best | {("c", 1): 0.0}


def test_trim_keeps_what_is_far_from_the_rim(spark):
    v, f = sheet(spark)
    kept = select.trim(f, v, 30).filter("kept").count()
    assert 0 < kept < f.count()
    ball = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 0, 2, 3), ("m", 2, 0, 3, 1), ("m", 3, 1, 3, 2)], f.schema)
    assert select.trim(ball, v, 30).filter("kept").count() == 4


def test_holes_are_filled(spark):
    v, f = sheet(spark, 6, {(1, 1), (4, 4), (4, 3)})
    points, faces = smooth.fill_holes(v, f)
    assert points.count() == v.count() + 2 and faces.count() == f.count() + 10
    assert topology.boundary_edges(faces).count() == 24
    assert points.join(topology.corners(faces), ["mesh_id", "vid"], "left_semi").filter("nz < 0.5").count() == 0


def test_smoothing_matches_numpy(spark):
    v, f = sheet(spark, 4)
    rows = v.orderBy("vid").collect()
    p = np.array([[r.x, r.y, r.z] for r in rows], np.float32)
    near = {i: set() for i in range(len(p))}
    for r in f.collect():
        for a, b in ((r.i0, r.i1), (r.i1, r.i2), (r.i2, r.i0)):
            near[a].add(b)
            near[b].add(a)
    for _ in range(3):
        for k in (0.5, -0.53):
            q = p.astype(float)
            p = np.array([q[i] + k * (q[sorted(near[i])].mean(0) - q[i]) for i in range(len(p))]).astype(np.float32)
    got = np.array([[r.x, r.y, r.z] for r in smooth.taubin(v, f, 3).orderBy("vid").collect()])
    assert np.abs(got - p).max() < 1e-5


def cloud(n, axes, center=(1.0, -2.0, 3.0), noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    d = rng.normal(size=(n, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    d[:, 2] = -np.abs(d[:, 2])
    return d * axes + center + rng.normal(scale=noise, size=(n, 3)) if noise else d * axes + center


def frame_of(spark, p, mesh="m"):
    return spark.createDataFrame([(mesh, *map(float, r)) for r in p], "mesh_id string, x double, y double, z double")


def test_fits(spark):
    p = cloud(300, 16.0)
    r = fit.fit_sphere(frame_of(spark, p)).first()
    assert (r.cx, r.cy, r.cz, r.radius) == pytest.approx((1, -2, 3, 16)) and r.rms < 1e-9
    bad = np.vstack([p, p[:20] + 5])
    r = fit.fit_sphere_robust(frame_of(spark, bad)).first()
    assert r.radius == pytest.approx(16, abs=0.05)
    r = fit.fit_ellipsoid(frame_of(spark, cloud(400, np.array([14.0, 18.0, 16.0])))).first()
    assert r.semi_axes == pytest.approx([14, 16, 18]) and r.sphericity == pytest.approx(100 * 14 / 18) and r["shape"] == "significant-ellipsoid" and r.definite and r.rms < 1e-9
    assert abs(r.directions[0][0]) == pytest.approx(1) and abs(r.directions[2][1]) == pytest.approx(1)
    rows = frame_of(spark, p).select("*", F.lit("worn").alias("zone"), F.lit(16.0).alias("radius"))
    one, many = fit.fit_fixed_radius(rows, 3).first(), fit.fit_fixed_radius(rows, 3, kernel_points=0).first()
    assert (one.cx, one.cy, one.cz, one.rms) == pytest.approx((many.cx, many.cy, many.cz, many.rms), abs=1e-9)
    snapped = spark.createDataFrame([(13.0,), (15.79,), (15.81,), (16.0,), (17.9,), (25.0,), (float("nan"),)], "r double").select(fit.snap_radius(F.col("r")).alias("s")).collect()
    assert [x.s for x in snapped] == [14, 14, 16, 16, 18, 20, 14]


def test_order_statistics(spark):
    rng = random.Random(4)
    rows = [("a", float(rng.choice([1, 2, 2, 3, 9]))) for _ in range(101)] + [("b", rng.random()) for _ in range(40)] + [("c", 5.0)]
    got = {r.mesh_id: (r.lo, r.mid) for r in select.order_statistics(spark.createDataFrame(rows, "mesh_id string, v double"), "v", {"lo": 0.25, "mid": 0.5}).collect()}
    for m in "abc":
        s = sorted(v for k, v in rows if k == m)
        assert got[m] == (s[int(len(s) * 0.25)], s[int(len(s) * 0.5)])


@pytest.mark.parametrize("most", [3, 100_000])
def test_order_statistics_of_uneven_values(spark, most):
    rng = random.Random(9)
    values = {
        "outlier": [rng.random() for _ in range(300)] + [1e308, -1e308], "tied": [2.5] * 400 + [3.0], "equal": [7.0] * 50, "infinite": [float("inf"), float("-inf")] + [rng.gauss(0, 1) for _ in range(60)],
        "steps": [10.0**k for k in range(-30, 30)], "nulls": [None, None, 4.0, None, 1.0], "none": [None],
    }
    rows = spark.createDataFrame([(m, v) for m, vs in values.items() for v in vs], "mesh_id string, v double")
    shares = {"least": 0.0, "lo": 0.25, "mid": 0.5, "hi": 0.99}
    got = {r.mesh_id: [r[k] for k in shares] for r in select.order_statistics(rows, "v", shares, most).collect()}
    want = {m: sorted(v for v in vs if v is not None) for m, vs in values.items()}
    assert got == {m: [vs[int(len(vs) * q)] for q in shares.values()] for m, vs in want.items() if vs}
    assert select.order_statistics(rows.limit(0), "v", shares, most).count() == 0


def test_weld_and_units(spark):
    rows = [("m", 0, k, x, 0.0, 0.0, 0.0, 0.0, 1.0) for k, x in enumerate((-5e-7, 1.0, 2.0))] + [("m", 1, k, x, 0.0, 0.0, 0.0, 1.0, 0.0) for k, x in enumerate((4e-7, 1.0 + 3e-7, 1.0))]
    v, f = topology.weld(spark.createDataFrame(rows, stl.CORNERS))
    assert [(r.i0, r.i1, r.i2) for r in f.orderBy("fid").collect()] == [(0, 1, 2), (0, 1, 1)]
    first = v.filter("vid = 0").first()
    assert first.x == pytest.approx(-5e-7) and first.ny == pytest.approx(2**-0.5)


def grid_soup(n=20, seed=3):
    """Corners of two grids in random order of faces, ids with gaps, corners of one point up to 3e-7 apart; and by mesh the welded points and faces, told one corner at a time."""
    rng, rows, want = random.Random(seed), [], {}
    for m in "ab":
        quads = [[(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)] for i in range(n) for j in range(n)]
        faces = [f for q in quads for f in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))] + [((0, 0), (0, 0), (1, 0))]
        rng.shuffle(faces)
        ids, points, out = {}, [], {}
        for k, face in enumerate(faces):
            for c, ij in enumerate(face):
                x, y, z = (float(np.float32(i / 64 + rng.uniform(-3e-7, 3e-7))) for i in (*ij, -5))
                if ij not in ids:
                    ids[ij] = len(points)
                    points.append((x, y, z))
                rows.append((m, 5 * k + 2, c, x, y, z, 0.0, 0.0, 1.0))
            out[5 * k + 2] = tuple(ids[ij] for ij in face)
        want[m] = (points, out)
    rng.shuffle(rows)
    return rows, want


def test_weld_deals_corners_into_parts_that_do_not_grow(spark, monkeypatch):
    rows, want = grid_soup()
    monkeypatch.setattr(topology, "SPAN", 64)
    monkeypatch.setattr(storage, "ROWS", 100, raising=False)
    seen, store = [], topology.stored
    monkeypatch.setattr(topology, "stored", lambda df: (seen.append(df), store(df))[1])
    v, _ = topology.weld(spark.createDataFrame(rows, stl.CORNERS))
    got = {(r.mesh_id, r.vid): (r.x, r.y, r.z) for r in v.collect()}
    assert got == {(m, k): p for m, (points, _) in want.items() for k, p in enumerate(points)}
    assert all(r.nz == 1 for r in v.select("nz").collect())
    # grouped in a part for each 100 corners, by hashing: no task sorts what it reads
    grouped = [df for df in seen if "seq" in df.columns]
    assert grouped and max(r["count"] for r in grouped[0].groupBy(F.spark_partition_id()).count().collect()) <= 100
    plan = grouped[0]._jdf.queryExecution().executedPlan().toString()
    assert f"{-(-len(rows) // 100)}), REPARTITION_BY_NUM" in plan and "Sort" not in plan


def test_welded_faces_lie_in_parts_that_do_not_grow(spark, monkeypatch):
    rows, want = grid_soup()
    # and a mesh whose corners are all one point: every face is degenerate and stays
    rows += [("dot", k, c, 0.25, 0.25, 0.25, 0.0, 0.0, 1.0) for k in range(300) for c in range(3)]
    monkeypatch.setattr(topology, "SPAN", 64)
    monkeypatch.setattr(storage, "ROWS", 100, raising=False)
    v, f = topology.weld(spark.createDataFrame(rows, stl.CORNERS))
    got = {(r.mesh_id, r.fid): (r.i0, r.i1, r.i2) for r in f.collect()}
    assert got == {(m, k): i for m, (_, faces) in want.items() for k, i in faces.items()} | {("dot", k): (0, 0, 0) for k in range(300)}
    assert [r.vid for r in v.filter("mesh_id = 'dot'").collect()] == [0]
    # a part for each 100 corners has some 33 faces; the session's 8 partitions would have more than 200 each
    assert max(r["count"] for r in f.groupBy(F.spark_partition_id()).count().collect()) <= 100


def test_weld_without_normals(spark):
    rows, want = grid_soup(4)
    v, f = topology.weld(spark.createDataFrame(rows, stl.CORNERS).drop("nx", "ny", "nz"))
    assert v.columns == ["mesh_id", "vid", "x", "y", "z"] and v.count() == sum(len(points) for points, _ in want.values())
    assert {(r.mesh_id, r.fid): (r.i0, r.i1, r.i2) for r in f.collect()} == {(m, k): i for m, (_, faces) in want.items() for k, i in faces.items()}
    v, f = topology.weld(spark.createDataFrame([], stl.CORNERS))
    assert v.count() == f.count() == 0


def facets(n, seed=0):
    out = np.zeros(n, stl.FACET)
    out["corners"] = np.random.default_rng(seed).normal(size=(n, 3, 3)).astype(np.float32)
    out["normal"] = (0, 0, 1)
    return out


def test_stl_formats():
    f = facets(5)
    binary = b"solid but binary".ljust(80) + struct.pack("<I", 5) + f.tobytes()
    text = "solid x\n" + "".join("facet normal 0 0 1\nouter loop\n" + "".join(f"vertex {float(a)!r} {float(b)!r} {float(c)!r}\n" for a, b, c in t) + "endloop\nendfacet\n" for t in f["corners"]) + "endsolid"
    assert not stl.is_ascii(binary) and stl.is_ascii(text.encode())
    for data in (binary, binary + b"longer is fine", text.encode()):
        if data is not binary and data.startswith(b"solid but"):
            data = data.replace(b"solid", b"xolid", 1)
        xyz, normals = stl.parse(data)
        assert np.allclose(xyz, f["corners"]) and np.allclose(normals, f["normal"])
    for bad in (b"", binary[:-1].replace(b"solid", b"xolid", 1), b"x" * 80 + struct.pack("<I", 0), b"solid x\nendsolid"):
        with pytest.raises(stl.StlError):
            stl.parse(bad)
    f["corners"][4, 2, 2] = np.nan
    with pytest.raises(stl.StlError):
        stl.parse(b" " * 80 + struct.pack("<I", 5) + f.tobytes())


def binary(f, title=b"x"):
    return title.ljust(80) + struct.pack("<I", len(f)) + f.tobytes()


def test_stl_lines_that_are_no_points():
    good = "facet normal 0 0 1\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\n"
    assert len(stl.parse(("solid x\n" + good * 2).encode())[0]) == 2
    for bad in (good.replace("1 0 0", "1 O 0"), good.replace("1 0 0", "nan 0 0"), good + "vertex 1 1 1\n"):
        with pytest.raises(stl.StlError):
            stl.parse(("solid x\n" + bad).encode())
    assert not stl.is_ascii(b"SOLID x\n" + good.encode())


@pytest.mark.parametrize("facets_each", [1, 7, 10, 11, 1000])
def test_stl_ranges_end_at_records(spark, tmp_path, facets_each):
    f, h = facets(21), facets(10, 1)
    f["attribute"] = np.arange(21)
    (tmp_path / "a.stl").write_bytes(binary(f))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.STL").write_bytes(binary(h) + b"more")
    text = "solid x\n" + "".join("facet normal 0 0 1\n" + "".join(f"vertex {float(a)!r} {float(b)!r} {float(c)!r}\n" for a, b, c in t) for t in h["corners"])
    (tmp_path / "c.stl").write_text(text)
    (tmp_path / "no.txt").write_text("x")
    spark.dataSource.register(stl_files.StlFiles)
    rows = spark.read.format("stl").option("facets", facets_each).load(str(tmp_path))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][tT][lL]").option("recursiveFileLookup", "true").load(str(tmp_path))
    plain = lambda df: sorted((r.mesh_id.rpartition("/")[2], *r[1:]) for r in df.collect())
    assert plain(rows.drop("attribute")) == plain(stl.decode(files)) == plain(stl.read(spark, f"file://{tmp_path}", facets_each))
    assert [r.attribute for r in rows.filter("mesh_id LIKE '%a.stl' AND corner = 1").orderBy("fid").collect()] == list(range(21))


def test_a_large_stl_file_is_read_by_several_tasks(spark, tmp_path):
    n = 2_000_000
    f = np.zeros(n, stl.FACET)
    f["corners"] = np.arange(n * 9, dtype=np.float32).reshape(n, 3, 3)
    (tmp_path / "big.stl").write_bytes(binary(f))
    rows = stl.read(spark, str(tmp_path / "big.stl"))
    assert rows.rdd.getNumPartitions() == 8
    got = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("fid").alias("lo"), F.max("fid").alias("hi"), F.sum(F.col("x").cast("double")).alias("x")).orderBy("lo").collect()
    assert [(r.lo, r.hi, r.n) for r in got] == [(k, k + 249_999, 750_000) for k in range(0, n, 250_000)]
    assert sum(r.x for r in got) == f["corners"][:, :, 0].astype(float).sum()


def test_stl_ranges_refuse_broken_files(spark, tmp_path):
    f = facets(30)
    f["corners"][25, 2, 2] = np.inf
    for k, data in enumerate((b"short", binary(facets(9))[:-1], binary(facets(0)), binary(f), b"solid x\nendsolid")):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.stl").write_bytes(data)
        with pytest.raises(Exception, match="StlError"):
            stl.read(spark, str(tmp_path / str(k)), 8).collect()


def test_stl_files(spark, tmp_path):
    v, f = sheet(spark, 3)
    two = lambda df: df.unionByName(df.withColumn("mesh_id", F.lit("other/mesh é")))
    v, f = two(v).withColumn("deviation", F.when(F.col("mesh_id") == "m", 50.0).otherwise(0.0)), two(f)
    path = str(tmp_path / "out")
    stl.save(f, v, path, 3)
    stl.save(f, v, path, 3)  # overwrites
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    back_v, back_f = stl.load(stl.read(spark, path))
    assert back_f.count() == f.count()
    done = {r.mesh_id: r.facets for r in stl_files.joined(spark, path, str(tmp_path / "whole")).collect()}
    n = f.filter("mesh_id = 'm'").count()
    assert done == {"m": n, "other/mesh é": n}
    data = (tmp_path / "whole" / "m.stl").read_bytes()
    assert set(np.frombuffer(data, stl.FACET, n, 84)["attribute"]) == {0x8000 | 31 << 10} and len(data) == 84 + 50 * n
    places = {r.vid: (r.x, r.y, r.z) for r in v.filter("mesh_id = 'm'").collect()}
    want = [[places[i] for i in (r.i0, r.i1, r.i2)] for r in f.filter("mesh_id = 'm'").orderBy("fid").collect()]
    assert np.allclose(stl.parse(data)[0], want)
    back_v, back_f = stl.load(stl.read(spark, str(tmp_path / "whole" / "m.stl")))
    assert (back_v.count(), back_f.count()) == (v.filter("mesh_id = 'm'").count(), n)


def test_dbscan_matches_scan_order(spark):
    rng = random.Random(9)
    pts = [(i, *(rng.uniform(0, 3) for _ in range(3)), rng.uniform(2, 9) * rng.choice([1, -1])) for i in range(150)]
    eps = 0.5
    want, base = {}, 0
    for kind in ("bump", "dip"):
        mine = [p for p in pts if (p[4] > 0) == (kind == "bump")]
        near = {p[0]: [q[0] for q in mine if sum((a - b) ** 2 for a, b in zip(p[1:4], q[1:4], strict=True)) <= eps * eps] for p in mine}
        label, noise, k = {}, [], base
        for p in mine:
            if p[0] in label or len(near[p[0]]) < 3:
                continue
            stack = [p[0]]
            while stack:
                j = stack.pop()
                if j not in label:
                    label[j] = k
                    if len(near[j]) >= 3:
                        stack += near[j]
            k += 1
        for p in mine:
            if p[0] not in label and abs(p[4]) > 5:
                label[p[0]] = k
                k += 1
        want |= label
        base = k
    rows = spark.createDataFrame([("m", "bump" if p[4] > 0 else "dip", *p) for p in pts], "mesh_id string, type string, id long, x double, y double, z double, dev double")
    got = {r.id: r.cluster_id for r in cluster.dbscan(rows, eps).collect()}
    assert got == want


def test_dbscan_of_dense_cells(spark):
    rng = random.Random(3)
    ball = lambda n, at, r: [tuple(a + rng.uniform(-r, r) for a in at) for _ in range(n)]
    # 100,000 points in one cell; two slabs just within eps of each other, and one just beyond; a bridge of single points
    pts = ball(100_000, (0.1, 0.1, 0.1), 0.05)
    pts += [(10 + rng.uniform(0, 0.5), rng.uniform(0, 0.5), -rng.uniform(0, 0.2)) for _ in range(4000)] + [(10.25, 0.25, 0.0)]
    pts += [(10 + rng.uniform(0, 0.5), rng.uniform(0, 0.5), 0.5 + rng.uniform(1e-9, 0.2)) for _ in range(4000)] + [(10.25, 0.25, 0.5)]
    pts += [(10 + rng.uniform(0, 0.5), rng.uniform(0, 0.5), 1.2001 + rng.uniform(0, 0.1)) for _ in range(4000)]
    first = {"far": 0, "slab": 100_000, "other": 104_001, "beyond": 108_002}
    pts += [(0.15 + 0.4 * k, 0.1, 0.1) for k in range(1, 5)]
    rows = spark.createDataFrame([("m", "bump", k, *p, 2.0) for k, p in enumerate(pts)], "mesh_id string, type string, id long, x double, y double, z double, dev double")
    got = {r.id: r.cluster_id for r in cluster.dbscan(rows).select("id", "cluster_id").collect()}
    assert len(got) == len(pts) and {got[k] for k in range(100_000)} == {0}
    assert got[first["slab"]] == got[first["other"]] == 1 and got[first["beyond"]] == 2 and set(got.values()) == {0, 1, 2}
    assert [got[len(pts) - 4 + k] for k in range(4)] == [0] * 4


def test_series_and_runs(spark):
    rows = spark.createDataFrame([("g", i, a, v) for i, (a, v) in enumerate([(0.0, 0.0), (1.0, 2.0), (3.0, 3.0), (3.0, 8.0)])], "k string, seq int, arc double, dev double")
    got = meridian.series(rows, ["k"], ["seq"], "arc", "dev").orderBy("seq").collect()
    assert [r.d1 for r in got] == pytest.approx([2, 1, 3, 0]) and [r.d2 for r in got] == pytest.approx([0, 1 / 3, -0.5, 0])
    runs = spark.createDataFrame([("g", i, d) for i, d in enumerate([0.0, 2.0, -3.0, 0.1, 5.0])], "k string, seq int, d2 double")
    assert sorted((r.first, r.last, r.peak) for r in meridian.irregular_runs(runs, ["k"], 1).collect()) == [(1, 2, 2), (4, 4, 4)]
    ids = spark.createDataFrame([("m", i) for i in range(8)], "mesh_id string, geo_id long")
    assert sorted((r.geo_a, r.geo_b) for r in meridian.opposite(ids, 8).collect()) == [(i, i + 4) for i in range(4)]
    assert meridian.opposite(spark.createDataFrame([("m", i) for i in range(7)], "mesh_id string, geo_id long"), 7).count() == 0


def test_polylines_match_a_fold(spark):
    rng = random.Random(6)
    cuts = []
    for geo in range(6):
        for f in range((3, 40, 700, 1, 251, 250)[geo]):
            ends = [[rng.choice([0.0, 1.0, rng.random()]), 0.0, 5.0 - f * 0.01 - k * 0.01] for k in (0, 1)]
            if rng.random() < 0.3:
                ends[1] = [ends[0][0] + 4e-7, 0.0, ends[0][2] - 1e-7]
            cuts.append(("m", geo, f, *ends[0], ends[0][2], *ends[1], ends[1][2]))
    frame = spark.createDataFrame([("m", cuts[0][3], 0.0, 5.0)], "mesh_id string, px double, py double, pz double")
    rows = spark.createDataFrame(cuts, "mesh_id string, geo_id long, fid long, x0 double, y0 double, z0 double, lat0 double, x1 double, y1 double, z1 double, lat1 double")
    got = {}
    for r in meridian.polylines(rows, frame).orderBy("geo_id", "seq").collect():
        got.setdefault(r.geo_id, []).append((r.seq, r.x, r.y, r.z))
    for geo in range(6):
        ends = sorted(((-c[3 + 4 * k + 3], c[2] * 2 + k, c[3 + 4 * k : 6 + 4 * k]) for c in cuts if c[1] == geo for k in (0, 1)))
        line = []
        for _, _, q in ends:
            if not line or sum((a - b) ** 2 for a, b in zip(q, line[-1], strict=True)) > 1e-12:
                line.append(q)
        pole = (cuts[0][3], 0.0, 5.0)
        if sum((a - b) ** 2 for a, b in zip(pole, line[0], strict=True)) > 1e-12:
            line.insert(0, pole)
        if len(line) > 500:
            line = [line[int(k * ((len(line) - 1) / 499) + 0.5)] for k in range(500)]
        assert got[geo] == [(k, *q) for k, q in enumerate(line)], geo


def test_repeats_are_judged_by_the_last_point_kept(spark):
    eps, cuts = 1e-6, []
    for geo, steps in enumerate(([0.6] * 21, [0.6, 0.6, -1.5, 5.0, 0.9, -1.7, 0.3, 0.3, 0.3, 3.0, 0.1], [1.2] * 9 + [0.0] * 4, [2.1, 1.9, 0.2])):
        x = np.cumsum([0.0, *steps, 0.0 if len(steps) % 2 == 0 else 9.0]) * eps  # an even number of points
        x = x[: len(x) // 2 * 2]
        cuts += [("m", geo, k, float(x[2 * k]), 0.0, 0.0, 10.0 - k, float(x[2 * k + 1]), 0.0, 0.0, 9.5 - k) for k in range(len(x) // 2)]
    rows = spark.createDataFrame(cuts, "mesh_id string, geo_id long, fid long, x0 double, y0 double, z0 double, lat0 double, x1 double, y1 double, z1 double, lat1 double")
    frame = spark.createDataFrame([("m", 0.0, 0.0, 5.0)], "mesh_id string, px double, py double, pz double")
    got = {}
    for r in meridian.polylines(rows, frame).orderBy("geo_id", "seq").collect():
        got.setdefault(r.geo_id, []).append(r.x)
    for geo in got:
        line = []
        for c in (c for c in cuts if c[1] == geo):
            for x in (c[3], c[7]):
                if not line or (x - line[-1]) ** 2 > eps * eps:
                    line.append(x)
        assert got[geo] == [0.0, *line], geo


def test_double_profiles_of_all_points(spark, monkeypatch):
    cuts = [("m", geo, f, *(p for k in (0, 1) for p in (geo - 90.0, 0.01 * (2 * f + k) ** 1.5, 20 - 0.01 * (2 * f + k), 20 - 0.01 * (2 * f + k)))) for geo, n in ((0, 700), (180, 400)) for f in range(n)]
    frame = spark.createDataFrame([("m", 0.0, 0.0, 21.0)], "mesh_id string, px double, py double, pz double")
    rows = spark.createDataFrame(cuts, "mesh_id string, geo_id long, fid long, x0 double, y0 double, z0 double, lat0 double, x1 double, y1 double, z1 double, lat1 double")
    lines = stored(meridian.polylines(rows, frame, None).withColumns({"arc": F.col("seq") * 0.5, "dev": F.col("z"), "d1": F.lit(0.0), "d2": F.lit(0.0)}))
    heights = [20 - 0.01 * k for k in range(1400)]
    got = {}
    for r in lines.orderBy("seq").collect():
        got.setdefault(r.geo_id, []).append((r.seq, r.z))
    assert got == {geo: list(enumerate([21.0, *heights[:n]])) for geo, n in ((0, 1400), (180, 800))}
    keys, both = ["mesh_id", "geo_a", "geo_b"], []
    for few in (storage.MESHES, 0):
        monkeypatch.setattr(storage, "MESHES", few)
        series = stored(meridian.double_profiles(lines, meridian.opposite(lines.select("mesh_id", "geo_id").distinct())))
        both.append([tuple(r) for r in meridian.projected(series, keys).select(*keys, "seq", "arc", "z", "u", "v").orderBy("seq").collect()])
    assert [r[2:6] for r in both[0]] == [(180, k, (k - 1400) * 0.5, z) for k, z in enumerate([*heights[::-1], 21.0, *heights[:800]])]
    assert [r[:6] for r in both[0]] == [r[:6] for r in both[1]] and np.allclose([r[6:] for r in both[0]], [r[6:] for r in both[1]])


def test_the_query_of_double_profiles_keeps_meridians_of_many_points(spark, tmp_path):
    import __spark_entry__ as e

    duckdb = pytest.importorskip("duckdb")
    rings = 280
    spark.range(40 * rings).select(F.col("id").alias("p_partkey"), (F.col("id") * 7 % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    got = e.queries()["double_profiles"](spark, str(tmp_path)).orderBy("geo_a", "seq").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(f"SELECT * FROM ({e.oracle_sql()['double_profiles']}) ORDER BY geo_a, seq").fetchall()
    assert [(*r[:3], r.irregular) for r in got] == [(*r[:3], r[7]) for r in want]
    assert np.allclose([r[3:7] for r in got], [r[3:7] for r in want], rtol=0, atol=2e-6)
    # a meridian crosses every ring and, unless it runs along sides of triangles, one side between each two of them
    _, sizes = np.unique([(r.geo_a, r.arc > 0) for r in got if r.arc != 0], axis=0, return_counts=True)
    assert sizes.min() >= rings and np.median(sizes) == 2 * rings


def test_chains_of_loose_segments():
    rng = np.random.default_rng(4)
    th = np.linspace(0, np.pi, 60)
    arc = np.stack([20 * np.cos(th), 20 * np.sin(th)], 1)
    segments = np.stack([arc[:-1], arc[1:]], 1)[rng.permutation(59)]
    turned = rng.random(59) < 0.5
    segments[turned] = segments[turned][:, ::-1]
    (line,) = meridian.chained(segments)
    assert len(line) == 60 and np.allclose(np.sort(line[:, 0]), np.sort(arc[:, 0])) and np.abs(np.diff(line, axis=0)).max() < 2
    # a second piece far away is a chain of its own; one of few points is none
    far = np.stack([arc[:9], arc[1:10]], 1) + 100
    assert [len(x) for x in meridian.chained(np.concatenate([segments, far]))] == [60, 10]
    assert [len(x) for x in meridian.chained(np.concatenate([segments, far[:3]]))] == [60]
    assert meridian.chained(segments[:1]) == [] and meridian.chained(np.zeros((0, 2, 2))) == []


def test_outer_segments_of_a_sphere(spark):
    n, m = 24, 12
    v = [("m", i * n + j, 20 * np.sin(np.pi * (i + 0.5) / m) * np.cos(2 * np.pi * j / n), 20 * np.sin(np.pi * (i + 0.5) / m) * np.sin(2 * np.pi * j / n), -20 * np.cos(np.pi * (i + 0.5) / m)) for i in range(m) for j in range(n)]
    f = [("m", len_, *t) for len_, t in enumerate(t for i in range(m - 1) for j in range(n) for t in ((i * n + j, i * n + (j + 1) % n, i * n + n + j), (i * n + (j + 1) % n, i * n + n + (j + 1) % n, i * n + n + j)))]
    vertices = spark.createDataFrame([tuple(map(lambda x: x.item() if hasattr(x, "item") else x, r)) for r in v], "mesh_id string, vid long, x double, y double, z double")
    faces = spark.createDataFrame(f, "mesh_id string, fid long, i0 long, i1 long, i2 long")
    # a section of an inner half circle in the plane x = 0.1 y, down to 60 degrees from the pole at -z
    way = np.array([0.1, 1.0, 0.0]) / np.sqrt(1.01)
    angles = np.linspace(-np.pi / 3, np.pi / 3, 15)
    points = spark.createDataFrame([("m", 0, k, *map(float, 10 * np.sin(t) * way + np.array([0, 0, -10 * np.cos(t)])), 0.0) for k, t in enumerate(angles)], "mesh_id string, geo_id long, seq int, x double, y double, z double, d2 double")
    center = spark.createDataFrame([("m", 0.0, 0.0, 0.0)], "mesh_id string, cx double, cy double, cz double")
    keys = ["mesh_id", "geo_id"]
    got = meridian.outer_segments(faces, vertices, points, center, keys).collect()
    p = {r[1]: np.array(r[2:], float) for r in v}
    normal, limit, want = np.array([1.0, -0.1, 0.0]), (np.pi / 3) * 1.3 + 0.15, set()
    for _, fid, *c in f:
        cut = []
        for a, b in ((0, 1), (1, 2), (2, 0)):
            s, t = p[c[a]] @ normal, p[c[b]] @ normal
            if s * t < 0:
                q = p[c[a]] + s / (s - t) * (p[c[b]] - p[c[a]])
                if np.arccos(np.clip(-q[2] / np.linalg.norm(q), -1, 1)) <= limit:
                    cut.append(q)
        if len(cut) == 2:
            want.add(fid)
    assert {r.fid for r in got} == want and want
    chains = meridian.outer_chains(meridian.outer_segments(faces, vertices, points, center, keys), keys).collect()
    assert 2 * sum(r.chain == 0 for r in chains) > len(want) and len({(r.chain, r.seq) for r in chains}) == len(chains)


def test_boundary_cap_is_the_hull(spark):
    rng = np.random.default_rng(8)
    p = rng.normal(size=(60, 2))
    corners = set(topology.hull(p).tolist())
    for k in range(60):  # a corner is outside each triangle of other points
        inside = False
        for a in range(60):
            side = [(p[b] - p[a]) @ np.array([-(p[k] - p[a])[1], (p[k] - p[a])[0]]) for b in range(60) if b not in (a, k)]
            if a != k and (min(side) >= 0 or max(side) <= 0):
                inside = True
        assert inside == (k in corners) or k not in corners
    v, f = sheet(spark, 6)
    plane = spark.createDataFrame([("m", 3.0, 3.0, 1.0, 0.0, 0.0, 2.0)], "mesh_id string, qx double, qy double, qz double, nx double, ny double, nz double")
    cap = topology.boundary_cap(f, v, plane).collect()
    area = sum(abs((r.bx - r.ax) * (r.cy - r.ay) - (r.by - r.ay) * (r.cx - r.ax)) / 2 for r in cap)
    assert len(cap) == 4 and area == pytest.approx(36) and all(r.az == r.bz == r.cz == 1 for r in cap)


def test_common_pole_and_display_modes(spark):
    points = spark.createDataFrame([("m", 0, 0, 3.0, 0.0, 0.0, 0.0, 0.0), ("m", 0, 1, 3.0, 4.0, 0.0, 4.0, 2000.0), ("m", 1, 0, 0.0, 4.0, 0.0, 0.0, 1000.0)], "mesh_id string, geo_id long, seq int, x double, y double, z double, arc double, dev double").withColumns({"d1": F.lit(0.0), "d2": F.lit(0.0)})
    frame = spark.createDataFrame([("m", 0.0, 0.0, 0.0)], "mesh_id string, rx double, ry double, rz double")
    got = {(r.geo_id, r.seq): r for r in meridian.common_pole(points, frame).collect()}
    # the deviation at the mean place (1.5, 2), not the mean of the deviations
    assert got[0, 0].dev == pytest.approx(-500) and got[1, 0].dev == pytest.approx(-500) and got[0, 1].arc == pytest.approx(2.5)
    rows = spark.createDataFrame([(0, True), (1, False)], "geo_id long, is_regular boolean")
    assert [meridian.shown(rows, m).count() for m in ("all", "regular", "irregular", "none")] == [2, 1, 1, 0]


def test_the_worn_solid_is_closed_and_as_large_as_its_prisms(spark):
    part = spark.range(400).select(F.col("id").alias("p_partkey"), (F.col("id") * 7 % 50 + 1).cast("int").alias("p_size"))
    import tempfile

    folder = tempfile.mkdtemp()
    part.write.parquet(f"{folder}/part.parquet")
    v, f = (stored(t) for t in cup.cup(spark, folder))
    shell = f.filter(F.col("fid") < 4 * 400)
    sphere = spark.createDataFrame([("cup", 0.0, 0.0, 0.0, 16.3)], "mesh_id string, cx double, cy double, cz double, radius double")  # some faces are worn, others not
    points, faces = volume.wear_mesh(shell, v, sphere)
    rows = faces.collect()
    assert 0 < len({r.fid // 8 for r in rows}) < 1600 and len({r.fid for r in rows}) == len(rows)
    uses = {}
    for r in rows:
        for a, b in ((r.i0, r.i1), (r.i1, r.i2), (r.i2, r.i0)):
            uses[a, b] = uses.get((a, b), 0) + 1
    assert all(uses.get((b, a)) == n for (a, b), n in uses.items()), "each edge runs both ways"
    place = {r.vid: np.array([r.x, r.y, r.z]) for r in points.collect()}
    size = sum(np.dot(place[r.i0], np.cross(place[r.i1], place[r.i2])) for r in rows) / 6
    worn = volume.wear_solid(shell, v, sphere).select("mesh_id", "fid")
    dev = v.withColumn("deviation", (g.length(g.point()) - 16.3) * 1000)
    want = volume.defect_volumes(shell.join(worn, ["mesh_id", "fid"], "left_semi"), dev, sphere, 0.0).first().bump_volume
    assert abs(size) == pytest.approx(want, rel=2e-3)
    prisms = volume.wear_prisms(shell, v, sphere).collect()
    assert len(prisms) == 8 * worn.count() and {r.green for r in prisms} <= {1 - r.share for r in rows}


def test_faces_that_turn_against_each_other_keep_their_walls(spark):
    v = spark.createDataFrame([("m", k, float(x), float(y), 20.0) for k, (x, y) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1), (2, 2)))], "mesh_id string, vid long, x double, y double, z double")
    sphere = spark.createDataFrame([("m", 0.0, 0.0, 0.0, 16.0)], "mesh_id string, cx double, cy double, cz double, radius double")
    for ids in (((0, 1, 2), (1, 2, 3)), ((0, 1, 2), (2, 1, 3), (1, 2, 4)), ((0, 1, 2), (0, 1, 2))):
        f = spark.createDataFrame([("m", k, *t) for k, t in enumerate(ids)], "mesh_id string, fid long, i0 long, i1 long, i2 long")
        uses, rows = {}, volume.wear_mesh(f, v, sphere)[1].collect()
        for r in rows:
            for a, b in ((r.i0, r.i1), (r.i1, r.i2), (r.i2, r.i0)):
                uses[a, b] = uses.get((a, b), 0) + 1
        assert all(uses.get((b, a)) == n for (a, b), n in uses.items()) and len({r.fid for r in rows}) == len(rows)


def test_each_mesh_is_clipped_by_its_own_plane(spark):
    v, f = sheet(spark, 4)
    two = lambda df: df.unionByName(df.withColumn("mesh_id", F.lit("n")))
    planes = spark.createDataFrame([("m", 0.5, 0.0, 0.0, 1.0, 0.0, 0.0), ("n", 1e6, 0.0, 0.0, -1.0, 0.0, 0.0)], "mesh_id string, qx double, qy double, qz double, nx double, ny double, nz double")
    points, faces = topology.clip_mesh(two(f), two(v), planes)
    n = faces.groupBy("mesh_id").count().collect()
    assert {r.mesh_id for r in n} == {"m", "n"} and [r["count"] for r in n if r.mesh_id == "n"] == [f.count()]
    used = {r.vid for r in topology.corners(faces.filter("mesh_id = 'm'")).select("vid").distinct().collect()}
    got = points.filter("mesh_id = 'm'").collect()
    assert used == {r.vid for r in got} == set(range(len(got))) and min(r.x for r in got) == pytest.approx(0.5)
    # a cut is one vertex for the faces on both sides of its edge
    assert len({(round(r.x, 9), round(r.y, 9), round(r.z, 9)) for r in got}) == len(got)


def test_small_operators(spark):
    edges = spark.createDataFrame([("m", 1, 2, 0.5), ("m", 1, 3, 2.0), ("m", 2, 1, 0.5)], "mesh_id string, src long, dst long, w double")
    assert sorted((r.vid, r.w) for r in topology.neighbours(edges, 1).collect()) == [(2, 0.5), (3, 2.0)]
    v = spark.createDataFrame([("m", 0, 1.0, 2.0, 3.0), ("m", 1, 3.0, 2.0, -3.0), ("n", 0, 5.0, 5.0, 5.0)], "mesh_id string, vid long, x float, y float, z float")
    assert sorted(tuple(r) for r in topology.centred(v).collect()) == [("m", 0, -1, 0, 3), ("m", 1, 1, 0, -3), ("n", 0, 0, 0, 0)]
    lines = spark.createDataFrame([("m", k, 4.0 * k) for k in range(90)], "mesh_id string, geo_id long, angle double")
    assert sorted(r.geo_id for r in meridian.nearest_angle(lines, 8.3, 100.0, 355.0).collect()) == [2, 25]
    values = spark.createDataFrame([(d,) for d in (0.5, -1.5, 3.0, 1.0)], "d2 double")
    assert [r.s for r in values.select(meridian.severity(F.col("d2"), 1.0).alias("s")).collect()] == [None, 0.5, 1.0, None]
    clusters = spark.createDataFrame([("m", 0, "bump", 5.0), ("m", 1, "bump", 9.0), ("m", 2, "bump", 9.0), ("m", 3, "dip", 20.0), ("n", 0, "dip", 1.0)], "mesh_id string, cluster_id int, type string, max_dev double")
    assert [(r.mesh_id, r.cluster_id) for r in cluster.primary_zone(clusters).collect()] == [("m", 1)]
    flat = spark.createDataFrame([("m", 0, 0.0, 5.0), ("m", 0, 10.0, 5.0)], "mesh_id string, geo_id long, u double, v double")
    r = meridian.padded_bounds(flat, ["mesh_id", "geo_id"]).first()
    assert (r.min_u, r.max_u, r.min_v, r.max_v) == pytest.approx((-1.0, 11.0, 4.9, 5.1))
    ring = meridian.circle(spark.createDataFrame([("m", 1.0, 2.0, 3.0)], "mesh_id string, cu double, cv double, radius double"), 8).orderBy("k").collect()
    assert len(ring) == 9 and all((r.u - 1) ** 2 + (r.v - 2) ** 2 == pytest.approx(9) for r in ring) and (ring[0].u, ring[2].v) == pytest.approx((4, 5)) and ring[8].u == pytest.approx(ring[0].u)


def test_repair_fills_and_smooths(spark):
    v, f = sheet(spark, 7, {(3, 3)})
    v, f = stored(v), stored(f)
    points, faces = smooth.repair(v, f, 1)
    assert faces.count() == f.count() + 4 and topology.boundary_loops(faces).select("loop").distinct().count() == 1
    bent = lambda p: p.agg(F.stddev("z")).first()[0]
    assert points.count() == v.count() + 1 and bent(points) < bent(v)


@pytest.mark.parametrize("shift", [(0.13, 0.29), (0.0, 0.0), (0.5, 0.5), (0.5, 0.0)])
def test_segments_of_faces_about_the_axis(spark, shift):
    """The axis meets a face, a vertex, a diagonal or a side: all planes tried on all faces give the same segments."""
    side, count = 7, 36
    xy = [(k % side - 3 + shift[0], k // side - 3 + shift[1]) for k in range(side * side)]
    points = [(x, y, -10 + 0.1 * (x * x + y * y)) for x, y in xy]
    quads = [r * side + c for r in range(side - 1) for c in range(side - 1)]
    faces = [t for q in quads for t in ((q, q + 1, q + side + 1), (q, q + side + 1, q + side))]
    v = spark.createDataFrame([("m", k, *p) for k, p in enumerate(points)], "mesh_id string, vid long, x double, y double, z double")
    f = spark.createDataFrame([("m", k, *t) for k, t in enumerate(faces)], "mesh_id string, fid long, i0 long, i1 long, i2 long")
    frame = spark.createDataFrame([("m", 0.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, -10.0)], "mesh_id string, " + ", ".join(f"{k}{c} double" for k in "rap" for c in "xyz"))
    want, unsure = {}, set()  # the side of a cut whose middle is on the axis is not defined
    for fid, t in enumerate(faces):
        for k in range(count):
            a = 2 * math.pi * k / count
            corners = [np.array(points[i]) for i in t]
            s = [p[1] * math.sin(a) - p[0] * math.cos(a) for p in corners]
            cut = []
            for i in range(3):
                j = (i + 1) % 3
                if s[i] * s[j] < 0:
                    cut.append(corners[i] + s[i] / (s[i] - s[j]) * (corners[j] - corners[i]))
                elif abs(s[i]) < 1e-10:
                    cut.append(corners[i])
            if len(cut) >= 2:
                middle = (cut[0] + cut[1]) / 2
                off = abs(math.atan2(middle[0], middle[1]) % (2 * math.pi) - a)
                if math.hypot(middle[0], middle[1]) < 1e-6:
                    unsure.add((fid, k))
                elif min(off, 2 * math.pi - off) < math.pi / 2:
                    want[fid, k] = (*cut[0], *cut[1])
    got = {(r.fid, r.geo_id): (r.x0, r.y0, r.z0, r.x1, r.y1, r.z1) for r in meridian.segments(f, v, frame, count).collect()}
    assert set(got) - unsure == set(want) and len(want) > 100
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_components_in_many_chunks(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(m, rng.randrange(400), rng.randrange(400)) for m in ("m", "n") for _ in range(260)] + [("o", k, k + 1) for k in range(300)] + [("p", 0, k) for k in range(1, 200)]
    want = {}
    for m in "mnop":
        root = {x: x for t in pairs if t[0] == m and t[1] != t[2] for x in t[1:]}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for n, a, b in pairs:
            if n == m and a != b:
                lo, hi = sorted((top(a), top(b)))
                root[hi] = lo
        want |= {(m, x): top(x) for x in root}
    edges = spark.createDataFrame(pairs, "mesh_id string, a long, b long")
    for span, wider in ((16, 4), (16, 1), (1 << 17, 64)):  # a graph that does not shrink is left to the rounds of stars
        monkeypatch.setattr(graph, "SPAN", span)
        monkeypatch.setattr(graph, "WIDER", wider)
        monkeypatch.setattr(graph, "CHUNK", 10 if span == 16 else 1_000_000)
        rows = connected_components(edges).collect()
        assert {(r.mesh_id, r.node): r.component for r in rows} == want and len(rows) == len(want)


def test_long_sections_are_chained_in_linear_time():
    at = np.linspace(0, 1.6, 40_001)
    line = np.stack([np.cos(at), np.sin(at)], 1) * 22
    ends = np.stack([line[:-1], line[1:]], 1)[np.random.default_rng(1).permutation(40_000)]
    began = time.time()
    (got,) = meridian.chained(ends)
    assert len(got) == 40_001 and time.time() - began < 30
    assert np.allclose(got if got[0, 0] > got[-1, 0] else got[::-1], line)


def test_points_kept_of_a_close_run():
    x = [0.0, 0.4, 0.9, 1.3, 1.5, 5.0, 5.2, 6.1, 6.3, 7.4]
    xyz = np.stack([np.array(x), np.zeros(10), np.zeros(10)], 1)
    assert np.array(x)[meridian._kept(xyz, 1.0)].tolist() == [0.0, 1.3, 5.0, 6.1, 7.4]
    assert meridian._kept(xyz[:0], 1.0).tolist() == [] and meridian._kept(xyz[:1], 1.0).tolist() == [True]
