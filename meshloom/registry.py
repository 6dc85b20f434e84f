"""All queries over the given tables and the DuckDB SQL that gives the same rows.

Mesh queries run on the cup that Spark derives from ``part``; the others on ``lineitem``, ``events`` and
``embeddings``. Doubles are rounded to six decimals in both.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.functions import geometry as g
from meshloom.operators import cluster, fit, graph, meridian, select, smooth, topology, volume
from meshloom.operators.storage import parts_of, shared_path, stored, with_mesh
from meshloom.plans import analysis, cup, report
from meshloom.sources import stl, stl_files

FLAGSHIP = "sphere_fit_deviation_by_ring"
QUERIES: dict = {}
ORACLES: dict = {}


def _query(oracle: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = oracle
        return f

    return add


def _on_cup(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([cup.ORACLE, *ctes]) + "\n" + body


def _r(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 6) + F.lit(0.0)).alias(name or str(c))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_r(c) if t == "double" else F.round(F.col(c).cast("double"), 6).alias(c) if t == "float" else F.col(c) for c, t in df.dtypes if c != "mesh_id"])


def _cup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces, faces of the inner shell)."""
    v, f = (stored(t) for t in cup.cup(spark, sf_dir))
    return v, f, f.filter(F.col("fid") < 2 * (v.count() - 2))


def _sphere(v: DataFrame, radius: float = 16.0) -> DataFrame:
    return v.select("mesh_id").distinct().select("mesh_id", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("cz"), F.lit(radius).alias("radius"))


def _frame(v: DataFrame) -> DataFrame:
    """The cup's own frame: rim centre at the origin, pole below, rim plane a millimetre under it."""
    values = {"rx": 0, "ry": 0, "rz": 0, "px": 0, "py": 0, "pz": -16.05, "ax": 0, "ay": 0, "az": -1, "qx": 0, "qy": 0, "qz": -1, "nx": 0, "ny": 0, "nz": -1}
    return v.select("mesh_id").distinct().select("mesh_id", *[F.lit(float(x)).alias(k) for k, x in values.items()])


SHELL = "fs AS MATERIALIZED (SELECT f.* FROM f, n WHERE fid < 4 * np), vs AS MATERIALIZED (SELECT * FROM v, n WHERE vid <= np)"
G = "t AS MATERIALIZED (SELECT fid, i0, i1, i2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM {f} JOIN v a ON a.vid = i0 JOIN v b ON b.vid = i1 JOIN v c ON c.vid = i2)"
GALL, GSHELL = G.format(f="f"), G.format(f="fs")
#: Cross product of two sides, for tables with x0 .. z2.
CROSS = """((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0)) AS kx, ((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0)) AS ky, ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS kz"""
R6 = "ROUND({0}, 6) + 0.0 AS {1}"


def r6(e: str, name: str) -> str:
    return R6.format(e, name)


@_query(_on_cup("SELECT vid, x, y, z FROM v"))
def cup_vertices(spark, sf_dir):
    return cup.cup(spark, sf_dir)[0].select("vid", *[F.col(c).cast("double").alias(c) for c in "xyz"])


@_query(_on_cup("SELECT * FROM f"))
def cup_faces(spark, sf_dir):
    return cup.cup(spark, sf_dir)[1].select("fid", "i0", "i1", "i2")


FIT = """
fc AS (SELECT COUNT(*) AS c, AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz FROM vs),
fu AS (SELECT x-mx AS u, y-my AS w, z-mz AS s, (x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz) AS q FROM vs, fc),
fm AS (SELECT SUM(u*u) AS a, SUM(u*w) AS b, SUM(u*s) AS e, SUM(w*w) AS d, SUM(w*s) AS h, SUM(s*s) AS k, SUM(u*q) AS p, SUM(w*q) AS r, SUM(s*q) AS o, AVG(q) AS m FROM fu),
fd AS (SELECT *, a*(d*k-h*h)-b*(b*k-h*e)+e*(b*h-d*e) AS det FROM fm),
fx AS (SELECT m, (p*(d*k-h*h)-b*(r*k-h*o)+e*(r*h-d*o))/det AS a1, (a*(r*k-o*h)-p*(b*k-h*e)+e*(b*o-r*e))/det AS a2, (a*(d*o-h*r)-b*(b*o-r*e)+p*(b*h-d*e))/det AS a3 FROM fd),
sp AS (SELECT mx+a1/2 AS cx, my+a2/2 AS cy, mz+a3/2 AS cz, SQRT(m+(a1*a1+a2*a2+a3*a3)/4) AS radius FROM fx, fc),
rs AS (SELECT vid, SQRT((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))-radius AS e FROM vs, sp)"""


@_query(_on_cup(f"SELECT {r6('cx', 'cx')}, {r6('cy', 'cy')}, {r6('cz', 'cz')}, {r6('radius', 'radius')}, {r6('(SELECT SQRT(AVG(e*e)) FROM rs)', 'rms')}, {r6('(SELECT MAX(ABS(e)) FROM rs)', 'max_residual')} FROM sp", SHELL, FIT))
def sphere_fit(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    return _rounded(fit.fit_sphere(topology.used_vertices(v, shell)))


@_query(_on_cup(f"""SELECT CASE WHEN vid = 0 THEN -1 ELSE (vid-1)//40 END AS ring, COUNT(*) AS n, {r6('AVG(e*1000)', 'mean_dev')}, {r6('MAX(e*1000)', 'max_dev')}, COUNT(*) FILTER (e > 0.02*radius) AS worn FROM rs, sp GROUP BY 1""", SHELL, FIT))
def sphere_fit_deviation_by_ring(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    points = stored(topology.used_vertices(v, shell))
    rows = fit.with_mesh(points, fit.fit_sphere(points)).withColumn("e", fit.residual())
    ring = F.when(F.col("vid") == 0, F.lit(-1).cast("long")).otherwise(F.floor((F.col("vid") - 1) / 40))
    return rows.groupBy(ring.alias("ring")).agg(F.count("*").alias("n"), _r(F.avg(F.col("e") * 1000), "mean_dev"), _r(F.max(F.col("e") * 1000), "max_dev"), F.count_if(F.col("e") > 0.02 * F.col("radius")).alias("worn"))


@_query(_on_cup(f"""SELECT fid, {r6('SQRT(kx*kx+ky*ky+kz*kz)/2', 'area')}, {r6('kx/SQRT(kx*kx+ky*ky+kz*kz)', 'nx')}, {r6('ky/SQRT(kx*kx+ky*ky+kz*kz)', 'ny')}, {r6('kz/SQRT(kx*kx+ky*ky+kz*kz)', 'nz')},
  {r6('(x0*(y1*z2-z1*y2)+y0*(z1*x2-x1*z2)+z0*(x1*y2-y1*x2))/6', 'volume')} FROM (SELECT *, {CROSS} FROM t)""", GALL))
def face_geometry(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    a, b, c = topology.corner_points()
    n = g.face_normal(a, b, c)
    return topology.gather(f, v).select("fid", _r(g.triangle_area(a, b, c), "area"), _r(n[0], "nx"), _r(n[1], "ny"), _r(n[2], "nz"), _r(g.origin_tetra_volume(a, b, c), "volume"))


RGB = """32768 | (CASE WHEN e < -1 THEN CAST(FLOOR(5*(1-t)+0.5) AS BIGINT) WHEN e > 1 THEN CAST(FLOOR(20+11*t+0.5) AS BIGINT) ELSE 8 END << 10)
  | (CASE WHEN e < -1 THEN CAST(FLOOR(2*(1-t)+0.5) AS BIGINT) WHEN e > 1 THEN CAST(FLOOR(10*(1-t)+0.5) AS BIGINT) ELSE 20 END << 5)
  | CASE WHEN e < -1 THEN CAST(FLOOR(15+16*t+0.5) AS BIGINT) WHEN e > 1 THEN CAST(FLOOR(3*(1-t)+0.5) AS BIGINT) ELSE 8 END"""


@_query(_on_cup(f"""SELECT vid, {r6('ACOS(GREATEST(-1, LEAST(1, z/r)))', 'lat')}, {r6('CASE WHEN ATAN2(0.0, x) < 0 THEN ATAN2(0.0, x)+2*PI() ELSE ATAN2(0.0, x) END', 'lon')}, {r6('r', 'r')},
  {r6('x*16/r', 'sx')}, {r6('y*16/r', 'sy')}, {r6('z*16/r', 'sz')}, {r6('-(z+1)', 'plane')}, CAST(LEAST(511, FLOOR((GREATEST(-100, LEAST(500, e))+100)/600*512+0.5)) AS INTEGER) AS bucket,
  CAST({RGB} AS INTEGER) AS rgb, {r6('CASE WHEN e/500 < -0.01 THEN 0.15+0.05*LEAST(1, ABS(e/500)) WHEN e/500 > 0.01 THEN 0.8+0.2*LEAST(1, ABS(e/500)) ELSE 0.3 END', 'red')},
  {r6("POWER(10.0, FLOOR(LOG10(r*7))) * CASE WHEN r*7/POWER(10.0, FLOOR(LOG10(r*7))) <= 1 THEN 1 WHEN r*7/POWER(10.0, FLOOR(LOG10(r*7))) <= 2 THEN 2 WHEN r*7/POWER(10.0, FLOOR(LOG10(r*7))) <= 5 THEN 5 ELSE 10 END", 'axis_step')},
  {r6('CASE WHEN 16 - (z+1) <= 0 THEN 0 WHEN 16-(z+1) >= 32 THEN 4.0/3*PI()*4096 ELSE PI()/3*(16-(z+1))*(16-(z+1))*(48-(16-(z+1))) END', 'cap')}
  FROM (SELECT *, LEAST(1.0, ABS(e)/50) AS t FROM (SELECT *, SQRT(x*x+y*y+z*z) AS r, (SQRT(x*x+y*y+z*z)-16)*1000 AS e FROM v))"""))
def vertex_scalars(spark, sf_dir):
    v, _, _ = _cup(spark, sf_dir)
    p, zero, axis = g.point(), g.literal((0, 0, 0)), g.literal((0, 0, 1))
    lat, _, r = g.spherical(p, zero, axis)
    # the longitude about z has no component along y in the projection's x, z plane
    lon = g.spherical((p[0], p[1], F.lit(0.0)), zero, axis)[1]
    e = (r - 16) * 1000
    s = g.project_onto_sphere(p, zero, F.lit(16.0))
    return v.select(
        "vid", _r(lat, "lat"), _r(lon, "lon"), _r(r, "r"), _r(s[0], "sx"), _r(s[1], "sy"), _r(s[2], "sz"), _r(g.plane_distance(p, g.literal((0, 0, -1)), g.literal((0, 0, -1))), "plane"),
        g.colour_bucket(e, F.lit(-100.0), F.lit(500.0)).alias("bucket"), g.rgb555(e).alias("rgb"), _r(g.diverging_colour(e, F.lit(-100.0), F.lit(500.0))[0], "red"), _r(g.nice_interval(r * 7), "axis_step"),
        _r(g.cap_volume((F.lit(0.0), F.lit(0.0), -(p[2] + 1)), F.lit(16.0), zero, axis), "cap"),
    )


EDGES = "e AS MATERIALIZED (SELECT LEAST(a, b) AS a, GREATEST(a, b) AS b, COUNT(*) AS uses FROM (SELECT i0 AS a, i1 AS b FROM {0} UNION ALL SELECT i1, i2 FROM {0} UNION ALL SELECT i2, i0 FROM {0}) GROUP BY 1, 2)"


@_query(_on_cup(f"SELECT src, dst, {r6('SQRT((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))', 'w')} FROM (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e) JOIN v p ON p.vid = src JOIN v q ON q.vid = dst", EDGES.format("f")))
def adjacency(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    return _rounded(topology.adjacency(f, v))


@_query(_on_cup("SELECT a, b FROM e WHERE uses = 1", SHELL, EDGES.format("fs")))
def boundary_edges(spark, sf_dir):
    return topology.boundary_edges(_cup(spark, sf_dir)[2]).drop("mesh_id")


INNER = f"""
mean AS (SELECT AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz FROM v),
ff AS (SELECT *, SQRT(kx*kx+ky*ky+kz*kz) AS kl, mx-(x0+x1+x2)/3 AS tx, my-(y0+y1+y2)/3 AS ty, mz-(z0+z1+z2)/3 AS tz FROM (SELECT *, {CROSS} FROM t), mean),
fd AS MATERIALIZED (SELECT fid, i0, i1, i2, SQRT(tx*tx+ty*ty+tz*tz) AS distance, (kx*tx+ky*ty+kz*tz)/kl/SQRT(tx*tx+ty*ty+tz*tz) AS facing FROM ff),
q3 AS (SELECT distance AS q FROM (SELECT distance, row_number() OVER (ORDER BY distance) - 1 AS k, COUNT(*) OVER () AS c FROM fd) WHERE k = FLOOR(c*0.75)),
ic AS MATERIALIZED (SELECT fid, i0, i1, i2 FROM fd, q3 WHERE facing > 0.5 AND distance <= q)"""


def _least_axis(source: str, name: str) -> str:
    """CTEs that end in ``name`` (ex, ey, ez): unit eigenvector of the least eigenvalue of c00 .. c22 in ``source``, by the cosine formula and the longest cross product of two rows."""
    crosses = ", ".join(
        f"{{'x': {a}y*{b}z-{a}z*{b}y, 'y': {a}z*{b}x-{a}x*{b}z, 'z': {a}x*{b}y-{a}y*{b}x}}" for a, b in (("r", "s"), ("r", "t"), ("s", "t"))
    )
    return f"""{name}1 AS (SELECT *, (c00+c11+c22)/3 AS q, SQRT(((c00-(c00+c11+c22)/3)**2+(c11-(c00+c11+c22)/3)**2+(c22-(c00+c11+c22)/3)**2+2*(c01*c01+c02*c02+c12*c12))/6) AS p FROM {source}),
{name}2 AS (SELECT *, q+2*p*COS((ACOS(GREATEST(-1, LEAST(1, ((c00-q)*((c11-q)*(c22-q)-c12*c12)-c01*(c01*(c22-q)-c12*c02)+c02*(c01*c12-(c11-q)*c02))/(2*p*p*p))))+2*PI())/3) AS l FROM {name}1),
{name}3 AS (SELECT UNNEST([{crosses}]) AS e FROM (SELECT c00-l AS rx, c01 AS ry, c02 AS rz, c01 AS sx, c11-l AS sy, c12 AS sz, c02 AS tx, c12 AS ty, c22-l AS tz FROM {name}2)),
{name} AS (SELECT e.x/h AS ex, e.y/h AS ey, e.z/h AS ez FROM (SELECT e, SQRT(e.x*e.x+e.y*e.y+e.z*e.z) AS h FROM {name}3 ORDER BY h DESC LIMIT 1))"""


@_query(_on_cup("SELECT * FROM ic", GALL, INNER))
def inner_candidates(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    return select.inner_candidates(f, v).drop("mesh_id")


@_query(_on_cup("""SELECT loop, vid, n_vertices, loop = (SELECT loop FROM s ORDER BY n_vertices DESC, loop LIMIT 1) AS is_rim FROM lp JOIN s USING (loop)""", GALL, INNER, EDGES.format("ic"),
                """bd AS (SELECT a, b FROM e WHERE uses = 1 UNION ALL SELECT b, a FROM e WHERE uses = 1), wk(a, b) AS (SELECT a, b FROM bd UNION SELECT wk.a, bd.b FROM wk JOIN bd ON wk.b = bd.a),
lp AS (SELECT a AS vid, MIN(b) AS loop FROM wk GROUP BY a), s AS (SELECT loop, COUNT(*) AS n_vertices FROM lp GROUP BY loop)"""))
def boundary_loops(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    return topology.boundary_loops(stored(select.inner_candidates(f, v))).drop("mesh_id")


COMPONENTS = """
cd AS MATERIALIZED (SELECT DISTINCT a AS src, b AS dst FROM (SELECT i0 AS a, i1 AS b FROM ic UNION ALL SELECT i1, i0 FROM ic UNION ALL SELECT i1, i2 FROM ic UNION ALL SELECT i2, i1 FROM ic)),
lab(vid, c) USING KEY (vid) AS (SELECT DISTINCT src, src FROM cd UNION SELECT s.dst, MIN(s.c) FROM (SELECT dst, lab.c AS c FROM lab JOIN cd ON src = lab.vid) s JOIN recurring.lab r ON r.vid = s.dst WHERE s.c < r.c GROUP BY s.dst),
cb AS (SELECT c FROM ic JOIN lab ON vid = i0 GROUP BY c ORDER BY COUNT(*) DESC, MIN(fid) LIMIT 1),
inn AS MATERIALIZED (SELECT fid FROM ic JOIN lab ON vid = i0 JOIN cb USING (c)),
us AS (SELECT DISTINCT fid IN (SELECT fid FROM inn) AS mine, UNNEST([i0, i1, i2]) AS vid FROM f),
sw AS (SELECT COALESCE(AVG(d) FILTER (mine), 0) > COALESCE(AVG(d) FILTER (NOT mine), 0) AS swap FROM (SELECT mine, SQRT((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)) AS d FROM us JOIN v USING (vid), mean))"""


@_query(_on_cup("SELECT fid, i0, i1, i2, CASE WHEN (fid IN (SELECT fid FROM inn)) <> swap THEN 'inner' ELSE 'outer' END AS surface FROM f, sw", GALL, INNER, COMPONENTS))
def separated_faces(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    return select.separate(f, v).drop("mesh_id")


@_query(_on_cup("SELECT v.vid, x, y, z FROM v WHERE vid IN (SELECT UNNEST([i0, i1, i2]) FROM ic)", GALL, INNER))
def used_vertices(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    return topology.used_vertices(v, select.inner_candidates(f, v)).select("vid", *[F.col(c).cast("double").alias(c) for c in "xyz"])


@_query(_on_cup("SELECT nf.fid, m0.new AS i0, m1.new AS i1, m2.new AS i2 FROM fs nf JOIN m m0 ON m0.vid = i0 JOIN m m1 ON m1.vid = i1 JOIN m m2 ON m2.vid = i2", SHELL,
                "m AS MATERIALIZED (SELECT vid, row_number() OVER (ORDER BY s) - 1 AS new FROM (SELECT vid, MIN(s) AS s FROM (SELECT i0 AS vid, fid*3 AS s FROM fs UNION ALL SELECT i1, fid*3+1 FROM fs UNION ALL SELECT i2, fid*3+2 FROM fs) GROUP BY vid))"))
def compacted_faces(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    return topology.compacted(v, shell)[1].drop("mesh_id")


CELLS = """
bx AS (SELECT MIN(x) AS lx, MIN(y) AS ly, MIN(z) AS lz, MAX(x)-MIN(x) AS sx, MAX(y)-MIN(y) AS sy, MAX(z)-MIN(z) AS sz FROM v),
vc AS MATERIALIZED (SELECT vid, x, y, z, CAST(LEAST(53, FLOOR((x-lx)/(sx/54))) + LEAST(53, FLOOR((y-ly)/(sy/54)))*55 + LEAST(53, FLOOR((z-lz)/(sz/54)))*3025 AS BIGINT) AS cell FROM v, bx)"""


@_query(_on_cup(f"SELECT cell AS vid, {r6('AVG(x)', 'x')}, {r6('AVG(y)', 'y')}, {r6('AVG(z)', 'z')}, COUNT(*) AS n FROM vc GROUP BY cell", CELLS))
def decimated_vertices(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    return _rounded(topology.decimate(v, f)[0])


@_query(_on_cup("SELECT fid, a.cell AS i0, b.cell AS i1, c.cell AS i2 FROM f JOIN vc a ON a.vid = i0 JOIN vc b ON b.vid = i1 JOIN vc c ON c.vid = i2 WHERE a.cell <> b.cell AND b.cell <> c.cell AND c.cell <> a.cell", CELLS))
def decimated_faces(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    return topology.decimate(v, f)[1].drop("mesh_id")


@_query(_on_cup(f"SELECT cell, {r6('AVG(SQRT(x*x+y*y+z*z))', 'r')} FROM vc GROUP BY cell", CELLS))
def cluster_means(spark, sf_dir):
    v, _, _ = _cup(spark, sf_dir)
    return _rounded(topology.cluster_means(v.withColumn("r", g.length(g.point())), "r"))


@_query(_on_cup(f"SELECT {r6('SUM(SQRT(kx*kx+ky*ky+kz*kz)/2)', 'area')}, COUNT(*) AS triangles FROM (SELECT fid, {CROSS} FROM tri)", GALL, """
cd AS (SELECT *, -(z0+1) AS d0, -(z1+1) AS d1, -(z2+1) AS d2 FROM t),
cs AS (SELECT fid, [{'x': x0, 'y': y0, 'z': z0, 'd': d0}, {'x': x1, 'y': y1, 'z': z1, 'd': d1}, {'x': x2, 'y': y2, 'z': z2, 'd': d2}] AS p FROM cd),
ce AS (SELECT fid, k, p[k+1] AS a, p[(k+1)%3+1] AS b FROM cs, range(3) r(k)),
cp AS (SELECT fid, k, 0 AS s, a.x+(b.x-a.x)*a.d/(a.d-b.d) AS x, a.y+(b.y-a.y)*a.d/(a.d-b.d) AS y, a.z+(b.z-a.z)*a.d/(a.d-b.d) AS z FROM ce WHERE (a.d >= -1e-6) <> (b.d >= -1e-6)
  UNION ALL SELECT fid, k, 1, b.x, b.y, b.z FROM ce WHERE b.d >= -1e-6),
co AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY k, s) AS i, COUNT(*) OVER (PARTITION BY fid) AS c FROM cp),
tri AS (SELECT a.fid, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, e.x AS x2, e.y AS y2, e.z AS z2 FROM co a JOIN co b ON a.fid = b.fid AND a.i = 1 AND b.i >= 2 JOIN co e ON e.fid = a.fid AND e.i = b.i+1 WHERE a.c >= 3)"""))
def clipped(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    a, b, c = (tuple(F.col(f"{s}{k}") for k in "xyz") for s in "abc")
    return topology.clip(f, v, g.literal((0, 0, -1)), g.literal((0, 0, -1))).agg(_r(F.sum(g.triangle_area(a, b, c)), "area"), F.count("*").alias("triangles"))


CLIPPED = ["""
cd AS (SELECT *, -(z0+1) AS d0, -(z1+1) AS d1, -(z2+1) AS d2 FROM t),
cs AS (SELECT fid, [{'i': i0, 'x': x0, 'y': y0, 'z': z0, 'd': d0}, {'i': i1, 'x': x1, 'y': y1, 'z': z1, 'd': d1}, {'i': i2, 'x': x2, 'y': y2, 'z': z2, 'd': d2}] AS p FROM cd),
ce AS (SELECT fid, k, p[k+1] AS a, p[(k+1)%3+1] AS b FROM cs, range(3) r(k)),
cu AS (SELECT fid, k, a, b, CASE WHEN a.i > b.i THEN b ELSE a END AS l, CASE WHEN a.i > b.i THEN a ELSE b END AS h FROM ce),
cp AS (SELECT fid, k, 0 AS s, l.x+(h.x-l.x)*(l.d/(l.d-h.d)) AS x, l.y+(h.y-l.y)*(l.d/(l.d-h.d)) AS y, l.z+(h.z-l.z)*(l.d/(l.d-h.d)) AS z FROM cu WHERE (a.d >= -1e-6) <> (b.d >= -1e-6)
  UNION ALL SELECT fid, k, 1, b.x, b.y, b.z FROM cu WHERE b.d >= -1e-6),
co AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY k, s) - 1 AS i, COUNT(*) OVER (PARTITION BY fid) AS c FROM cp),
ck AS (SELECT fid*2+part-1 AS fid, corner, x, y, z, FLOOR(x/1e-5+0.5) AS kx, FLOOR(y/1e-5+0.5) AS ky, FLOOR(z/1e-5+0.5) AS kz FROM co, range(1, 3) q(part), range(3) r(corner) WHERE part <= c-2 AND i = CASE corner WHEN 0 THEN 0 ELSE part+corner-1 END),
cw AS (SELECT kx, ky, kz, MIN(fid*3+corner) AS o, arg_min(x, fid*3+corner) AS x, arg_min(y, fid*3+corner) AS y, arg_min(z, fid*3+corner) AS z FROM ck GROUP BY kx, ky, kz),
cv AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY o) - 1 AS vid FROM cw)"""]


def _clip_mesh(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    return topology.clip_mesh(f, v, _frame(v))


@_query(_on_cup(f"SELECT vid, {r6('x', 'x')}, {r6('y', 'y')}, {r6('z', 'z')} FROM cv", GALL, *CLIPPED))
def clipped_vertices(spark, sf_dir):
    """The cup cut by its rim plane, as a mesh with the crossings welded: its vertices."""
    return _rounded(_clip_mesh(spark, sf_dir)[0])


@_query(_on_cup("SELECT fid, MAX(vid) FILTER (corner = 0) AS i0, MAX(vid) FILTER (corner = 1) AS i1, MAX(vid) FILTER (corner = 2) AS i2 FROM ck JOIN cv USING (kx, ky, kz) GROUP BY fid", GALL, *CLIPPED))
def clipped_faces(spark, sf_dir):
    return _clip_mesh(spark, sf_dir)[1].select("fid", "i0", "i1", "i2")


def _welded(spark, sf_dir):
    v, f = cup.cup(spark, sf_dir)
    size = 3 * f.count()
    return topology.weld(topology.soup(f, v, parts_of(size)), size=size)


SOUP = "so AS (SELECT fid*3+k AS s, v.* FROM (SELECT fid, 0 AS k, i0 AS vid FROM f UNION ALL SELECT fid, 1, i1 FROM f UNION ALL SELECT fid, 2, i2 FROM f) c JOIN v USING (vid))"


@_query(_on_cup("""SELECT row_number() OVER (ORDER BY s) - 1 AS vid, x, y, z FROM (SELECT MIN(s) AS s, arg_min(x, s) AS x, arg_min(y, s) AS y, arg_min(z, s) AS z FROM so GROUP BY FLOOR(x/1e-6+0.5), FLOOR(y/1e-6+0.5), FLOOR(z/1e-6+0.5))""", SOUP))
def welded_vertices(spark, sf_dir):
    return _welded(spark, sf_dir)[0].select("vid", *[F.col(c).cast("double").alias(c) for c in "xyz"])


@_query(_on_cup("""SELECT fid, MAX(w.vid) FILTER (k = 0) AS i0, MAX(w.vid) FILTER (k = 1) AS i1, MAX(w.vid) FILTER (k = 2) AS i2 FROM (SELECT *, s//3 AS fid, s%3 AS k FROM so) c
  JOIN (SELECT row_number() OVER (ORDER BY s) - 1 AS vid, x, y, z FROM (SELECT MIN(s) AS s, x, y, z FROM so GROUP BY x, y, z)) w ON w.x = c.x AND w.y = c.y AND w.z = c.z GROUP BY fid""", SOUP))
def welded_faces(spark, sf_dir):
    return _welded(spark, sf_dir)[1].drop("mesh_id")


def _scale(k: str, name: str) -> str:
    return f"CASE WHEN d*{k} > 5000 THEN 0.001 WHEN d*{k} < 0.1 THEN 1000e0 ELSE 1e0 END::DOUBLE AS {name}"


@_query(_on_cup(f"SELECT {_scale('1', 'scale_mm')}, {_scale('1000', 'scale_um')}, {_scale('0.001', 'scale_m')} FROM (SELECT SQRT(POW(MAX(x)-MIN(x), 2)+POW(MAX(y)-MIN(y), 2)+POW(MAX(z)-MIN(z), 2)) AS d FROM v)"))
def detected_units(spark, sf_dir):
    v, _, _ = _cup(spark, sf_dir)
    p = v.select("mesh_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    at = lambda k, name: topology.unit_scale(p.select("mesh_id", *[(F.col(c) * k).alias(c) for c in "xyz"])).withColumnRenamed("scale", name)
    return at(1.0, "scale_mm").join(at(1000.0, "scale_um"), "mesh_id").join(at(0.001, "scale_m"), "mesh_id").drop("mesh_id")


@_query(_on_cup(f"""SELECT vid, {r6('sx/SQRT(sx*sx+sy*sy+sz*sz)', 'nx')}, {r6('sy/SQRT(sx*sx+sy*sy+sz*sz)', 'ny')}, {r6('sz/SQRT(sx*sx+sy*sy+sz*sz)', 'nz')} FROM (SELECT vid, SUM(kx) AS sx, SUM(ky) AS sy, SUM(kz) AS sz FROM (SELECT UNNEST([i0, i1, i2]) AS vid, {CROSS} FROM t) GROUP BY vid)""".replace("6) +", "4) +"), GALL))
def vertex_normals(spark, sf_dir):
    """Compared to four decimals, before the normals are stored as floats."""
    v, f, _ = _cup(spark, sf_dir)
    return topology.unit_normals(v, f).select("vid", *[(F.round(c, 4) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


@_query(_on_cup(f"SELECT COUNT(*) AS n, {r6('AVG(x)', 'cx')}, {r6('MIN(x)', 'min_x')}, {r6('MAX(x)', 'max_x')}, {r6('AVG(y)', 'cy')}, {r6('MIN(y)', 'min_y')}, {r6('MAX(y)', 'max_y')}, {r6('AVG(z)', 'cz')}, {r6('MIN(z)', 'min_z')}, {r6('MAX(z)', 'max_z')} FROM v"))
def mesh_bounds(spark, sf_dir):
    return _rounded(topology.bounds(_cup(spark, sf_dir)[0]))


CLASS = "cl AS (SELECT vid, x, y, z, -(z+1) >= 0 AS active, SQRT(x*x+y*y+z*z) AS d FROM vs)"


@_query(_on_cup(f"SELECT vid, active, {r6('CASE WHEN active THEN d ELSE 16 END', 'distance')}, {r6('CASE WHEN active THEN (d-16)*1000 ELSE 0 END', 'deviation')}, active AND d > 16*1.02 AS worn FROM cl", SHELL, CLASS))
def wear_classification(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    return _rounded(select.classify(topology.used_vertices(v, shell), _sphere(v), _frame(v)).drop("x", "y", "z"))


@_query(_on_cup(f"SELECT COUNT(*) FILTER (active AND d > 16*1.02) AS worn, COUNT(*) FILTER (active AND NOT d > 16*1.02) AS unworn, {r6('CAST(COUNT(*) FILTER (active AND d > 16*1.02) AS DOUBLE)/GREATEST(1, COUNT(*) FILTER (active))*100', 'worn_percent')} FROM cl", SHELL, CLASS))
def wear_summary(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    return _rounded(select.wear_summary(select.classify(topology.used_vertices(v, shell), _sphere(v), _frame(v))))


@_query(_on_cup(f"SELECT {r6('GREATEST(MAX(e), 0)', 'max_bump')}, {r6('LEAST(MIN(e), 0)', 'max_dip')}, {r6('AVG(e)', 'mean')}, {r6('STDDEV_POP(e)', 'std')}, {r6('CAST(COUNT(*) FILTER (ABS(e) <= 55) AS DOUBLE)/COUNT(*)*100', 'within_percent')} FROM (SELECT (SQRT(x*x+y*y+z*z)-16.0)*1000 AS e FROM vs)", SHELL))
def deviation_statistics(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    p = topology.used_vertices(v, shell).withColumn("deviation", (g.length(g.point()) - 16.0) * 1000)
    return _rounded(cluster.deviation_statistics(p, threshold=55))


def _tet(a, b, c, d):
    s = lambda p, q, k: f"({q.format(k)}-{p.format(k)})"
    x = [[s(a, p, k) for k in "xyz"] for p in (b, c, d)]
    (bx, by, bz), (cx, cy, cz), (dx, dy, dz) = x
    return f"({bx}*({cy}*{dz}-{cz}*{dy})+{by}*({cz}*{dx}-{cx}*{dz})+{bz}*({cx}*{dy}-{cy}*{dx}))/6"


_V, _S = ["{0}0", "{0}1", "{0}2"], ["({0}0*16/r0)", "({0}1*16/r1)", "({0}2*16/r2)"]
PRISM = "+".join([_tet(_V[0], _V[1], _V[2], _S[0]), _tet(_S[0], _V[1], _V[2], _S[1]), _tet(_S[0], _S[1], _V[2], _S[2])])
RAD = "tr AS (SELECT *, SQRT(x0*x0+y0*y0+z0*z0) AS r0, SQRT(x1*x1+y1*y1+z1*z1) AS r1, SQRT(x2*x2+y2*y2+z2*z2) AS r2 FROM t)"


@_query(_on_cup(f"SELECT {r6('b', 'bump_volume')}, {r6('d', 'dip_volume')}, {r6('b+d', 'total_volume')}, {r6('b*0.935', 'bump_mass')}, {r6('d*0.935', 'dip_mass')} FROM (SELECT COALESCE(SUM(ABS(w)) FILTER (e > 1), 0) AS b, COALESCE(SUM(ABS(w)) FILTER (e < -1), 0) AS d FROM (SELECT {PRISM} AS w, ((r0+r1+r2)/3-16)*1000 AS e FROM tr))", SHELL, GSHELL, RAD))
def defect_volumes(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    d = topology.used_vertices(v, shell).withColumn("deviation", (g.length(g.point()) - 16.0) * 1000)
    return _rounded(volume.defect_volumes(shell, d, _sphere(v)))


ENCLOSED = f"(SELECT ABS(SUM((-(z0+1)-(z1+1)-(z2+1))/3*0.5*-kz)) AS e FROM (SELECT *, {CROSS} FROM t) WHERE z0 <= -1 AND z1 <= -1 AND z2 <= -1)"


@_query(_on_cup(f"SELECT {r6('e', 'enclosed_volume')}, {r6('c', 'cap_volume')}, {r6('GREATEST(0, e-c)', 'wear_volume')} FROM (SELECT e, PI()/3*15*15*33 AS c FROM {ENCLOSED})", SHELL, GSHELL))
def wear_volume(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    frame = _frame(v)
    return _rounded(volume.wear_volume(volume.enclosed_volume(shell, v, frame), _sphere(v), frame))


@_query(_on_cup(f"SELECT fid, {r6('th', 'thickness')}, {r6('(th-MIN(th) OVER ())/(MAX(th) OVER ()-MIN(th) OVER ())', 'share')} FROM (SELECT fid, (r0+r1+r2)/3-16 AS th FROM tr) WHERE th > 0", SHELL, GSHELL, RAD))
def wear_solid(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    return _rounded(volume.wear_solid(shell, v, _sphere(v)))


SOLID = """
wf AS MATERIALIZED (SELECT t.fid, i0, i1, i2, (th-MIN(th) OVER ())/(MAX(th) OVER ()-MIN(th) OVER ()) AS share FROM (SELECT fid, (r0+r1+r2)/3-16 AS th FROM tr) w JOIN t ON t.fid = w.fid WHERE th > 0),
wu AS (SELECT fid, k, share, CASE k WHEN 0 THEN i0 WHEN 1 THEN i1 ELSE i2 END AS a, CASE k WHEN 0 THEN i1 WHEN 1 THEN i2 ELSE i0 END AS b FROM wf, range(3) r(k)),
wo AS (SELECT *, SUM(CASE WHEN a < b THEN 1 ELSE -1 END) OVER (PARTITION BY LEAST(a, b), GREATEST(a, b)) AS net, row_number() OVER (PARTITION BY a, b ORDER BY fid, k) AS nth FROM wu WHERE a <> b),
ww AS (SELECT * FROM wo WHERE nth <= ABS(net) AND (a < b) = (net > 0))"""


@_query(_on_cup(f"SELECT vid, {r6('x', 'x')}, {r6('y', 'y')}, {r6('z', 'z')} FROM (SELECT vid*2 AS vid, x, y, z FROM vs WHERE vid IN (SELECT a FROM wu) UNION ALL SELECT vid*2+1, x*16/SQRT(x*x+y*y+z*z), y*16/SQRT(x*x+y*y+z*z), z*16/SQRT(x*x+y*y+z*z) FROM vs WHERE vid IN (SELECT a FROM wu))", SHELL, GSHELL, RAD, SOLID))
def wear_mesh_vertices(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    return _rounded(volume.wear_mesh(shell, v, _sphere(v))[0])


@_query(_on_cup(f"""SELECT fid, i0, i1, i2, {r6('share', 'share')} FROM (SELECT fid*8 AS fid, i0*2 AS i0, i1*2 AS i1, i2*2 AS i2, share FROM wf UNION ALL SELECT fid*8+1, i0*2+1, i2*2+1, i1*2+1, share FROM wf
  UNION ALL SELECT fid*8+k*2+2, b*2, a*2, a*2+1, share FROM ww UNION ALL SELECT fid*8+k*2+3, b*2, a*2+1, b*2+1, share FROM ww)""", SHELL, GSHELL, RAD, SOLID))
def wear_mesh_faces(spark, sf_dir):
    """The solid between the worn surface and the sphere, closed."""
    v, _, shell = _cup(spark, sf_dir)
    return _rounded(volume.wear_mesh(shell, v, _sphere(v))[1])


@_query(_on_cup(f"""SELECT fid, CAST(part AS INTEGER) AS part, {r6('SQRT(kx*kx+ky*ky+kz*kz)/2', 'area')}, {r6('1-share', 'green')} FROM (SELECT fid, part, share, {CROSS} FROM (
  SELECT fid, part, share, c[s[1]].x AS x0, c[s[1]].y AS y0, c[s[1]].z AS z0, c[s[2]].x AS x1, c[s[2]].y AS y1, c[s[2]].z AS z1, c[s[3]].x AS x2, c[s[3]].y AS y2, c[s[3]].z AS z2
  FROM (SELECT wf.fid, share, [{{'x': x0, 'y': y0, 'z': z0}}, {{'x': x1, 'y': y1, 'z': z1}}, {{'x': x2, 'y': y2, 'z': z2}}, {{'x': x0*16/r0, 'y': y0*16/r0, 'z': z0*16/r0}}, {{'x': x1*16/r1, 'y': y1*16/r1, 'z': z1*16/r1}}, {{'x': x2*16/r2, 'y': y2*16/r2, 'z': z2*16/r2}}] AS c FROM wf JOIN tr ON tr.fid = wf.fid),
  (VALUES (0, [1,2,3]), (1, [4,6,5]), (2, [1,2,5]), (3, [1,5,4]), (4, [2,3,6]), (5, [2,6,5]), (6, [3,1,4]), (7, [3,4,6])) q(part, s)))""", SHELL, GSHELL, RAD, SOLID))
def wear_prisms(spark, sf_dir):
    """The closed prism of each worn face, as triangles with their areas and colour."""
    v, _, shell = _cup(spark, sf_dir)
    a, b, c = (tuple(F.col(f"{s}{k}") for k in "xyz") for s in "abc")
    return volume.wear_prisms(shell, v, _sphere(v)).select("fid", "part", _r(g.triangle_area(a, b, c), "area"), _r("green"))


@_query(_on_cup(f"""SELECT vid, {r6('e', 'max_depth')}, {r6('x', 'x')}, {r6('y', 'y')}, {r6('z', 'z')}, {r6('-y/l', 'wx')}, {r6('x/l', 'wy')}, 0e0 AS wz, 0e0 AS anchor_x, 0e0 AS anchor_y, {r6('(-16.05-1)/2', 'anchor_z')}
  FROM (SELECT *, (SQRT(x*x+y*y+z*z)-16)*1000 AS e, SQRT(x*x+y*y) AS l FROM vs WHERE z <= -1) ORDER BY e DESC, vid LIMIT 1""", SHELL))
def wear_plane(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    frame = _frame(v)
    return _rounded(volume.wear_plane(select.classify(topology.used_vertices(v, shell), _sphere(v), frame), frame))


@_query(_on_cup(f"""SELECT {r6('x', 'x')}, {r6('y', 'y')}, {r6('z', 'z')}, {r6('e', 'max_depth')}, {r6('d', 'distance')}, {r6('DEGREES(ACOS(GREATEST(-1, LEAST(1, -(z+16.05)/d))))', 'angle')}
  FROM (SELECT *, row_number() OVER (ORDER BY d, vid) AS k, COUNT(*) OVER () AS c FROM (SELECT vid, x, y, z, (SQRT(x*x+y*y+z*z)-16)*1000 AS e, SQRT(x*x+y*y+(z+16.05)*(z+16.05)) AS d FROM vs WHERE vid > 0 AND (SQRT(x*x+y*y+z*z)-16)*1000 > 60))
  WHERE k <= GREATEST(1, CEIL(c*0.7)) ORDER BY e DESC, k LIMIT 1""", SHELL))
def wear_vector(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    p = topology.used_vertices(v, shell).select("mesh_id", F.col("vid").alias("seq"), "x", "y", "z", ((g.length(g.point()) - 16) * 1000).alias("dev")).filter("dev > 60 AND seq > 0")
    return _rounded(volume.wear_vector(p, _frame(v)))


@_query(_on_cup(f"""SELECT block, ring, segment, {r6('cx+r*SIN(th)*SIN(ph)', 'x')}, {r6('cy+r*SIN(th)*COS(ph)', 'y')}, {r6('cz-r*COS(th)', 'z')} FROM (SELECT b.*, CAST(i AS INTEGER) AS ring, CAST(j AS INTEGER) AS segment, ACOS(1.0/3)*i/32 AS th, 2*PI()*j/64 AS ph FROM bs b, range(33) a(i), range(65) q(j))""", SHELL, """
bc AS (SELECT (vid-1)//400 AS block, AVG(x) AS cx, AVG(y) AS cy, AVG(z) AS cz FROM vs WHERE vid > 0 GROUP BY 1),
bs AS MATERIALIZED (SELECT block, cx, cy, cz, MAX(SQRT((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))) AS r FROM vs JOIN bc ON block = (vid-1)//400 WHERE vid > 0 GROUP BY block, cx, cy, cz)"""))
def cap_tessellation(spark, sf_dir):
    """Caps of the spheres around each ten rings of the shell, beyond a plane a third of the radius below the centre. Frame of the downward axis: U is y, V is x."""
    v, _, shell = _cup(spark, sf_dir)
    points = topology.used_vertices(v, shell).filter("vid > 0").select(F.expr("cast((vid - 1) div 400 as string)").alias("mesh_id"), "x", "y", "z")
    middle = points.groupBy("mesh_id").agg(*[F.avg(F.col(c).cast("double")).alias(f"c{c}") for c in "xyz"])
    spheres = with_mesh(points, middle).groupBy("mesh_id", "cx", "cy", "cz").agg(F.max(g.distance(g.point(), fit.center())).alias("radius"))
    spheres = spheres.select("*", F.col("cx").alias("qx"), F.col("cy").alias("qy"), (F.col("cz") - F.col("radius") / 3).alias("qz"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(-1.0).alias("nz"))
    rows = volume.cap_tessellation(spark, spheres)
    return rows.select(F.col("mesh_id").cast("long").alias("block"), "ring", "segment", _r("x"), _r("y"), _r("z"))


@_query(_on_cup(f"SELECT {r6('MIN(-(z-m))', 'min_height')}, {r6('MAX(-(z-m))', 'max_height')} FROM vs, (SELECT AVG(z) AS m FROM vs)", SHELL))
def height_range(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    p = stored(topology.used_vertices(v, shell))
    return _rounded(select.height_range(p, _frame(v).select("mesh_id", "ax", "ay", "az")))


def _average(old: str, factor: str) -> str:
    part = lambda c: f"CAST(CAST(CAST(p.{c} AS DOUBLE) + {factor}*(m.{c}-CAST(p.{c} AS DOUBLE)) AS FLOAT) AS DOUBLE) AS {c}"
    return f"SELECT p.vid, {part('x')}, {part('y')}, {part('z')} FROM {old} p JOIN (SELECT src, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z FROM ad JOIN {old} ON vid = dst GROUP BY src) m ON m.src = p.vid"


ADJ = EDGES.format("f") + ", ad AS MATERIALIZED (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e)"


@_query(_on_cup(f"SELECT vid, {', '.join(f'ROUND({c}, 4) + 0.0 AS {c}' for c in 'xyz')} FROM h2", ADJ, f"h1 AS MATERIALIZED ({_average('v', '0.5')}), h2 AS MATERIALIZED ({_average('h1', '(-0.53)')})"))
def taubin_once(spark, sf_dir):
    """Floats between half steps, so compared to four decimals."""
    v, f, _ = _cup(spark, sf_dir)
    return smooth.taubin(v, f, 1).select("vid", *[(F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in "xyz"])


@_query(_on_cup(f"SELECT vid, {', '.join(f'ROUND({c}, 4) + 0.0 AS {c}' for c in 'xyz')} FROM h2", ADJ, f"h1 AS MATERIALIZED ({_average('v', '0.25')}), h2 AS MATERIALIZED ({_average('h1', '0.25')})"))
def laplacian_preview(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    return smooth.laplacian(v, f).select("vid", *[(F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in "xyz"])


MERIDIANS = meridian.COUNT
CUTS = """
mt AS (SELECT k, 2*PI()/360*k AS theta, COS(2*PI()/360*k) AS ct, SIN(2*PI()/360*k) AS st FROM range(360) r(k)),
md AS (SELECT t.*, k, theta, -ct*x0+st*y0 AS s0, -ct*x1+st*y1 AS s1, -ct*x2+st*y2 AS s2 FROM t, mt),
mc AS (SELECT fid, k, theta, i, CASE WHEN s*u < 0 THEN a.x+s/(s-u)*(b.x-a.x) ELSE a.x END AS x, CASE WHEN s*u < 0 THEN a.y+s/(s-u)*(b.y-a.y) ELSE a.y END AS y, CASE WHEN s*u < 0 THEN a.z+s/(s-u)*(b.z-a.z) ELSE a.z END AS z
  FROM (SELECT fid, k, theta, i, [{'x': x0, 'y': y0, 'z': z0}, {'x': x1, 'y': y1, 'z': z1}, {'x': x2, 'y': y2, 'z': z2}][i+1] AS a, [{'x': x0, 'y': y0, 'z': z0}, {'x': x1, 'y': y1, 'z': z1}, {'x': x2, 'y': y2, 'z': z2}][(i+1)%3+1] AS b, [s0, s1, s2][i+1] AS s, [s0, s1, s2][(i+1)%3+1] AS u FROM md, range(3) r(i)) WHERE s*u < 0 OR ABS(s) < 1e-10),
mo AS (SELECT *, row_number() OVER (PARTITION BY fid, k ORDER BY i) AS o FROM mc),
ms AS (SELECT a.fid, a.k, a.theta, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, ATAN2((a.x+b.x)/2, (a.y+b.y)/2) AS l FROM mo a JOIN mo b ON a.fid = b.fid AND a.k = b.k AND a.o = 1 AND b.o = 2),
mk AS MATERIALIZED (SELECT * FROM (SELECT *, ABS(CASE WHEN l < 0 THEN l+2*PI() ELSE l END - theta) AS w FROM ms) WHERE LEAST(w, 2*PI()-w) < PI()/2)"""


@_query(_on_cup(f"SELECT k AS geo_id, COUNT(*) AS n, {r6('SUM(SQRT((x0-x1)*(x0-x1)+(y0-y1)*(y0-y1)+(z0-z1)*(z0-z1)))', 'total')}, {r6('MIN(-z0)', 'lowest')}, {r6('MAX(-z0)', 'highest')} FROM mk GROUP BY k", SHELL, GSHELL, CUTS))
def meridian_segments(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    cuts = meridian.segments(shell, v, _frame(v), MERIDIANS)
    a, b = (tuple(F.col(f"{c}{k}") for c in "xyz") for k in (0, 1))
    return cuts.groupBy("geo_id").agg(F.count("*").alias("n"), _r(F.sum(g.distance(a, b)), "total"), _r(F.min("lat0"), "lowest"), _r(F.max("lat0"), "highest"))


def _lines(spark, sf_dir, count=MERIDIANS, most=meridian.MOST_POINTS):
    v, _, shell = _cup(spark, sf_dir)
    frame, used = _frame(v), stored(topology.used_vertices(v, shell))
    lines = meridian.polylines(meridian.segments(shell, used, frame, count), frame, most)
    return used, frame, stored(meridian.profiles(lines, frame, used))


#: Profiles: end points from the pole down without repeats (the pole itself is the first of them here), all of them or thinned, with arc, deviation and derivatives.
def _derived(source: str, name: str) -> str:
    return f"""{name}1 AS (SELECT *, CASE WHEN COALESCE(LEAD(arc) OVER w, arc)-COALESCE(LAG(arc) OVER w, arc) > 1e-12 THEN (COALESCE(LEAD(dev) OVER w, dev)-COALESCE(LAG(dev) OVER w, dev))/(COALESCE(LEAD(arc) OVER w, arc)-COALESCE(LAG(arc) OVER w, arc)) ELSE 0 END AS d1 FROM {source} WINDOW w AS (PARTITION BY k ORDER BY seq)),
{name} AS MATERIALIZED (SELECT *, CASE WHEN LEAD(arc) OVER w-LAG(arc) OVER w > 1e-12 THEN (LEAD(d1) OVER w-LAG(d1) OVER w)/(LEAD(arc) OVER w-LAG(arc) OVER w) ELSE 0 END AS d2 FROM {name}1 WINDOW w AS (PARTITION BY k ORDER BY seq))"""


def _profiles(points: str) -> str:
    return f"""
pe AS (SELECT k, fid*2 AS o, x0 AS x, y0 AS y, z0 AS z FROM mk UNION ALL SELECT k, fid*2+1, x1, y1, z1 FROM mk),
pg AS (SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py, LAG(z) OVER w AS pz FROM pe WINDOW w AS (PARTITION BY k ORDER BY -z DESC, o)),
pk AS (SELECT k, o, x, y, z, px IS NULL AS head FROM pg WHERE px IS NULL OR (x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz) > 1e-12),
pq AS (SELECT k, 0 AS own, o, -z AS lat, 0e0 AS x, 0e0 AS y, -16.05e0 AS z FROM pk WHERE head AND x*x+y*y+(z+16.05)*(z+16.05) > 1e-12 UNION ALL SELECT k, 1, o, -z, x, y, z FROM pk),
pr AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY lat DESC, o, own) - 1 AS r, COUNT(*) OVER (PARTITION BY k) AS n, x, y, z FROM pq),
pt AS ({points}),
pa AS (SELECT *, COALESCE(SQRT((x-LAG(x) OVER w)*(x-LAG(x) OVER w)+(y-LAG(y) OVER w)*(y-LAG(y) OVER w)+(z-LAG(z) OVER w)*(z-LAG(z) OVER w)), 0) AS gap FROM pt WINDOW w AS (PARTITION BY k ORDER BY seq)),
mr AS (SELECT AVG(SQRT(x*x+y*y+z*z)) AS m FROM v WHERE vid IN (SELECT UNNEST([i0, i1, i2]) FROM fs)),
pb AS (SELECT k, seq, x, y, z, SUM(gap) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING) AS arc, (SQRT(x*x+y*y+z*z)-m)*1000 AS dev FROM pa, mr),
""" + _derived("pb", "pf")


WHOLE_PROFILES = _profiles("SELECT k, r AS seq, x, y, z FROM pr")
PROFILES = _profiles("SELECT k, r AS seq, x, y, z FROM pr WHERE n <= 500 UNION ALL SELECT k, CEIL((r-0.5)/((n-1)/499e0)), x, y, z FROM pr WHERE n > 500 AND FLOOR(CEIL((r-0.5)/((n-1)/499e0))*((n-1)/499e0)+0.5) = r")
#: Decimals that sums in any order leave alone.
_PROFILE = "ROUND(x, 6) + 0.0 AS x, ROUND(y, 6) + 0.0 AS y, ROUND(z, 6) + 0.0 AS z, ROUND(arc, 6) + 0.0 AS arc, ROUND(dev, 3) + 0.0 AS dev, ROUND(d1, 3) + 0.0 AS d1, ROUND(d2, 1) + 0.0 AS d2"


def _profile(df: DataFrame) -> DataFrame:
    places = {"x": 6, "y": 6, "z": 6, "arc": 6, "dev": 3, "d1": 3, "d2": 1}
    return df.select(*[(F.round(c, places[c]) + F.lit(0.0)).alias(c) if c in places else F.col(c).cast("long").alias(c) if c == "seq" else F.col(c) for c in df.columns if c != "mesh_id"])


@_query(_on_cup(f"SELECT k AS geo_id, CAST(seq AS BIGINT) AS seq, {_PROFILE} FROM pf", SHELL, GSHELL, CUTS, PROFILES))
def meridian_profiles(spark, sf_dir):
    return _profile(_lines(spark, sf_dir)[2])


SUMMARIES = """
su AS (SELECT r.k, COALESCE(MAX(arc), 0) AS total_length, COALESCE(MAX(dev), 0) AS max_dev, COALESCE(MIN(dev), 0) AS min_dev, COUNT(*) FILTER (ABS(dev) > 1) AS anomaly_count, COALESCE(SQRT(AVG(d2*d2)), 0) AS rms FROM range(360) r(k) LEFT JOIN pf ON pf.k = r.k GROUP BY r.k),
sm AS (SELECT rms AS med FROM su ORDER BY rms, k LIMIT 1 OFFSET 180)"""
_SUMMARY = "k AS geo_id, CAST(k AS DOUBLE) AS angle, ROUND(total_length, 6) + 0.0 AS total_length, ROUND(max_dev, 3) + 0.0 AS max_dev, ROUND(min_dev, 3) + 0.0 AS min_dev, anomaly_count, ROUND(rms, 2) + 0.0 AS rms, rms <= 2*med AS is_regular"


def _summary(df: DataFrame) -> DataFrame:
    places = {"total_length": 6, "max_dev": 3, "min_dev": 3, "rms": 2}
    return df.select(*[(F.round(c, places[c]) + F.lit(0.0)).alias(c) if c in places else F.col(c) for c in df.columns if c != "mesh_id"])


@_query(_on_cup(f"SELECT {_SUMMARY} FROM su, sm", SHELL, GSHELL, CUTS, PROFILES, SUMMARIES))
def meridian_summaries(spark, sf_dir):
    used, _, points = _lines(spark, sf_dir)
    return _summary(meridian.summaries(points, used))


@_query(_on_cup(f"SELECT {_SUMMARY} FROM su, sm WHERE rms <= 2*med", SHELL, GSHELL, CUTS, PROFILES, SUMMARIES))
def regular_meridians(spark, sf_dir):
    used, _, points = _lines(spark, sf_dir)
    return _summary(meridian.shown(meridian.summaries(points, used), "regular"))


@_query(_on_cup(f"SELECT k AS geo_id, CAST(seq AS BIGINT) AS seq, {_PROFILE} FROM cq", SHELL, GSHELL, CUTS, PROFILES, """
ch AS (SELECT AVG(x) AS ax, AVG(y) AS ay, AVG(z) AS az FROM pf WHERE seq = 0),
cm AS (SELECT k, seq, CASE WHEN seq = 0 THEN ax ELSE x END AS x, CASE WHEN seq = 0 THEN ay ELSE y END AS y, CASE WHEN seq = 0 THEN az ELSE z END AS z, CASE WHEN seq = 0 THEN (SQRT(ax*ax+ay*ay+az*az)-m)*1000 ELSE dev END AS dev FROM pf, ch, mr),
cg AS (SELECT *, COALESCE(SQRT((x-LAG(x) OVER w)*(x-LAG(x) OVER w)+(y-LAG(y) OVER w)*(y-LAG(y) OVER w)+(z-LAG(z) OVER w)*(z-LAG(z) OVER w)), 0) AS gap FROM cm WINDOW w AS (PARTITION BY k ORDER BY seq)),
cb AS (SELECT *, SUM(gap) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING) AS arc FROM cg)""", _derived("cb", "cq")))
def meridian_common_pole(spark, sf_dir):
    _, frame, points = _lines(spark, sf_dir)
    return _profile(meridian.common_pole(points, frame, consistent=True))


def _section(source: str, keys: str, name: str) -> str:
    """CTE ``name`` (keys, m, n, u, v): the plane of each section of ``source`` (keys, seq from 0, x, y, z), through its first, middle and last point."""
    pick = lambda at, tag: ", ".join(f"MAX({c}) FILTER (seq = {at}) AS {tag}{c}" for c in "xyz")
    return f"""{name}1 AS (SELECT {keys}, mx, my, mz, {pick('0', 'p')}, {pick('c//2', 'q')}, {pick('c-1', 'e')} FROM (SELECT *, COUNT(*) OVER w AS c, AVG(x) OVER w AS mx, AVG(y) OVER w AS my, AVG(z) OVER w AS mz FROM {source} WINDOW w AS (PARTITION BY {keys})) WHERE c >= 3 GROUP BY {keys}, mx, my, mz),
{name}2 AS (SELECT *, (qy-py)*(ez-pz)-(qz-pz)*(ey-py) AS kx, (qz-pz)*(ex-px)-(qx-px)*(ez-pz) AS ky, (qx-px)*(ey-py)-(qy-py)*(ex-px) AS kz, SQRT((ex-px)*(ex-px)+(ey-py)*(ey-py)+(ez-pz)*(ez-pz)) AS el FROM {name}1),
{name}3 AS (SELECT {keys}, mx, my, mz, kx/kl AS nx, ky/kl AS ny, kz/kl AS nz, (ex-px)/el AS ux, (ey-py)/el AS uy, (ez-pz)/el AS uz FROM (SELECT *, SQRT(kx*kx+ky*ky+kz*kz) AS kl FROM {name}2) WHERE kl >= 1e-10),
{name} AS MATERIALIZED (SELECT *, ny*uz-nz*uy AS vx, nz*ux-nx*uz AS vy, nx*uy-ny*ux AS vz FROM {name}3)"""


@_query(_on_cup(f"SELECT ga AS geo_a, gb AS geo_b, seq, {r6('arc', 'arc')}, {r6('dev', 'dev')}, {r6('(x-mx)*ux+(y-my)*uy+(z-mz)*uz', 'u')}, {r6('(x-mx)*vx+(y-my)*vy+(z-mz)*vz', 'v')}, ABS(d2) > 0.01 AS irregular FROM dn JOIN ds USING (ga, gb)", SHELL, GSHELL, CUTS, WHOLE_PROFILES, """
dp AS (SELECT k AS ga, k+180 AS gb, -seq AS s, x, y, z, -arc AS arc, dev, d2 FROM pf WHERE k < 180 UNION ALL SELECT k-180, k, seq, x, y, z, arc, dev, d2 FROM pf WHERE k >= 180 AND seq > 0),
dn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ga, gb ORDER BY s) - 1 AS seq FROM dp)""", _section("dn", "ga, gb", "ds")))
def double_profiles(spark, sf_dir):
    _, _, points = _lines(spark, sf_dir, most=None)
    pairs = stored(meridian.opposite(points.select("mesh_id", "geo_id").distinct()))
    both = stored(meridian.double_profiles(points, pairs))
    return _rounded(meridian.projected(both, ["mesh_id", "geo_a", "geo_b"]).select("mesh_id", "geo_a", "geo_b", F.col("seq").cast("long").alias("seq"), "arc", "dev", "u", "v", "irregular"))


@_query(_on_cup(f"SELECT k AS geo_id, CAST(seq AS BIGINT) AS seq, {_PROFILE}, CASE WHEN dev > 0 THEN 'bump' ELSE 'dip' END AS type FROM (SELECT *, row_number() OVER (PARTITION BY printf('%.4f', x), printf('%.4f', y), printf('%.4f', z) ORDER BY k, seq) AS c FROM pf WHERE ABS(dev) > 1) WHERE c = 1", SHELL, GSHELL, CUTS, PROFILES))
def profile_anomalies(spark, sf_dir):
    return _profile(cluster.anomalies(_lines(spark, sf_dir)[2]))


def _outer_segments(spark, sf_dir):
    v, f, shell = _cup(spark, sf_dir)
    _, _, points = _lines(spark, sf_dir)
    outer = f.join(shell.select("mesh_id", "fid"), ["mesh_id", "fid"], "left_anti")
    keys = ["mesh_id", "geo_id"]
    return meridian.outer_segments(outer, v, points, _sphere(v), keys), keys


def _turn(x: str, y: str, z: str) -> str:
    return f"ACOS(GREATEST(-1, LEAST(1, ({x}*mx+{y}*my+{z}*mz)/(SQRT({x}*{x}+{y}*{y}+{z}*{z})*SQRT(mx*mx+my*my+mz*mz)))))"


_CORNERS = "[" + ", ".join(f"{{'x': x{k}, 'y': y{k}, 'z': z{k}, 'd': d{k}}}" for k in range(3)) + "]"


@_query(_on_cup(f"SELECT k AS geo_id, COUNT(*) AS n, {r6('SUM(SQRT((u1-u0)*(u1-u0)+(w1-w0)*(w1-w0)))', 'total')}, {r6('MIN(LEAST(u0, u1))', 'min_u')}, {r6('MAX(GREATEST(w0, w1))', 'max_v')} FROM og GROUP BY k", SHELL, GSHELL, CUTS, PROFILES, _section("pf", "k", "sc"), f"""
sl AS (SELECT sc.*, li FROM sc JOIN (SELECT k, COALESCE(MAX({_turn("x", "y", "z")}), 0)*1.3+0.15 AS li FROM pf JOIN sc USING (k) WHERE SQRT(x*x+y*y+z*z) > 1e-3 GROUP BY k) USING (k)),
fo AS (SELECT f.* FROM f, n WHERE fid >= 4*np)""", G.format(f="fo").replace("t AS", "ot AS", 1), f"""
od AS (SELECT * FROM (SELECT fid, x0, y0, z0, x1, y1, z1, x2, y2, z2, k, mx, my, mz, ux, uy, uz, vx, vy, vz, li, x0*nx+y0*ny+z0*nz AS d0, x1*nx+y1*ny+z1*nz AS d1, x2*nx+y2*ny+z2*nz AS d2 FROM ot, sl) WHERE LEAST(d0, d1, d2) < 0 AND GREATEST(d0, d1, d2) > 0),
oe AS (SELECT fid, k, i, mx, my, mz, ux, uy, uz, vx, vy, vz, li, a.x+a.d/(a.d-b.d)*(b.x-a.x) AS x, a.y+a.d/(a.d-b.d)*(b.y-a.y) AS y, a.z+a.d/(a.d-b.d)*(b.z-a.z) AS z FROM (SELECT *, {_CORNERS}[i+1] AS a, {_CORNERS}[(i+1)%3+1] AS b FROM od, range(3) r(i)) WHERE a.d*b.d < 0),
og AS (SELECT fid, k, MIN_BY(u, i) AS u0, MIN_BY(w, i) AS w0, MAX_BY(u, i) AS u1, MAX_BY(w, i) AS w1 FROM (SELECT fid, k, i, (x-mx)*ux+(y-my)*uy+(z-mz)*uz AS u, (x-mx)*vx+(y-my)*vy+(z-mz)*vz AS w FROM oe WHERE {_turn("x", "y", "z")} <= li) GROUP BY fid, k HAVING COUNT(*) = 2)"""))
def outer_segments(spark, sf_dir):
    """The outer surface's section in the plane of each meridian, as loose segments: number, length and extent of each."""
    rows, _ = _outer_segments(spark, sf_dir)
    size = F.sqrt((F.col("bu") - F.col("au")) * (F.col("bu") - F.col("au")) + (F.col("bv") - F.col("av")) * (F.col("bv") - F.col("av")))
    return rows.groupBy("geo_id").agg(F.count("*").alias("n"), _r(F.sum(size), "total"), _r(F.min(F.least("au", "bu")), "min_u"), _r(F.max(F.greatest("av", "bv")), "max_v"))


@_query()
def outer_sections(spark, sf_dir):
    """Chains of the outer surface's section in the plane of each meridian: points and extent of each."""
    chains = meridian.outer_chains(*_outer_segments(spark, sf_dir))
    return chains.groupBy("geo_id", "chain").agg(F.count("*").alias("n"), *[_r(f_(c), f"{name}_{c}") for c in "uv" for name, f_ in (("min", F.min), ("max", F.max))])


HEAT = ", ".join(
    r6("1e-9 + CASE " + " ".join(f"WHEN pos < {b} THEN ({p[k]} + (pos - {a}) / ({b} - {a}) * ({q[k]} - {p[k]})) / 255.0" for (a, p), (b, q) in zip(stops, stops[1:])) + f" ELSE {stops[-1][1][k]} / 255.0 END", f"{table}_{c}")
    for table, stops in g.HEAT.items() for k, c in enumerate("rgb")
)


@_query(_on_cup(f"SELECT vid, {HEAT} FROM (SELECT vid, LEAST(511, FLOOR((GREATEST(-100, LEAST(500, (SQRT(x*x+y*y+z*z)-16)*1000))+100)/600*512+0.5))/512e0 AS pos FROM v)"))
def heat_colours(spark, sf_dir):
    v, _, _ = _cup(spark, sf_dir)
    e = (g.length(g.point()) - 16) * 1000
    # entries lie on halves of the last decimal, so all are moved by as little
    return v.select("vid", *[_r(channel + 1e-9, f"{table}_{c}") for table in g.HEAT for c, channel in zip("rgb", g.heat_colour(e, F.lit(-100.0), F.lit(500.0), table), strict=True)])


@_query(_on_cup(f"SELECT COUNT(*) AS triangles, {r6('SUM(ABS(ux*wy-uy*wx))/2', 'area')} FROM hp", SHELL, EDGES.format("fs"), """
rv AS MATERIALIZED (SELECT vid, x, y FROM v WHERE vid IN (SELECT UNNEST([a, b]) FROM e WHERE uses = 1)),
hp AS (SELECT p.x AS ux, p.y AS uy, q.x AS wx, q.y AS wy FROM rv p JOIN rv q ON p.vid <> q.vid WHERE NOT EXISTS (SELECT 1 FROM rv r WHERE r.vid <> p.vid AND r.vid <> q.vid AND (q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x) <= 0))"""))
def rim_cap(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    a, b, c = (tuple(F.col(f"{s}{k}") for k in "xyz") for s in "abc")
    return topology.boundary_cap(shell, v, _frame(v)).agg(F.count("*").alias("triangles"), _r(F.sum(g.triangle_area(a, b, c)), "area"))


@_query(_on_cup(f"SELECT vid, {r6('-z', 'height')} FROM vs ORDER BY z, vid LIMIT 1", SHELL))
def pole_vertex(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    frame = _sphere(v).join(_frame(v).select("mesh_id", "ax", "ay", "az"), "mesh_id")
    return _rounded(meridian.farthest(topology.used_vertices(v, shell), frame))


EVENTS = """
ev AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, CAST(epoch_us(ts) AS DOUBLE)/1e6 AS tm FROM events WHERE value IS NOT NULL),
ea AS (SELECT *, tm - FIRST_VALUE(tm) OVER (PARTITION BY user_id ORDER BY seq) AS arc FROM ev),
e1 AS (SELECT *, CASE WHEN COALESCE(LEAD(arc) OVER w, arc)-COALESCE(LAG(arc) OVER w, arc) > 1e-12 THEN (COALESCE(LEAD(value) OVER w, value)-COALESCE(LAG(value) OVER w, value))/(COALESCE(LEAD(arc) OVER w, arc)-COALESCE(LAG(arc) OVER w, arc)) ELSE 0 END AS d1 FROM ea WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
e2 AS MATERIALIZED (SELECT *, CASE WHEN LEAD(arc) OVER w-LAG(arc) OVER w > 1e-12 THEN (LEAD(d1) OVER w-LAG(d1) OVER w)/(LEAD(arc) OVER w-LAG(arc) OVER w) ELSE 0 END AS d2 FROM e1 WINDOW w AS (PARTITION BY user_id ORDER BY seq))"""


def _event_series(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value IS NOT NULL")
    rows = rows.selectExpr("user_id", "value", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6D AS at")
    rows = rows.selectExpr("*", "at - first_value(at) OVER (PARTITION BY user_id ORDER BY seq) AS arc")
    return meridian.series(rows, ["user_id"], ["seq"], "arc", "value")


@_query("WITH " + EVENTS + f" SELECT user_id, CAST(seq AS BIGINT) AS seq, {r6('arc', 'arc')}, {r6('d1*1000', 'd1')}, {r6('d2*1000000', 'd2')} FROM e2")
def event_derivatives(spark, sf_dir):
    return _event_series(spark, sf_dir).select("user_id", F.col("seq").cast("long").alias("seq"), _r("arc"), _r(F.col("d1") * 1000, "d1"), _r(F.col("d2") * 1000000, "d2"))


@_query("WITH " + EVENTS + """, er AS (SELECT *, ABS(d2) > 1e-9 AS hit, CASE WHEN ABS(d2) > 1e-9 AND NOT COALESCE(LAG(ABS(d2) > 1e-9) OVER w, FALSE) THEN 1 ELSE 0 END AS start FROM e2 WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
es AS (SELECT *, SUM(start) OVER (PARTITION BY user_id ORDER BY seq) AS run FROM er)
SELECT user_id, CAST(run AS BIGINT) AS run, CAST(MIN(seq) AS BIGINT) AS first, CAST(MAX(seq) AS BIGINT) AS last, COUNT(*) AS n FROM es WHERE hit GROUP BY user_id, run""")
def irregular_runs(spark, sf_dir):
    rows = meridian.irregular_runs(_event_series(spark, sf_dir), ["user_id"], 1e-9)
    return rows.select("user_id", *[F.col(c).cast("long").alias(c) for c in ("run", "first", "last", "n")])


@_query("WITH " + EVENTS + f""", er AS (SELECT *, ABS(d2) > 1e-9 AS hit, CASE WHEN ABS(d2) > 1e-9 AND NOT COALESCE(LAG(ABS(d2) > 1e-9) OVER w, FALSE) THEN 1 ELSE 0 END AS start FROM e2 WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
es AS (SELECT *, SUM(start) OVER (PARTITION BY user_id ORDER BY seq) AS run FROM er)
SELECT user_id, CAST(run AS BIGINT) AS run, CAST(seq AS BIGINT) AS peak, {r6('ABS(d2)*1000000', 'peak_value')}, {r6('LEAST((ABS(d2)-1e-9)/1e-9, 1.0)', 'severity')} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ABS(d2) DESC, seq) AS k FROM es WHERE hit) WHERE k = 1""")
def irregular_peaks(spark, sf_dir):
    """The highest point of each run and how far it is beyond the threshold."""
    rows = meridian.irregular_runs(_event_series(spark, sf_dir), ["user_id"], 1e-9)
    return rows.select("user_id", F.col("run").cast("long").alias("run"), F.col("peak").cast("long").alias("peak"), _r(F.col("peak_value") * 1000000, "peak_value"), _r(meridian.severity(F.col("peak_value"), 1e-9), "severity"))


@_query(_on_cup("SELECT vid, " + ", ".join(f"ROUND(CAST(CAST({c}-m{c} AS FLOAT) AS DOUBLE), 4) + 0.0 AS {c}" for c in "xyz") + " FROM v, (SELECT " + ", ".join(f"(MIN({c})+MAX({c}))/2 AS m{c}" for c in "xyz") + " FROM v)"))
def centred_vertices(spark, sf_dir):
    v, _, _ = _cup(spark, sf_dir)
    return topology.centred(v).select("vid", *[(F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in "xyz"])


@_query(_on_cup(f"SELECT DISTINCT dst AS vid, {r6('SQRT((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))', 'w')} FROM (SELECT UNNEST([[i0, i1], [i1, i0], [i1, i2], [i2, i1], [i2, i0], [i0, i2]]) AS s FROM f), LATERAL (SELECT s[1] AS src, s[2] AS dst) JOIN v p ON p.vid = src JOIN v q ON q.vid = dst WHERE src = (SELECT np FROM n)"))
def last_vertex_neighbours(spark, sf_dir):
    """The neighbours of the inner shell's last vertex and how far they are."""
    v, f, _ = _cup(spark, sf_dir)
    return _rounded(topology.neighbours(topology.adjacency(f, v), v.count() // 2 - 1))


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN r >= 20 OR 20-r <= 0.2 THEN 20.0 WHEN r >= 18 OR 18-r <= 0.2 THEN 18.0 WHEN r >= 16 OR 16-r <= 0.2 THEN 16.0 ELSE 14.0 END::DOUBLE AS radius FROM (SELECT l_orderkey, l_linenumber, 12.1+l_quantity/5 AS r FROM lineitem)")
def snapped_radii(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", fit.snap_radius(F.lit(12.1) + F.col("l_quantity") / 5).alias("radius"))


def _item_points(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("mesh_id"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"), "l_extendedprice")


_P = {"n": "1e0", "x": "x", "y": "y", "z": "z", "xx": "x*x", "xy": "x*y", "xz": "x*z", "yy": "y*y", "yz": "y*z", "zz": "z*z", "q": "q", "xq": "x*q", "yq": "y*q", "zq": "z*q"}


@_query(f"WITH p AS (SELECT *, x*x+y*y+z*z AS q FROM (SELECT l_returnflag AS f, l_quantity AS x, l_discount*100 AS y, l_tax*100 AS z FROM lineitem)) SELECT f AS mesh, {', '.join(f'ROUND(SUM({e}), 2) AS s_{k}' for k, e in _P.items())} FROM p GROUP BY f")
def lineitem_moments(spark, sf_dir):
    rows = fit.sphere_moments(_item_points(spark, sf_dir), ["mesh_id"])
    return rows.select(F.col("mesh_id").alias("mesh"), *[F.round(c, 2).alias(c) for c in rows.columns if c != "mesh_id"])


@_query("SELECT f AS mesh, MAX(p) FILTER (k = FLOOR(c*0.25)) AS q1, MAX(p) FILTER (k = FLOOR(c*0.5)) AS q2, MAX(p) FILTER (k = FLOOR(c*0.75)) AS q3 FROM (SELECT l_returnflag AS f, l_extendedprice AS p, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, COUNT(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem) GROUP BY f")
def order_statistics(spark, sf_dir):
    return select.order_statistics(_item_points(spark, sf_dir), "l_extendedprice", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).withColumnRenamed("mesh_id", "mesh")


def _cloud(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.lit("cloud").alias("mesh_id"), F.when(F.col("embedding")[3] > 0, "bump").otherwise("dip").alias("type"), F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")], (F.col("embedding")[3].cast("double") * 30).alias("dev"))


EPS = 0.05
CLOUD = "c AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN embedding[4] > 0 THEN 'bump' ELSE 'dip' END AS type, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE)*30 AS dev FROM embeddings), pr AS MATERIALIZED (SELECT a.type, a.id AS a, b.id AS b FROM c a JOIN c b ON a.type = b.type AND SQRT((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 0.05)"


@_query("WITH " + CLOUD + " SELECT type, a, b FROM pr")
def near_pairs(spark, sf_dir):
    return cluster.near_pairs(_cloud(spark, sf_dir), ["mesh_id", "type"], EPS).drop("mesh_id")


CLUSTERS = CLOUD + """, co AS (SELECT type, a AS id FROM pr GROUP BY type, a HAVING COUNT(*) >= 3), cl AS (SELECT pr.type, a, b FROM pr JOIN co p ON p.id = a JOIN co q ON q.id = b),
wk(a, b) AS (SELECT a, b FROM cl UNION SELECT wk.a, cl.b FROM wk JOIN cl ON wk.b = cl.a), lb AS (SELECT a AS id, MIN(b) AS seed FROM wk GROUP BY a),
bo AS (SELECT b AS id, MIN(seed) AS seed FROM pr JOIN lb ON lb.id = a GROUP BY b),
al AS (SELECT c.*, COALESCE(lb.seed, bo.seed, c.id) AS seed, CASE WHEN COALESCE(lb.seed, bo.seed) IS NULL THEN 1 ELSE 0 END AS late FROM c LEFT JOIN lb ON lb.id = c.id LEFT JOIN bo ON bo.id = c.id WHERE COALESCE(lb.seed, bo.seed) IS NOT NULL OR ABS(dev) > 5),
mb AS MATERIALIZED (SELECT *, CAST(dense_rank() OVER (ORDER BY type, late, seed) - 1 AS INTEGER) AS cluster_id FROM al)"""


@_query("WITH RECURSIVE " + CLUSTERS + " SELECT id, type, cluster_id FROM mb")
def point_clusters(spark, sf_dir):
    return cluster.dbscan(_cloud(spark, sf_dir), EPS).select("id", "type", "cluster_id")


@_query("WITH RECURSIVE " + CLUSTERS + f""", cc AS (SELECT cluster_id, AVG(x) AS cx, AVG(y) AS cy, AVG(z) AS cz FROM mb GROUP BY cluster_id)
SELECT cluster_id, type, COUNT(*) AS n_points, {r6('ANY_VALUE(cx)', 'cx')}, {r6('ANY_VALUE(cy)', 'cy')}, {r6('ANY_VALUE(cz)', 'cz')}, {r6('MAX((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))*PI()', 'area')}, {r6('AVG(dev)', 'avg_dev')}, {r6('MAX(dev)', 'max_dev')}, {r6('MIN(dev)', 'min_dev')}
FROM mb JOIN cc USING (cluster_id) GROUP BY cluster_id, type""")
def cluster_summaries(spark, sf_dir):
    rows = cluster.cluster_summaries(stored(cluster.dbscan(_cloud(spark, sf_dir), EPS)))
    return _rounded(rows.select("mesh_id", "cluster_id", "type", "n_points", "cx", "cy", "cz", "area", "avg_dev", "max_dev", "min_dev"))


@_query(_on_cup("SELECT arg_max(vid, e) AS max_vid, MAX(e) AS max_value, arg_min(vid, e) AS min_vid, MIN(e) AS min_value FROM (SELECT vid, ROUND((SQRT(x*x+y*y+z*z)-16)*1000, 6) + vid*1e-6 AS e FROM vs WHERE vid % GREATEST(1, FLOOR((np+1)/50000)) = 0)", SHELL))
def label_extremes(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    p = topology.used_vertices(v, shell).withColumn("e", F.round((g.length(g.point()) - 16) * 1000, 6) + F.col("vid") * 1e-6)
    return select.strided_extremes(p, "e").drop("mesh_id")


@_query(_on_cup("SELECT fid, CAST(0 AS INTEGER) AS corner, a.x, a.y, a.z FROM f JOIN v a ON a.vid = i0 UNION ALL SELECT fid, 1, a.x, a.y, a.z FROM f JOIN v a ON a.vid = i1 UNION ALL SELECT fid, 2, a.x, a.y, a.z FROM f JOIN v a ON a.vid = i2"))
def stl_round_trip(spark, sf_dir):
    """Faces written as STL files, a part for each task, and read back by ranges of records."""
    v, f, _ = _cup(spark, sf_dir)
    return _stl_files(spark, v, f).select("fid", "corner", *[F.col(c).cast("double").alias(c) for c in "xyz"])


def _stl_files(spark: SparkSession, v: DataFrame, f: DataFrame) -> DataFrame:
    """Corners of the files that ``f`` is written to, with the fid of their faces."""
    path = shared_path(spark)
    stl.save(f, v, path, 6)
    spark.dataSource.register(stl_files.StlFiles)
    rows = spark.read.format("stl").option("facets", 5000).load(path)
    # a face's place in the files: after those of the parts before
    parts = rows.groupBy("mesh_id").agg((F.max("fid") + 1).alias("n"))
    before = F.sum("n").over(W.orderBy("mesh_id").rowsBetween(W.unboundedPreceding, -1))  # one row for each part
    rows = with_mesh(rows, parts.select("mesh_id", F.coalesce(before, F.lit(0)).alias("before"))).withColumn("place", F.col("fid") + F.col("before"))
    return rows.drop("fid", "mesh_id").join(topology.numbered(f.select("mesh_id", "fid"), "fid", "place"), "place")


@_query(_on_cup(f"""SELECT fid, CAST({RGB} AS INTEGER) AS attribute FROM (SELECT fid, e, LEAST(1.0, ABS(e)/50) AS t FROM (SELECT fid, (a.d + b.d + c.d)/3 AS e FROM f JOIN dv a ON a.vid = i0 JOIN dv b ON b.vid = i1 JOIN dv c ON c.vid = i2))""",
  "dv AS MATERIALIZED (SELECT vid, (SQRT(x*x+y*y+z*z)-16)*1000 AS d FROM v)"))
def stl_colours(spark, sf_dir):
    """The colours of the files' facets, which tell the mean deviation of their corners."""
    v, f, _ = _cup(spark, sf_dir)
    return _stl_files(spark, v.withColumn("deviation", (g.length(g.point()) - 16) * 1000), f).filter("corner = 0").select("fid", "attribute")


_COV = ", ".join(f"AVG(({a}-m{a})*({b}-m{b})) AS c{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j)


@_query(_on_cup(f"""SELECT {", ".join(r6(c, c) for c in ("rx", "ry", "rz"))}, pole_vid, {", ".join(r6(c, c) for c in ("depth", "px", "py", "pz", "ax", "ay", "az"))}, {", ".join(r6(f"r{c}+n{c}*sg*0.06*ABS(h)", f"q{c}") for c in "xyz")}, {", ".join(r6(f"n{c}*sg", f"n{c}") for c in "xyz")} FROM
  (SELECT *, CASE WHEN h < 0 THEN -1 ELSE 1 END AS sg, (px-rx)/l AS ax, (py-ry)/l AS ay, (pz-rz)/l AS az FROM (SELECT *, (px-rx)*nx+(py-ry)*ny+(pz-rz)*nz AS h, SQRT((px-rx)*(px-rx)+(py-ry)*(py-ry)+(pz-rz)*(pz-rz)) AS l FROM pp, rn))""",
                GALL, INNER, EDGES.format("ic"), f"""
rb AS (SELECT x, y, z FROM v WHERE vid IN (SELECT UNNEST([a, b]) FROM e WHERE uses = 1)),
rm AS (SELECT AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz FROM rb),
rc AS (SELECT {_COV} FROM rb, rm)""", _least_axis("rc", "re"), """
rn AS (SELECT mx AS rx, my AS ry, mz AS rz, ex*g AS nx, ey*g AS ny, ez*g AS nz FROM rm, (SELECT *, CASE WHEN GREATEST(ex, ey, ez) >= GREATEST(-ex, -ey, -ez) THEN 1 ELSE -1 END AS g FROM re)),
ru AS (SELECT vid, x, y, z, (x-rx)*nx+(y-ry)*ny+(z-rz)*nz AS d FROM v, rn WHERE vid IN (SELECT UNNEST([i0, i1, i2]) FROM ic)),
pp AS (SELECT vid AS pole_vid, d*g AS depth, x AS px, y AS py, z AS pz FROM ru, (SELECT CASE WHEN SUM(d) >= 0 THEN 1 ELSE -1 END AS g FROM ru) ORDER BY d*g DESC, vid LIMIT 1)"""))
def rim_and_pole(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    inner = stored(select.inner_candidates(f, v))
    used = stored(topology.used_vertices(v, inner))
    return _rounded(select.rim_plane(select.pole(used, select.rim_frame(inner, used))))


#: The rim is the only boundary of the shell. Distances shrink until none does.
RIM = EDGES.format("fs") + """, ew AS MATERIALIZED (SELECT src, dst, SQRT((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) AS w FROM (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e) JOIN v p ON p.vid = src JOIN v q ON q.vid = dst),
rd(vid, dist) USING KEY (vid) AS (SELECT DISTINCT UNNEST([a, b]), 0e0 FROM e WHERE uses = 1 UNION SELECT s.dst, MIN(s.d) FROM (SELECT dst, rd.dist + w AS d FROM rd JOIN ew ON src = rd.vid) s LEFT JOIN recurring.rd r ON r.vid = s.dst WHERE r.dist IS NULL OR s.d < r.dist GROUP BY s.dst)"""


@_query(_on_cup(f"SELECT vid, {r6('dist', 'dist')} FROM rd", SHELL, RIM))
def rim_distances(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    return _rounded(select.rim_distances(shell, v))


@_query(_on_cup(f"SELECT p.vid, {r6('p.dist', 'dist')}, MIN(src) AS pred FROM rd p LEFT JOIN (SELECT dst, src, rd.dist + w AS d FROM ew JOIN rd ON src = rd.vid WHERE w > 0) e ON e.dst = p.vid AND e.d = p.dist GROUP BY p.vid, p.dist", SHELL, RIM))
def rim_paths(spark, sf_dir):
    """Distances and predecessors from the rim, over some eight blocks."""
    v, _, shell = _cup(spark, sf_dir)
    edges = stored(topology.adjacency(shell, v))
    rim = stored(topology.boundary_loops(shell).filter("is_rim").select("mesh_id", "vid"))
    return _rounded(graph.shortest_paths(edges, rim, min(max(v.count() // 16, 50), graph.BLOCK)))


@_query(_on_cup("SELECT fid, i0, i1, i2, COALESCE(a.dist > m, TRUE) AND COALESCE(b.dist > m, TRUE) AND COALESCE(c.dist > m, TRUE) AS kept FROM fs LEFT JOIN rd a ON a.vid = i0 LEFT JOIN rd b ON b.vid = i1 LEFT JOIN rd c ON c.vid = i2, (SELECT MAX(dist)*0.06 AS m FROM rd)", SHELL, RIM))
def trimmed_faces(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    return select.trim(shell, v).drop("mesh_id")


@_query()
def filled_holes(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    v = cup.cup(spark, sf_dir, normals=True)[0]
    inner = stored(select.inner_candidates(f, v))
    return smooth.fill_holes(stored(topology.used_vertices(v, inner)), inner)[1].drop("mesh_id")


def _reweighted(k: int) -> str:
    """The k-th fit with bisquare weights, by the normal equations about the weighted mean; b0 is the plain fit."""
    return f"""
w{k} AS MATERIALIZED (SELECT x, y, z, CASE WHEN u < 1 THEN (1-u*u)*(1-u*u) ELSE 0 END AS wt FROM (SELECT x, y, z, ABS(SQRT((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))-radius)/(3*GREATEST(rms, 1e-6)) AS u FROM vs, b{k - 1})),
wc{k} AS (SELECT SUM(wt*x)/SUM(wt) AS mx, SUM(wt*y)/SUM(wt) AS my, SUM(wt*z)/SUM(wt) AS mz FROM w{k}),
wu{k} AS (SELECT wt, x-mx AS u, y-my AS w, z-mz AS s, (x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz) AS q FROM w{k}, wc{k}),
wm{k} AS (SELECT SUM(wt*u*u) AS a, SUM(wt*u*w) AS b, SUM(wt*u*s) AS e, SUM(wt*w*w) AS d, SUM(wt*w*s) AS h, SUM(wt*s*s) AS k, SUM(wt*u*q) AS p, SUM(wt*w*q) AS r, SUM(wt*s*q) AS o, SUM(wt*q)/SUM(wt) AS m FROM wu{k}),
wd{k} AS (SELECT *, a*(d*k-h*h)-b*(b*k-h*e)+e*(b*h-d*e) AS det FROM wm{k}),
wx{k} AS (SELECT m, (p*(d*k-h*h)-b*(r*k-h*o)+e*(r*h-d*o))/det AS a1, (a*(r*k-o*h)-p*(b*k-h*e)+e*(b*o-r*e))/det AS a2, (a*(d*o-h*r)-b*(b*o-r*e)+p*(b*h-d*e))/det AS a3 FROM wd{k}),
wp{k} AS (SELECT mx+a1/2 AS cx, my+a2/2 AS cy, mz+a3/2 AS cz, SQRT(m+(a1*a1+a2*a2+a3*a3)/4) AS radius FROM wx{k}, wc{k}),
b{k} AS MATERIALIZED (SELECT cx, cy, cz, radius, COALESCE(SQRT(AVG(e*e) FILTER (wt > 0.01)), 0) AS rms, MAX(ABS(e)) AS max_residual FROM (SELECT *, SQRT((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))-radius AS e FROM w{k}, wp{k}) GROUP BY cx, cy, cz, radius)"""


@_query(_on_cup(f"SELECT {', '.join(r6(c, c) for c in ('cx', 'cy', 'cz', 'radius', 'rms', 'max_residual'))} FROM b5", SHELL, FIT, "b0 AS (SELECT cx, cy, cz, radius, SQRT(AVG(e*e)) AS rms FROM sp, rs GROUP BY cx, cy, cz, radius)", *[_reweighted(k) for k in range(1, 6)]))
def robust_sphere(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    return _rounded(fit.fit_sphere_robust(stored(topology.used_vertices(v, shell))))


_LENGTH = "SQRT((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))"


def _fixed_steps(steps: int = 30, moves: int = 100) -> list[str]:
    """Steps of the fit of radius 16, then moves away from the points inside, until there are none."""
    fit_ = ", ".join(f"SUM(CASE WHEN h >= 1e-12 THEN {c}-({c}-c{c})*(16/h) ELSE 0 END)/COUNT(*) AS c{c}" for c in "xyz")
    move = ", ".join(f"ANY_VALUE(c{c})-COALESCE(SUM(({c}-c{c})/GREATEST(h, 1e-12)*(16-h)) FILTER (h < 16)/COUNT(*) FILTER (h < 16), 0) AS c{c}" for c in "xyz")
    return [f"zc{k} AS MATERIALIZED (SELECT zone, {fit_ if k <= steps else move} FROM (SELECT *, {_LENGTH} AS h FROM zp JOIN zc{k - 1} USING (zone)) GROUP BY zone)" for k in range(1, steps + moves + 1)]


@_query(_on_cup(f"SELECT zone, {', '.join(r6(c, c) for c in ('cx', 'cy', 'cz'))}, 16e0 AS radius, {r6(f'SQRT(AVG(({_LENGTH}-16)*({_LENGTH}-16)))', 'rms')} FROM zp JOIN zc130 USING (zone) GROUP BY zone, cx, cy, cz", SHELL, """
zp AS MATERIALIZED (SELECT CASE WHEN SQRT(x*x+y*y+z*z) > 16.32 THEN 'worn' ELSE 'unworn' END AS zone, x, y, z FROM vs WHERE z <= -1),
zc0 AS (SELECT zone, AVG(x) AS cx, AVG(y) AS cy, AVG(z) AS cz FROM zp GROUP BY zone)""", *_fixed_steps()))
def zone_spheres(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    c = select.classify(topology.used_vertices(v, shell), _sphere(v), _frame(v)).filter("active")
    return _rounded(fit.fit_fixed_radius(stored(c.select("mesh_id", F.when(F.col("worn"), "worn").otherwise("unworn").alias("zone"), "x", "y", "z", F.lit(16.0).alias("radius")))))


@_query()
def ellipsoid(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    rows = fit.fit_ellipsoid(topology.used_vertices(v, shell))
    return rows.select(_r("cx"), _r("cy"), _r("cz"), *[_r(F.col("semi_axes")[k], f"axis_{k}") for k in range(3)], _r("sphericity"), "shape", "definite", _r("rms"))


@_query(_on_cup(f"SELECT {r6('ex*g', 'ax')}, {r6('ey*g', 'ay')}, {r6('ez*g', 'az')} FROM xe, (SELECT CASE WHEN COUNT(*) FILTER ((x-mx)*ex+(y-my)*ey+(z-mz)*ez > 0) > COUNT(*)/2e0 THEN -1 ELSE 1 END AS g FROM vs, xm, xe)", SHELL, f"""
xm AS (SELECT AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz FROM v),
xc AS (SELECT {_COV} FROM vs, xm)""", _least_axis("xc", "xe")))
def cup_axis(spark, sf_dir):
    v, _, shell = _cup(spark, sf_dir)
    used = stored(topology.used_vertices(v, shell))
    origin = v.groupBy("mesh_id").agg(*[F.avg(F.col(c).cast("double")).alias(f"o{c}") for c in "xyz"])
    return _rounded(fit.cup_axis(used, origin))


_PANEL = [
    ("Summary", "Vertices", "(SELECT COUNT(*) FROM vs)", None, "NULL"), ("Summary", "Faces", "(SELECT COUNT(*) FROM fs)", None, "NULL"), ("Summary", "Geodesics", "360", None, "NULL"),
    ("Summary", "Worn Vertices", "w", None, "CASE WHEN w > 0 THEN 'danger' ELSE 'success' END"), ("Summary", "Worn %", "100*w/a", "%", "CASE WHEN 100*w/a > 5 THEN 'danger' ELSE 'success' END"),
    ("Summary", "Wear Volume", "v", "mm3", "CASE WHEN v > 0.1 THEN 'danger' ELSE 'success' END"), ("Summary", "Linear Wear", "NULL", "um", "NULL"),
    ("Sphere Fit", "Radius", "sp.radius", "mm", "NULL"), ("Sphere Fit", "Center X", "sp.cx", "mm", "NULL"), ("Sphere Fit", "Center Y", "sp.cy", "mm", "NULL"), ("Sphere Fit", "Center Z", "sp.cz", "mm", "NULL"),
    ("Sphere Fit", "RMS Error", "1000*(SELECT SQRT(AVG(e*e)) FROM rs)", "um", "NULL"), ("Sphere Fit", "Max Error", "1000*(SELECT MAX(ABS(e)) FROM rs)", "um", "NULL"),
    ("Commercial Sphere", "Geodesic Radius", "sp.radius", "mm", "NULL"), ("Commercial Sphere", "Commercial Radius", "16", "mm", "NULL"), ("Commercial Sphere", "Detection", "NULL", None, "NULL"),
    ("Commercial Sphere", "Center X", "sp.cx", "mm", "NULL"), ("Commercial Sphere", "Center Y", "sp.cy", "mm", "NULL"), ("Commercial Sphere", "Center Z", "sp.cz", "mm", "NULL"),
    ("Wear Classification", "Threshold", "16.32", "mm", "NULL"), ("Wear Classification", "Worn Vertices", "w", None, "CASE WHEN w > 0 THEN 'danger' ELSE 'success' END"), ("Wear Classification", "Unworn Vertices", "a-w", None, "'success'"),
    ("Wear Classification", "Worn %", "100*w/a", "%", "CASE WHEN 100*w/a > 10 THEN 'danger' WHEN 100*w/a > 2 THEN 'warning' ELSE 'success' END"),
    ("Zone Spheres", "Linear Wear", "NULL", "um", "NULL"), ("Zone Spheres", "Worn Sphere RMS", "NULL", "um", "NULL"), ("Zone Spheres", "Unworn Sphere RMS", "NULL", "um", "NULL"),
    ("Wear Volume", "Mesh Enclosed Vol", "e", "mm3", "NULL"), ("Wear Volume", "Sphere Cap Vol", "c", "mm3", "NULL"), ("Wear Volume", "Wear Volume", "v", "mm3", "CASE WHEN v > 0.1 THEN 'danger' ELSE 'success' END"),
    ("Wear Volume", "Wear Mass", "v*0.935", "mg", "CASE WHEN v > 0.1 THEN 'danger' ELSE 'success' END"),
    ("Maximum Wear Point", "Max Wear Depth", "m", "um", "CASE WHEN m > 10 THEN 'danger' WHEN m > 5 THEN 'warning' ELSE 'success' END"), ("Maximum Wear Point", "Point X", "px", "mm", "NULL"), ("Maximum Wear Point", "Point Y", "py", "mm", "NULL"), ("Maximum Wear Point", "Point Z", "pz", "mm", "NULL"),
]
_PANEL_SQL = " UNION ALL ".join(
    f"SELECT {k} AS place, '{s}' AS section, '{n}' AS metric, {r6(f'CAST({v} AS DOUBLE)', 'value')}, {'CASE WHEN 16 > sp.radius THEN ' + repr('Auto (snap up)') + ' ELSE ' + repr('Auto (round down)') + ' END' if n == 'Detection' else 'NULL'} AS text, {repr(u) if u else 'NULL'} AS unit, {j} AS severity FROM sp, pc, pv, pm"
    for k, (s, n, v, u, j) in enumerate(_PANEL))


@_query(_on_cup(_PANEL_SQL, SHELL, FIT, GSHELL, f"""
pr AS (SELECT vid, x, y, z, SQRT(x*x+y*y+z*z) AS r FROM vs WHERE z <= -1),
pc AS (SELECT CAST(COUNT(*) FILTER (r > 16.32) AS DOUBLE) AS w, CAST(COUNT(*) AS DOUBLE) AS a FROM pr),
pv AS (SELECT e, c, GREATEST(0, e-c) AS v FROM (SELECT e, PI()/3*15*15*33 AS c FROM {ENCLOSED})),
pm AS (SELECT (r-16)*1000 AS m, x AS px, y AS py, z AS pz FROM pr ORDER BY (r-16)*1000 DESC, vid LIMIT 1)"""))
def panel_best_fit(spark, sf_dir):
    """The panel of the best-fit mode for the cup in its own frame: sphere, classification, volumes and the deepest point; zones are left out."""
    v, _, shell = _cup(spark, sf_dir)
    points, frame, sphere = stored(topology.used_vertices(v, shell)), _frame(v), _sphere(v)
    classified = stored(select.classify(points, sphere, frame))
    plane = volume.wear_plane(classified, frame).select("mesh_id", F.col("max_depth").alias("max_wear_depth"), *[F.col(c).alias(f"max_wear_{c}") for c in "xyz"])
    rows = fit.fit_sphere(points).withColumnRenamed("radius", "fitted_radius")
    for part in (sphere.select("mesh_id", "radius"), select.wear_summary(classified), volume.wear_volume(volume.enclosed_volume(shell, v, frame), sphere, frame), plane, points.groupBy("mesh_id").agg(F.count("*").alias("inner_vertices")), shell.groupBy("mesh_id").agg(F.count("*").alias("inner_faces"))):
        rows = with_mesh(rows, part)
    rows = rows.withColumns({"wear_mass": F.col("wear_volume") * volume.DENSITY, "meridians": F.lit(360), "manual": F.lit(False), **{c: F.lit(None).cast("double") for c in ("linear_wear", "worn_rms", "unworn_rms")}})
    return report.panel(rows, "sphere-bestfit").select("place", "section", "metric", _r("value"), "text", "unit", "severity")


@_query()
def analysis_best_fit(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    return report.metrics(stored(analysis.best_fit(v, f))).select("metric", _r("value"), "unit", "severity")


@_query()
def analysis_pure(spark, sf_dir):
    v, f, _ = _cup(spark, sf_dir)
    rows = analysis.pure(v, f)[0]
    return _rounded(rows.drop("semi_axes"))


