"""A closed cup derived from ``part``: the mesh that the queries over the given tables analyse.

Row k of ``part`` is sector k mod 40 of ring k div 40 of the inner and the outer shell; ``p_size`` roughens the inner
one, a lobe on one side is worn. Directions use only + - * / sqrt, so every engine gets the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshloom.operators.topology import vertex_normals

MESH = "cup"

_SHAPE = """
h AS (SELECT k, np, sz, (ring+1E0)/rings AS t,
        CASE WHEN sec<10 THEN -1E0+sec/5E0 WHEN sec<20 THEN 1E0 WHEN sec<30 THEN 1E0-(sec-20E0)/5E0 ELSE -1E0 END AS qx,
        CASE WHEN sec<10 THEN -1E0 WHEN sec<20 THEN -1E0+(sec-10E0)/5E0 WHEN sec<30 THEN 1E0 ELSE 1E0-(sec-30E0)/5E0 END AS qy
      FROM g),
d AS (SELECT k, np, qx/SQRT(qx*qx+qy*qy) AS dx, qy/SQRT(qx*qx+qy*qy) AS dy,
        t/SQRT(t*t+(1E0-t)*(1E0-t)) AS rho, (1E0-t)/SQRT(t*t+(1E0-t)*(1E0-t)) AS ze,
        16.05E0 + sz/10000E0 + CASE WHEN qx>0.5E0 AND t<0.6E0 THEN 0.6E0*(0.6E0-t) ELSE 0E0 END AS ri FROM h)"""
_POINTS = """
SELECT CAST(0 AS BIGINT) AS vid, CAST(0E0 AS FLOAT) AS x, CAST(0E0 AS FLOAT) AS y, CAST(-16.05E0 AS FLOAT) AS z {one}
UNION ALL SELECT k+1, CAST(ri*rho*dx AS FLOAT), CAST(ri*rho*dy AS FLOAT), CAST(-ri*ze AS FLOAT) FROM d
UNION ALL SELECT {np}+1, CAST(0E0 AS FLOAT), CAST(0E0 AS FLOAT), CAST(-22E0 AS FLOAT) {one}
UNION ALL SELECT {np}+2+k, CAST(22E0*rho*dx AS FLOAT), CAST(22E0*rho*dy AS FLOAT), CAST(-22E0*ze AS FLOAT) FROM d"""
_FACES = """
SELECT k AS fid, CAST(0 AS BIGINT) AS i0, a AS i1, b AS i2 FROM q WHERE k<40
UNION ALL SELECT np+2*k, a, a+40, b+40 FROM q WHERE k<np-40
UNION ALL SELECT np+2*k+1, a, b+40, b FROM q WHERE k<np-40
UNION ALL SELECT 4*np+k, np+1+b, np+1+a, np+1 FROM q WHERE k<40
UNION ALL SELECT 5*np+2*k, np+1+b+40, np+1+a+40, np+1+a FROM q WHERE k<np-40
UNION ALL SELECT 5*np+2*k+1, np+1+b, np+1+b+40, np+1+a FROM q WHERE k<np-40
UNION ALL SELECT 8*np+2*(k-(np-40)), a, np+1+a, np+1+b FROM q WHERE k>=np-40
UNION ALL SELECT 8*np+2*(k-(np-40))+1, a, np+1+b, b FROM q WHERE k>=np-40"""

#: CTEs v (vid, x, y, z as doubles) and f (fid, i0, i1, i2) for the oracles.
ORACLE = f"""
n AS (SELECT COUNT(*) AS np, CAST(COUNT(*) AS DOUBLE)/40E0 AS rings FROM part),
g AS (SELECT p_partkey AS k, CAST(FLOOR(p_partkey/40E0) AS DOUBLE) AS ring, CAST(p_partkey%40 AS DOUBLE) AS sec, CAST(p_size AS DOUBLE) AS sz, np, rings FROM part CROSS JOIN n),
{_SHAPE.strip()},
v AS MATERIALIZED (SELECT vid, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM ({_POINTS.format(one='FROM n', np='np')})),
q AS (SELECT p_partkey AS k, np, p_partkey+1 AS a, p_partkey-(p_partkey%40)+((p_partkey%40)+1)%40+1 AS b FROM part CROSS JOIN n),
f AS MATERIALIZED ({_FACES})"""


def cup(spark: SparkSession, sf_dir: str, normals: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the cup; with ``normals``, also the area-weighted normals of its vertices."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    np = part.count()
    rows = f"""SELECT p_partkey AS k, CAST(FLOOR(p_partkey/40E0) AS DOUBLE) AS ring, CAST(p_partkey%40 AS DOUBLE) AS sec,
        CAST(p_size AS DOUBLE) AS sz, CAST({np} AS BIGINT) AS np, {np}E0/40E0 AS rings FROM {{part}}"""
    points = spark.sql(f"WITH g AS ({rows}), {_SHAPE} SELECT '{MESH}' AS mesh_id, * FROM ({_POINTS.format(one='', np=f'CAST({np} AS BIGINT)')})", part=part)
    quads = f"SELECT p_partkey AS k, CAST({np} AS BIGINT) AS np, p_partkey+1 AS a, p_partkey-(p_partkey%40)+((p_partkey%40)+1)%40+1 AS b FROM {{part}}"
    faces = spark.sql(f"WITH q AS ({quads}) SELECT '{MESH}' AS mesh_id, * FROM ({_FACES})", part=part)
    return (vertex_normals(points, faces) if normals else points), faces
