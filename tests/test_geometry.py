import math
import random

import pytest
from pyspark.sql import functions as F

from meshloom.functions import geometry as g


def test_scalars(spark):
    rng = random.Random(1)
    rows = [tuple(rng.uniform(-30, 30) for _ in range(12)) for _ in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{p}{c} double" for p in "abcd" for c in "xyz"))
    a, b, c, d = (tuple(F.col(f"{p}{k}") for k in "xyz") for p in "abcd")
    u, v, w = g.local_frame(g.normalized(a))
    got = df.select("*", g.tetra_volume(a, b, c, d).alias("vol"), *[x.alias(f"n{i}") for i, x in enumerate(g.face_normal(a, b, c))], *[g.dot(p, q).alias(f"o{i}") for i, (p, q) in enumerate([(u, v), (v, w), (u, w), (u, u), (v, v)])], *[x.alias(f"s{i}") for i, x in enumerate(g.project_onto_sphere(a, b, F.lit(5.0)))]).collect()
    for r in got:
        p = [[r[f"{n}{k}"] for k in "xyz"] for n in "abcd"]
        e = [[x - y for x, y in zip(p[i], p[0], strict=True)] for i in (1, 2, 3)]
        det = sum(e[0][i] * (e[1][(i + 1) % 3] * e[2][(i + 2) % 3] - e[1][(i + 2) % 3] * e[2][(i + 1) % 3]) for i in range(3))
        assert r.vol == pytest.approx(det / 6)
        assert abs(sum(r[f"n{i}"] * e[0][i] for i in range(3))) < 1e-9
        assert [r.o0, r.o1, r.o2] == pytest.approx([0, 0, 0], abs=1e-9) and [r.o3, r.o4] == pytest.approx([1, 1])
        assert math.dist([r.s0, r.s1, r.s2], p[1]) == pytest.approx(5)


def test_edges_of_definitions(spark):
    one = spark.range(1)
    x = lambda c: one.select(c.alias("x")).first().x
    z = g.literal((0, 0, 0))
    assert x(g.project_onto_sphere(z, z, F.lit(3.0))[0]) == 3
    assert x(g.cap_volume(z, F.lit(2.0), g.literal((0, 0, 3)), g.literal((0, 0, 1)))) == 0
    assert x(g.cap_volume(z, F.lit(2.0), g.literal((0, 0, -3)), g.literal((0, 0, 5)))) == pytest.approx(4 / 3 * math.pi * 8)
    assert x(g.cap_volume(z, F.lit(2.0), z, g.literal((0, 0, 1)))) == pytest.approx(2 / 3 * math.pi * 8)
    assert x(g.round_half_up(F.lit(-0.5))) == 0 and x(g.round_half_up(F.lit(1.5))) == 2
    assert [x(g.nice_interval(F.lit(v))) for v in (0.9, 1.0, 1.7, 4.2, 60.0)] == pytest.approx([1, 1, 2, 5, 100])
    assert x(g.auto_range(F.lit(41.0))) == 50 and x(g.auto_range(F.lit(2.0))) == 10
    assert [x(g.rgb555(F.lit(v))) for v in (0.0, -50.0, 50.0, -1.0)] == [0x8000 | 8 << 10 | 20 << 5 | 8, 0x8000 | 31, 0x8000 | 31 << 10, 0x8000 | 8 << 10 | 20 << 5 | 8]
    assert x(g.colour_bucket(F.lit(9.0), F.lit(0.0), F.lit(1.0))) == 511 and x(g.colour_bucket(F.lit(9.0), F.lit(1.0), F.lit(1.0))) is None
    assert [x(c) for c in g.diverging_colour(F.lit(0.0), F.lit(-1.0), F.lit(1.0))] == [0.3, 0.7, 0.3]
