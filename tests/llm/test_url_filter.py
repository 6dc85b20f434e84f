from pyspark.sql import functions as F

from meshloom.llm import url_filter as u


def test_hosts_paths_and_rules(spark):
    rows = {
        None: ("", "", None), "no scheme/net/": ("", "", None), "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/"), "https://net/": ("net", "/", "net/"),
        "http://net": ("net", "", None), "x://org/fr/?a": ("org", "/fr/", "org/fr/"), "http://myorg/fr/": ("myorg", "/fr/", None), "http://b.example.com/de/1": ("b.example.com", "/de/1", "example.com/de/"),
        "http://h?x=http://net/": ("h", "", None), "http://É.net/a#/b": ("É.net", "/a", "net/"), "a\nb://c.net/\nd": ("c.net", "/\nd", "net/"),
    }
    df = spark.createDataFrame([(x,) for x in rows], "url string").select("url", u.host_of(F.col("url")).alias("h"), u.path_of(F.col("url")).alias("p"))
    for r in df.select("*", u.rule_of(F.col("h"), F.col("p")).alias("r")).collect():
        assert (r.h, r.p, r.r) == rows[r.url]


def test_propagation_matches_brute_force(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("d", "a", 3), ("c", "a", 1)]
    seeds = [("a", 1.0, 0.0), ("c", 0.0, 1.0), ("lonely", 1.0, 0.5)]
    got = {r.host: r for r in u.propagate(spark.createDataFrame(seeds, "host string, trusted double, blocked double"), spark.createDataFrame(edges, "src string, dst string, n long"), 4).collect()}
    hosts = {x for e in edges for x in e[:2]} | {s[0] for s in seeds}
    t0 = {h: sum(s[1] for s in seeds if s[0] == h) / 2 for h in hosts}
    b0 = {h: sum(s[2] for s in seeds if s[0] == h) / 1.5 for h in hosts}
    t, b = dict(t0), dict(b0)
    for _ in range(4):
        nt, nb = ({h: 0.15 * z[h] for h in hosts} for z in (t0, b0))
        for s, d, n in edges:
            nt[d] += 0.85 * t[s] * n / sum(e[2] for e in edges if e[0] == s)
            nb[s] += 0.85 * b[d] * n / sum(e[2] for e in edges if e[1] == d)
        t, b = nt, nb
    t, b = ({h: x / sum(z.values()) for h, x in z.items()} for z in (t, b))
    for h in hosts:
        assert abs(got[h].trust - t[h]) < 1e-12 and abs(got[h].distrust - b[h]) < 1e-12


def test_links_carry_distrust(spark):
    rows = [(1, "http://bad.net/", ""), (2, "http://friend.com/x", '<a HREF="http://bad.net/1">x</a>' * 3), (3, "http://good.org/fr/", "<a href='//clean.com/'>"), (4, "http://clean.com/y", ""), (4, None, None)]
    got = {(r.page_id, r.host): r for r in u.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 5
    assert got[(2, "friend.com")].verdict == "block" and got[(4, "clean.com")].verdict == "allow" and got[(1, "bad.net")].verdict == "block" and got[(4, "")].verdict == "allow"


def test_empty(spark):
    assert u.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ranks_beyond_six_links(spark):
    # a chain of ten links on which trust walks forth and distrust back, and a cycle off it
    chain = [(f"h{i}", f"h{i + 1}", 1) for i in range(10)]
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), ("h10", 0.0, 1.0)], "host string, trusted double, blocked double")
    got = {r.host: r for r in u.propagate(seeds, spark.createDataFrame(chain, "src string, dst string, n long")).collect()}
    total = sum(u.DAMPING**i for i in range(11))
    for i in range(11):
        assert abs(got[f"h{i}"].trust - u.DAMPING**i / total) < 1e-9 and abs(got[f"h{10 - i}"].distrust - got[f"h{i}"].trust) < 1e-9
    cycle = spark.createDataFrame([("h0", "a", 1), ("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    got = {r.host: r for r in u.propagate(seeds, cycle, precision=1e-2).collect()}
    a = (1 - u.DAMPING) * u.DAMPING / (1 - u.DAMPING**2)  # no walk from h0 ends, so nothing is scaled
    assert abs(got["a"].trust - a) < 1e-2 and abs(got["b"].trust - a * u.DAMPING) < 1e-2 and got["h10"].trust == 0


def test_walks_that_end_start_again_at_the_seeds(spark):
    edges, seeds = [("a", "b"), ("a", "c"), ("c", "a"), ("s", "a"), ("s", "b")], {"a": 0.25, "s": 0.75}
    rows = spark.createDataFrame([(h, w * 4, 0.0) for h, w in seeds.items()], "host string, trusted double, blocked double")
    got = {r.host: r.trust for r in u.propagate(rows, spark.createDataFrame([(*e, 1) for e in edges], "src string, dst string, n long")).collect()}
    rank = dict.fromkeys("abcs", 0.25)
    for _ in range(400):
        new = {h: (1 - u.DAMPING) * seeds.get(h, 0) for h in rank}
        for h, x in rank.items():
            out = [d for s, d in edges if s == h]
            for d in out:
                new[d] += u.DAMPING * x / len(out)
            if not out:
                for s, w in seeds.items():
                    new[s] += u.DAMPING * x * w
        rank = new
    assert all(abs(got[h] - x) < 1e-9 for h, x in rank.items())
