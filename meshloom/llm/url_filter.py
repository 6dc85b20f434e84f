"""URL verdicts from host and path rules and, where no rule fits, from the link graph of hosts; DataFrame functions only.

Rules decide first: the longest rule whose host is the url's host or a parent domain of it and whose path
starts the url's path. Hosts under an allow rule are trusted seeds, hosts under a block rule blocked seeds.
Trust walks along links (personalised PageRank from the trusted seeds), distrust walks against them (from the
blocked seeds), and each host without a rule is blocked where its distrust is above the threshold and its trust. A walk
that comes to a host without further links starts again at a seed: so the ranks are those of walks that end there,
scaled to add up to 1.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed;
repeated rows each get a row; pages without links give hosts without edges; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import common

#: (verdict, host, path)
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DAMPING = 0.85
#: Rounds of the SQL, which are enough for host graphs whose longest chain has five links, and no cycle.
ROUNDS = 6
#: Most that all ranks together may still be off when the rounds end, and the same as a share of the threshold of a block.
PRECISION, PART = 1e-9, 1e-3
#: A host is blocked from here on: this share of an even spread of distrust over all hosts.
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as host and path (``net/``), or null."""
    out = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def _verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, h, p in rules:
        out = F.when(rule == h + p, F.lit(verdict)).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted. A link without a host stays on its own host."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    out = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(links)).alias("link"))
    dst = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    # a subdomain also points to its parent domain: its operator has both
    own = pages.select(host_of(F.col("url")).alias("src")).distinct().filter(F.size(F.split("src", r"\.")) > 2)
    own = own.select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst"), F.lit(1).cast("long").alias("n"))
    counted = out.select("src", dst.alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return counted.unionByName(own).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int | None = None, damping: float = DAMPING, precision: float | None = None) -> DataFrame:
    """(host, trusted, blocked) seed weights, (src, dst, n) -> host, trust, distrust.

    Each round is two joins and one aggregation over host edges; its result is written, so lineage stays short. Without a
    number of ``rounds`` they go on until all ranks together are off by less than ``precision``.
    """
    total = seeds.agg(F.coalesce(F.sum("trusted"), F.lit(0)).cast("double").alias("t"), F.coalesce(F.sum("blocked"), F.lit(0)).cast("double").alias("b")).first()
    start = seeds.select("host", (F.col("trusted") / max(total.t, 1.0)).alias("t0"), (F.col("blocked") / max(total.b, 1.0)).alias("b0"))
    hosts = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    start = hosts.join(start, "host", "full").fillna(0.0, ["t0", "b0"])
    out_n, in_n = edges.groupBy("src").agg(F.sum("n").alias("_o")), edges.groupBy("dst").agg(F.sum("n").alias("_i"))
    edges = common.written(edges.join(out_n, "src").join(in_n, "dst").select("src", "dst", (F.col("n") / F.col("_o")).alias("fwd"), (F.col("n") / F.col("_i")).alias("back")))
    start = common.written(start)
    rank = start.select("host", F.col("t0").alias("trust"), F.col("b0").alias("distrust"))
    if precision is None:
        precision = min(PRECISION, PART * THRESHOLD / max(start.count(), 1))
    # a round shrinks the change of all ranks by the damping at least, so this much of the last change is left in all later ones
    least, done, last = precision * (1 - damping) / damping, 0, None
    while rounds is None or done < rounds:
        ahead = edges.join(rank.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("trust") * F.col("fwd")).alias("t"), F.lit(0.0).alias("b"))
        back = edges.join(rank.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("b"))
        base = start.select("host", (F.col("t0") * (1 - damping)).alias("t"), (F.col("b0") * (1 - damping)).alias("b"))
        flow = ahead.select("host", (F.col("t") * damping).alias("t"), "b").union(back.select("host", "t", (F.col("b") * damping).alias("b")))
        old = rank.select("host", F.lit(0.0).alias("t"), F.lit(0.0).alias("b"), F.col("trust").alias("ot"), F.col("distrust").alias("ob"))
        parts = base.union(flow).select("*", F.lit(0.0).alias("ot"), F.lit(0.0).alias("ob")).union(old)
        sums = parts.groupBy("host").agg(F.sum("t").alias("trust"), F.sum("b").alias("distrust"), F.sum("ot").alias("ot"), F.sum("ob").alias("ob"))
        rank = common.written(sums.select("host", "trust", "distrust", (F.abs(F.col("trust") - F.col("ot")) + F.abs(F.col("distrust") - F.col("ob"))).alias("change")))
        done += 1
        if rounds is None and (rank.agg(F.sum("change")).first()[0] or 0.0) <= least:
            break
        common.dropped(*([last] if last else []))
        last = rank
        rank = rank.drop("change")
    common.dropped(edges, start)
    # walks that end start again at the seeds: the same ranks, scaled
    sums = rank.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("b")).first()
    return rank.select("host", (F.col("trust") / (sums.t or 1.0)).alias("trust"), (F.col("distrust") / (sums.b or 1.0)).alias("distrust"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, host, path, rule, verdict, trust, distrust."""
    rows = common.written(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))
    by_rule = _verdict_of(F.col("rule"), rules)
    seeds = rows.filter("host <> ''").groupBy("host").agg(F.count_if(by_rule == "allow").alias("trusted"), F.count_if(by_rule == "block").alias("blocked"))
    # a host is a seed with the share of its pages that a rule allows or blocks, so a large host weighs no more than a small one
    seen = F.greatest(F.col("trusted") + F.col("blocked"), F.lit(1))
    seeds = seeds.select("host", (F.col("trusted") / seen).alias("trusted"), (F.col("blocked") / seen).alias("blocked"))
    ranks = common.written(propagate(common.written(seeds), common.written(host_edges(pages))))
    n = ranks.count()
    # hosts are few against pages, yet may be many: Spark broadcasts them only below its own size limit
    full = rows.join(ranks, "host", "left").fillna(0.0, ["trust", "distrust"])
    trust, distrust = F.round("trust", 12), F.round("distrust", 12)
    spread = (distrust > trust) & (distrust > THRESHOLD / max(n, 1))
    verdict = F.coalesce(by_rule, F.when(spread, F.lit("block")).otherwise(F.lit("allow")))
    return full.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def _sql() -> str:
    quoted = lambda x: "'" + x + "'"
    case = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])))
    verdicts = " ".join(f"WHEN {quoted(h + p)} THEN {quoted(v)}" for v, h, p in RULES)
    rounds = ",\n".join(
        f"""r{i + 1} AS MATERIALIZED (SELECT host, SUM(t) AS trust, SUM(b) AS distrust FROM (
  SELECT host, t0 * {1 - DAMPING} AS t, b0 * {1 - DAMPING} AS b FROM st
  UNION ALL SELECT e.dst, r.trust * e.fwd * {DAMPING}, 0.0 FROM w e JOIN r{i} r ON r.host = e.src
  UNION ALL SELECT e.src, 0.0, r.distrust * e.back * {DAMPING} FROM w e JOIN r{i} r ON r.host = e.dst) GROUP BY host)"""
        for i in range(ROUNDS)
    )
    host = "translate(regexp_extract(COALESCE({0}, ''), '(?s)^.*?://([^/?#]*)', 1), '" + UPPER + "', '" + LOWER + "')"
    return rf"""
WITH p AS (SELECT page_id, html, {host.format('url')} AS host, regexp_extract(COALESCE(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT page_id, host, path, CASE {case} END AS rule FROM p),
v AS (SELECT *, CASE rule {verdicts} END AS by_rule FROM q),
l AS (SELECT host AS src, UNNEST(list_distinct(regexp_extract_all(COALESCE(html, ''), '(?i)href\s*=\s*["'']?((?:https?:)?//[^"''\s>]+)', 1))) AS link FROM p),
x AS (SELECT src, {host.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM l),
e AS (SELECT src, dst, SUM(n) AS n FROM (SELECT src, dst, COUNT(*) AS n FROM x WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
  UNION ALL SELECT DISTINCT host, regexp_replace(host, '^[^.]*\.', ''), 1 FROM p WHERE len(string_split(host, '.')) > 2) GROUP BY ALL),
w AS MATERIALIZED (SELECT src, dst, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY src) AS fwd, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY dst) AS back FROM e),
c AS (SELECT host, COUNT(*) FILTER (by_rule = 'allow') AS a, COUNT(*) FILTER (by_rule = 'block') AS b FROM v WHERE host <> '' GROUP BY host),
s AS (SELECT host, CAST(a AS DOUBLE) / GREATEST(a + b, 1) AS t, CAST(b AS DOUBLE) / GREATEST(a + b, 1) AS b FROM c),
h AS (SELECT host FROM s UNION SELECT src FROM e UNION SELECT dst FROM e),
st AS MATERIALIZED (SELECT h.host, COALESCE(t, 0) / GREATEST((SELECT SUM(t) FROM s), 1.0) AS t0, COALESCE(b, 0) / GREATEST((SELECT SUM(b) FROM s), 1.0) AS b0 FROM h LEFT JOIN s ON s.host = h.host),
r0 AS (SELECT host, t0 AS trust, b0 AS distrust FROM st),
{rounds},
z AS (SELECT COALESCE(NULLIF(SUM(trust), 0), 1) AS t, COALESCE(NULLIF(SUM(distrust), 0), 1) AS d FROM r{ROUNDS}),
f AS (SELECT page_id, v.host, path, rule, by_rule, ROUND(COALESCE(trust / z.t, 0), 12) AS t, ROUND(COALESCE(distrust / z.d, 0), 12) AS d FROM v CROSS JOIN z LEFT JOIN r{ROUNDS} r ON r.host = v.host)
SELECT page_id, host, path, rule, COALESCE(by_rule, CASE WHEN d > t AND d > {THRESHOLD} / GREATEST((SELECT COUNT(*) FROM h), 1) THEN 'block' ELSE 'allow' END) AS verdict,
  ROUND(t, 9) AS trust, ROUND(d, 9) AS distrust FROM f
"""


SQL = _sql()
