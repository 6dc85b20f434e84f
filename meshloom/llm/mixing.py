"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words
   by weight; a target stops at ``max_repeats`` times its source, the excess goes to the others.
2. Blocks: a source's documents fall into at most 65,536 blocks by a hash of the id. Full passes
   over a source draw each block, the rest is the prefix of its permuted blocks that comes nearest.
3. Splitting tree: the number of draws of each source is split between the two halves of the output
   shards with exact multivariate hypergeometric draws, halves again, down to single shards. A multivariate draw
   halves the sources in turn: how many of a half's draws come from the first half of the sources, and so on down to
   single ones, each a hypergeometric draw. Quotas are rows of (node, sources). Every draw is a hash of
   (seed, level, node, sources), so reruns and recomputed tasks agree.
4. Each shard takes its quota of the next draws of each source's permuted blocks: no draw is in two shards. What the
   mix takes of a document are the draws of its block in all shards. Rows are then put in random order within their shard.

Defined results: a null text has no words; a null source is a source of its own; null or repeated ids
share a block; an empty table gives no rows; other columns are ignored or, in ``mix``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.llm import common

SEED = "mix-1"
MAX_REPEATS = 3
#: Output shards: a power of two.
SHARDS = 16
#: Hexadecimal digits of a block's name, so 16**4 blocks of a source at most.
MOST_DIGITS = 4
#: Sources up to which their table is broadcast; beyond, it is joined by key.
BROADCAST_SOURCES = 10_000


def _drawn(name: str, keys: str) -> str:
    """SQL: common tables that end in ``{name}_x``, the relation ``name`` (keys, n, k, m, u) with x: the quantile u of the number of marked ones among m drawn of n, k of them marked.

    The support is gone through from the mode up, then from the mode down, to 12 standard
    deviations and 20 beyond; what lies further out is below double precision. Each place is a row.
    """
    return f"""{name}_b AS (SELECT *, GREATEST(0, m + k - n) AS lo, LEAST(k, m) AS hi, CAST(k AS DOUBLE) / GREATEST(n, 1) AS share FROM {name}),
{name}_c AS (SELECT *, LEAST(hi, GREATEST(lo, CAST(FLOOR((m + 1D) * (k + 1) / (n + 2)) AS BIGINT))) AS mode, CAST(CEIL(12 * SQRT(m * share * (1 - share))) AS BIGINT) + 20 AS reach FROM {name}_b),
{name}_e AS (SELECT *, GREATEST(lo, mode - reach) AS first, LEAST(hi, mode + reach) AS last, EXPLODE(SEQUENCE(GREATEST(lo, mode - reach), LEAST(hi, mode + reach))) AS i FROM {name}_c),
{name}_l AS (SELECT {keys}, n, k, m, u, lo, i, IF(i >= mode, i - mode, last - i) AS o,
  SUM(IF(i > first, LN(CAST(k - i + 1 AS DOUBLE) * (m - i + 1) / (CAST(i AS DOUBLE) * (n - k - m + i))), 0D)) OVER (PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING) AS l FROM {name}_e),
{name}_w AS (SELECT {keys}, n, k, m, u, lo, i, o, EXP(l - MAX(l) OVER (PARTITION BY {keys})) AS w FROM {name}_l),
{name}_s AS (SELECT {keys}, n, k, m, u, lo, i, o, SUM(w) OVER (PARTITION BY {keys} ORDER BY o ROWS UNBOUNDED PRECEDING) AS s, SUM(w) OVER (PARTITION BY {keys}) AS total FROM {name}_w),
{name}_x AS (SELECT {keys}, n, k, m, u, COALESCE(MIN_BY(i, IF(s >= u * total, o, NULL)), lo) AS x FROM {name}_s GROUP BY {keys}, n, k, m, u, lo)"""


def hypergeometric(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` (keys, n, k, m, u) with x, as ``_drawn``."""
    return rows.sparkSession.sql(f"WITH a AS (SELECT * FROM {{rows}}), {_drawn('a', ', '.join(keys))} SELECT * FROM a_x", rows=rows)


def split_tree(quotas: DataFrame, shards: int, n_sources: int, seed: str = SEED) -> DataFrame:
    """(place, quota), one row for each source, places from 0 -> (shard, place, quota): parts that add up to the input, shards equal in size to within one.

    A row (level, height, node, grp, n): the draws that a node of the tree of shards has of a group of 2**height
    neighbouring sources. What a node's first half gets of a group's first half is drawn from what the group and the halves
    have, so all levels move down the heights together, one step behind each other.
    """
    spark, rounds, levels = quotas.sparkSession, max(n_sources - 1, 0).bit_length(), shards.bit_length() - 1
    heights = F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("height")
    groups = quotas.select(F.lit(0).alias("level"), heights, "place", "quota").groupBy("level", "height", F.expr("CAST(shiftright(place, height) AS BIGINT)").alias("grp"))
    groups = groups.agg(F.sum("quota").alias("n")).selectExpr("level", "height", "0L AS node", "grp", "n")
    # what is known so far, one table that each step reads and appends to; first the quotas, and the nodes as wholes: halves of halves
    path, schema = common.shared_dir(spark), "level int, height int, node bigint, grp bigint, n bigint"
    groups.write.parquet(path)
    total = groups.filter(F.col("height") == rounds).agg(F.sum("n")).first()[0] or 0
    wholes, sizes = [], [total]
    for level in range(1, levels + 1):
        sizes = [x for n in sizes for x in (n // 2, n - n // 2)]
        wholes += [(level, rounds, node, 0, n) for node, n in enumerate(sizes)]
    if wholes:
        spark.createDataFrame(wholes, schema).write.mode("append").parquet(path)
    for step in range(rounds + levels - 1 if rounds else 0):
        q = spark.read.schema(schema).parquet(path)
        u = f"CAST(CONV(SUBSTRING(MD5(CONCAT_WS(':', CONCAT('{seed}:', level), node, height - 1, grp)), 1, 13), 16, 10) AS DOUBLE) / {float(1 << 52)}D"
        drawn = spark.sql(f"""WITH g AS (SELECT level, height, node, grp, n FROM {{q}} WHERE level + {rounds} - height = {step} AND height > 0 AND level < {levels} AND n > 0),
h AS (SELECT level - 1 AS level, height, node DIV 2 AS node, grp, n AS m FROM {{q}} WHERE level + {rounds} - height = {step + 1} AND node % 2 = 0 AND level > 0),
f AS (SELECT level, height + 1 AS height, node, grp DIV 2 AS grp, n AS k FROM {{q}} WHERE level + {rounds} - height = {step + 1} AND grp % 2 = 0),
a AS (SELECT level, height, node, grp, n, COALESCE(k, 0) AS k, COALESCE(m, 0) AS m, {u} AS u FROM g LEFT JOIN h USING (level, height, node, grp) LEFT JOIN f USING (level, height, node, grp)),
{_drawn("a", "level, height, node, grp")}
SELECT level + 1 AS level, height - 1 AS height, part.* FROM (SELECT level, height, EXPLODE(ARRAY(STRUCT(2 * node AS node, 2 * grp AS grp, x AS n), STRUCT(2 * node AS node, 2 * grp + 1 AS grp, m - x AS n),
  STRUCT(2 * node + 1 AS node, 2 * grp AS grp, k - x AS n), STRUCT(2 * node + 1 AS node, 2 * grp + 1 AS grp, n - k - m + x AS n))) AS part FROM a_x) WHERE part.n > 0""", q=q)
        drawn.write.mode("append").parquet(path)
    q = spark.read.schema(schema).parquet(path)
    shares = common.written(q.filter((F.col("level") == levels) & (F.col("height") == 0)).selectExpr("node AS shard", "grp AS place", "n AS quota"))
    common.delete(spark, path)
    return shares


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *parts))


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size) -> source, key, source_size, n_docs, rank, weight, target. Windows run over the table of sources only."""
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.select("*", rank.alias("rank")).withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", F.col("source_size") * max_repeats)
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy()
    level = per.withColumn("level", (F.sum("source_size").over(everything) - before).cast("double") / after)
    target = F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight"))
    return level.select(_key(F.col("source")).alias("key"), "source_size", "n_docs", "rank", "weight", target.alias("target"))


def _joined(left: DataFrame, small: DataFrame, n_small: int) -> DataFrame:
    return left.join(F.broadcast(small) if n_small <= BROADCAST_SOURCES else small, "key")


def plan(sizes: DataFrame, shards: int = SHARDS, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size) -> the sources' table, and (key, block, shards) of the blocks drawn: the shards that draw a block, once for each draw."""
    sources = common.written(targets(sizes, max_repeats))
    n = sources.count()
    digits = sum((F.when(F.col("n_docs") > 16**i, 1).otherwise(0) for i in range(MOST_DIGITS)), F.lit(0))
    rows = sources
    sources = common.written(rows.withColumn("digits", digits))
    common.dropped(rows)
    blocks = _joined(block_of(sizes), sources.select("key", "digits"), n).groupBy("key", F.expr("substring(digest, 1, digits)").alias("block")).agg(F.sum("size").alias("words"))
    # places in the permuted order: within parts of it, then the sums of the parts before
    blocks = common.written(blocks.withColumn("order", _digest(F.col("key"), F.col("block"))).withColumn("part", F.substring("order", 1, 2)))
    inside = W.partitionBy("key", "part").orderBy("order", "block")
    sums = blocks.groupBy("key", "part").agg(F.count("*").alias("c"), F.sum("words").alias("w"))
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # 256 rows at most
    sums = sums.select("key", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w"))
    placed = blocks.select("*", F.row_number().over(inside).alias("r"), F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("e")).join(sums, ["key", "part"])
    placed = common.written(placed.select("key", "block", "words", (F.col("r") + F.col("c") - 1).alias("rank"), (F.col("e") + F.col("w")).alias("end")))
    common.dropped(blocks)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("long")
    need = sources.withColumn("passes", passes).withColumn("rest", F.when(F.col("passes") < max_repeats, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(-1.0))
    taken = _joined(placed, need.select("key", "rest"), n).groupBy("key").agg(F.count("*").alias("n_blocks"), F.count_if(2 * F.col("end") - F.col("words") <= 2 * F.col("rest")).alias("more"))
    need = need.join(taken, "key").select("key", "source_size", "target", "digits", "n_blocks", (F.col("rank") - 1).cast("long").alias("place"), (F.col("passes") * F.col("n_blocks") + F.col("more")).alias("quota"))
    need = common.written(need)
    parts = split_tree(need.select("place", "quota"), shards, n)
    # a shard's quota are the next draws of the source; the draws of a source go through its permuted blocks again and again
    end = F.sum("quota").over(W.partitionBy("place").orderBy("shard"))  # one row for each shard
    draws = parts.select("shard", "place", (end - F.col("quota")).alias("start"), end.alias("stop")).filter("stop > start").join(need.select("place", "key", "n_blocks"), "place")
    draws = draws.select("key", "shard", "n_blocks", F.explode(F.sequence("start", F.col("stop") - 1)).alias("draw")).select("key", "shard", (F.col("draw") % F.col("n_blocks")).alias("rank"))
    drawn = draws.join(placed, ["key", "rank"]).groupBy("key", "block").agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    drawn = common.written(drawn)
    common.dropped(placed, sources)
    return need.select("key", "source_size", "target", "digits"), drawn


def block_of(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", _key(F.col("source"))).withColumn("digest", _digest(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def sizes_of(docs: DataFrame) -> DataFrame:
    return common.written(docs.select("doc_id", "source", F.size(common.words(F.col("text"))).cast("long").alias("size")))


def assigned(docs: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc, source_size, target, shards) of each of ``docs`` (with doc_id and source): doc has its columns, shards one shard for each time the mix takes the row."""
    sources, blocks = plan(sizes, shards)
    # the columns of docs stay apart, so theirs may have any names
    rows = block_of(docs.select(F.struct("*").alias("doc"), "doc_id", "source"))
    rows = _joined(rows, sources, sources.count()).withColumn("block", F.expr("substring(digest, 1, digits)"))
    rows = rows.join(blocks, ["key", "block"], "left").select("doc", "source_size", "target", F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"))
    return rows


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as drawn, with mix_shard and mix_order (in place of columns of these names), in random order within each shard."""
    rows = assigned(docs, sizes_of(docs), shards).select("doc", F.posexplode("shards").alias("copy", "mix_shard"))
    order = _digest(F.col("mix_shard").cast("string"), F.col("copy").cast("string"), F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")), F.lit("order"))
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("mix_shard", "mix_order")]
    rows = rows.select(*own, F.col("mix_shard").cast("int").alias("mix_shard"), F.substring(order, 1, 16).alias("mix_order"))
    return rows.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sizes_of(common.table(spark, sf_dir, "documents"))
    rows = assigned(sizes, sizes)
    return rows.select("doc.doc_id", "doc.size", "source_size", F.round("target", 6).alias("target"), (F.col("doc.size") * F.size("shards")).alias("taken"), F.array_join("shards", ",").alias("shards"))



def _sql(rounds: int = 5) -> str:
    """SQL of op8 for up to 2**rounds sources. More rounds than needed change nothing: a half without draws takes none."""
    levels = SHARDS.bit_length() - 1
    q = ["q0 AS MATERIALIZED (SELECT 0 AS node, place, draws AS quota FROM g)"]
    for level in range(levels):
        q.append(f"s{level} AS MATERIALIZED (SELECT node, h AS height, place >> h AS grp, CAST(SUM(quota) AS BIGINT) AS n FROM q{level}, UNNEST(range(0, {rounds + 1})) AS t(h) GROUP BY 1, 2, 3)")
        state = f"t{level}_{rounds}"
        q.append(f"{state} AS MATERIALIZED (SELECT node, grp, n, n // 2 AS m FROM s{level} WHERE height = {rounds})")
        for height in range(rounds - 1, -1, -1):
            name = f"t{level}_{height}"
            q.append(f"""a{name} AS MATERIALIZED (SELECT t.node, t.grp, t.n, t.m, COALESCE(s.n, 0) AS k, GREATEST(0, t.m + COALESCE(s.n, 0) - t.n) AS lo, LEAST(COALESCE(s.n, 0), t.m) AS hi,
  CAST('0x' || substr(md5('{SEED}:{level}:' || t.node || ':{height}:' || t.grp), 1, 13) AS BIGINT) / {float(1 << 52)} AS u FROM {state} t LEFT JOIN s{level} s ON s.node = t.node AND s.height = {height} AND s.grp = 2 * t.grp),
b{name} AS MATERIALIZED (SELECT *, LEAST(hi, GREATEST(lo, CAST(FLOOR((m + 1.0) * (k + 1) / (n + 2)) AS BIGINT))) AS mode, CAST(CEIL(12 * SQRT(m * (k / GREATEST(n, 1)) * (1 - k / GREATEST(n, 1)))) AS BIGINT) + 20 AS reach FROM a{name}),
c{name} AS (SELECT node, grp, u, mode, i, LEAST(hi, mode + reach) AS top, lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(n - k + 1) - lgamma(m - i + 1) - lgamma(n - k - m + i + 1) AS l
  FROM (SELECT *, UNNEST(range(GREATEST(lo, mode - reach), LEAST(hi, mode + reach) + 1)) AS i FROM b{name})),
d{name} AS (SELECT node, grp, u, i, CASE WHEN i >= mode THEN i - mode ELSE top - i END AS o, EXP(l - MAX(l) OVER (PARTITION BY node, grp)) AS w FROM c{name}),
e{name} AS (SELECT node, grp, u, i, o, SUM(w) OVER (PARTITION BY node, grp ORDER BY o) AS s, SUM(w) OVER (PARTITION BY node, grp) AS w FROM d{name}),
x{name} AS MATERIALIZED (SELECT b.node, b.grp, b.n, b.m, b.k, COALESCE(f.x, lo) AS x FROM b{name} b LEFT JOIN (SELECT node, grp, arg_min(i, o) AS x FROM e{name} WHERE s >= u * w GROUP BY 1, 2) f ON f.node = b.node AND f.grp = b.grp),
{name} AS MATERIALIZED (SELECT * FROM (SELECT node, 2 * grp AS grp, k AS n, x AS m FROM x{name} UNION ALL SELECT node, 2 * grp + 1, n - k, m - x FROM x{name}) WHERE n > 0)""")
            state = name
        q.append(f"q{level + 1} AS MATERIALIZED (SELECT 2 * node AS node, grp AS place, m AS quota FROM {state} UNION ALL SELECT 2 * node + 1, grp, n - m FROM {state})")
    tree = ",\n".join(q)
    return rf"""
WITH d AS (SELECT doc_id, source, COALESCE('s' || source, 'n') AS key, md5('{SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS digest,
  CAST(len(list_filter(regexp_split_to_array(COALESCE(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT key, CAST(SUM(size) AS BIGINT) AS source_size, COUNT(*) AS n_docs, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM d GROUP BY source, key),
w AS (SELECT *, (rk - 1) % 3 + 1 AS weight, {MAX_REPEATS} * source_size AS cap FROM s),
l AS (SELECT *, CAST((SELECT SUM(source_size) FROM s) - COALESCE(SUM(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / SUM(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, LEAST(CAST(cap AS DOUBLE), (SELECT MAX(level) FROM l) * weight) AS target,
  CASE WHEN n_docs > 4096 THEN 4 WHEN n_docs > 256 THEN 3 WHEN n_docs > 16 THEN 2 WHEN n_docs > 1 THEN 1 ELSE 0 END AS digits FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN LEAST(CAST(FLOOR(target / source_size) AS BIGINT), {MAX_REPEATS}) ELSE 0 END AS passes FROM t),
r AS (SELECT *, CASE WHEN passes < {MAX_REPEATS} THEN target - passes * source_size ELSE -1 END AS rest FROM p),
b AS (SELECT d.key, substr(digest, 1, digits) AS block, SUM(size) AS words FROM d JOIN t ON d.key = t.key GROUP BY 1, 2),
c AS MATERIALIZED (SELECT key, block, words, row_number() OVER o - 1 AS rank, SUM(words) OVER (o ROWS UNBOUNDED PRECEDING) AS ends FROM b WINDOW o AS (PARTITION BY key ORDER BY md5('{SEED}:' || key || ':' || block), block)),
m AS (SELECT c.key, COUNT(*) AS n_blocks, COUNT(*) FILTER (2 * ends - words <= 2 * rest) AS more FROM c JOIN r ON r.key = c.key GROUP BY c.key),
g AS MATERIALIZED (SELECT r.key, rk - 1 AS place, n_blocks, passes * n_blocks + more AS draws FROM r JOIN m ON m.key = r.key),
{tree},
h AS (SELECT node AS shard, place, quota, SUM(quota) OVER (PARTITION BY place ORDER BY node) AS stop FROM q{levels} WHERE quota > 0),
k AS (SELECT g.key, shard, draw % n_blocks AS rank FROM (SELECT shard, place, UNNEST(range(CAST(stop - quota AS BIGINT), CAST(stop AS BIGINT))) AS draw FROM h) x JOIN g ON g.place = x.place),
z AS (SELECT c.key, block, COUNT(*) AS times, string_agg(shard, ',' ORDER BY shard) AS shards FROM k JOIN c ON c.key = k.key AND c.rank = k.rank GROUP BY 1, 2)
SELECT doc_id, size, source_size, ROUND(target, 6) AS target, CAST(size * COALESCE(times, 0) AS BIGINT) AS taken, COALESCE(shards, '') AS shards
FROM d JOIN t ON d.key = t.key LEFT JOIN z ON z.key = d.key AND z.block = substr(digest, 1, digits)
"""


SQL = _sql()
