"""Merkle manifest of a dataset: a tree for each language, and a tree over the languages' roots.

Leaves are placed without sorting them: each language's ids become a compressed bitmap, of which only words of 64
ids that occur are stored. Tasks merge the words of their rows, an exchange merges those of the tasks, and a popcount directory in
levels (1,024 words, then 65,536 entries of the level below each) says how many rows stand before a word. A
leaf's coordinate is a rank query: the directory's count plus the bits below its own.

Nodes then meet in slot arrays, keyed by group and block of ``FAN`` consecutive nodes. Each pass reduces an array by six levels, so
a group of n leaves takes log64(n) passes. Going back down, each block gets the path of the node above it and hands
its slots their siblings before that path, so a leaf's proof is put together from blocks alone.

Defined results: leaves of one language and id (also of null ids, which come first) are ordered by their digests, equal
digests in either order; a null language is a group of its own, before all others; an empty table gives no
rows; other columns are ignored; ids are 64-bit integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.llm import common

#: Nodes of a slot array, and the levels that a pass reduces.
FAN, LEVELS = 64, 6
#: Bits of a key that each level of the directory takes off; a level's window has so many rows at most.
STEPS = (10, 16, 16, 16)
#: The word of ids that are null: before those of all integers.
NULL_WORD = -(1 << 57) - 1
#: Rows of slot arrays that a task holds as Python objects at a time.
AT_ONCE = 64


def field(value) -> F.Column:
    """A value as it enters a leaf: its bytes' count, a colon and the text; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars) -> F.Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang")), field(n_chars), field(F.col("text"))), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """row, g (the language, so that null sorts first), doc_id, leaf and, for rows dealt to be tampered with, the other leaf."""
    dealt = (F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    rows = docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("n_chars")).alias("leaf"), F.when(dealt, leaf(F.col("n_chars") + 1)).alias("other"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def _word():
    return F.coalesce(F.shiftright("doc_id", 6), F.lit(NULL_WORD))


def _low():
    return F.coalesce(F.col("doc_id").bitwiseAND(63), F.lit(0)).cast("int")


def bitmaps(rows: DataFrame) -> DataFrame:
    """(g, w) -> bits of the ids that occur in word w of group g, n: rows there."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _low())
    return rows.groupBy("g", _word().alias("w")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))


def directory(words: DataFrame) -> DataFrame:
    """``words`` (stored: g, w, bits, n) with ``base``: the rows of the group in words before w."""
    low, high = words.agg(F.min("w"), F.max("w")).first()
    level, levels = words.select("g", F.col("w").alias("k"), "n"), []
    for step in STEPS if low is not None else ():
        up = F.shiftright("k", step)
        before = F.sum("n").over(W.partitionBy("g", up).orderBy("k").rowsBetween(W.unboundedPreceding, -1))
        levels.append(level.select("g", "k", up.alias("up"), F.coalesce(before, F.lit(0)).alias("before")))
        level = level.groupBy("g", up.alias("k")).agg(F.sum("n").alias("n"))
        low, high = low >> step, high >> step
        if low == high:
            break
    # ids of 64 bits leave at most the words of negative ones, others and null
    before = F.sum("n").over(W.partitionBy("g").orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    base = level.select("g", "k", F.coalesce(before, F.lit(0)).alias("base"))
    for level in reversed(levels):
        base = level.join(base.select("g", F.col("k").alias("up"), "base"), ["g", "up"]).select("g", "k", (F.col("before") + F.col("base")).alias("base"))
    return words.join(base.withColumnRenamed("k", "w"), ["g", "w"])


def placed(rows: DataFrame) -> DataFrame:
    """(g, i, doc_id, leaf, other): the leaves of ``rows`` (stored) with their coordinates in their group, stored."""
    words = common.written(bitmaps(rows))
    found = rows.withColumn("w", _word()).join(directory(words), ["g", "w"])
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), _low()))))
    plain = F.col("n") == F.bit_count("bits")
    columns = ["g", "i", "doc_id", "leaf", "other"]
    out = found.filter(plain).withColumn("i", F.col("base") + below).select(*columns)
    if words.filter(~plain).limit(1).count():
        # words with repeated ids: their rows alone are numbered in order
        again = common.numbered(found.filter(~plain), [F.col("g"), F.col("w"), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")])
        first = again.groupBy("g", "w").agg(F.min("number").alias("first"))
        again_rows = again.join(common.if_small(first), ["g", "w"]).withColumn("i", F.col("base") + F.col("number") - F.col("first"))
        stored = common.written(out.unionByName(again_rows.select(*columns)))
        common.dropped(again)
    else:
        stored = common.written(out)
    common.dropped(words)
    return stored


def digest(*children: str) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def layers(nodes: list[str], whole: bool) -> list[list[str]]:
    """The layers over ``nodes``, the first included: up to one node if they are ``whole`` groups, else ``LEVELS`` more."""
    out = [nodes]
    while len(out[-1]) > 1 or not whole and len(out) <= LEVELS:
        last = out[-1]
        out.append([digest(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return out


def siblings(over: list[list[str]], slot: int) -> list[str]:
    """One step for each layer below the top: ``R`` or ``L`` with the node to the right or left, or ``N`` without one."""
    steps = []
    for layer in over[:-1]:
        other = slot ^ 1
        steps.append(("R" if other > slot else "L") + layer[other] if other < len(layer) else "N")
        slot >>= 1
    return steps


def folded(start: str, steps: list[str]) -> str:
    """The root that ``start`` leads to with ``steps`` from below."""
    for step in steps:
        start = digest(start, step[1:]) if step[0] == "R" else digest(step[1:], start) if step[0] == "L" else digest(start)
    return start


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE).to_pydict()


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in _slots(batches):
        tops = [layers([s["h"] for s in a], n <= FAN)[-1][0] for a, n in zip(x["a"], x["n"], strict=True)]
        sizes = [-(-n // FAN) for n in x["n"]]
        yield pa.RecordBatch.from_arrays([pa.array(x["g"], pa.string()), pa.array(x["b"], pa.int64()), pa.array(tops, pa.string()), pa.array(sizes, pa.int64())], names=["g", "i", "h", "n"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in _slots(batches):
        g, i, path = [], [], []
        for group, n, a, above in zip(x["g"], x["n"], x["a"], x["path"], strict=True):
            over = layers([s["h"] for s in a], n <= FAN)
            for slot, s in enumerate(a):
                g.append(group)
                i.append(s["i"])
                path.append(",".join([*siblings(over, slot), above]))
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(i, pa.int64()), pa.array(path, pa.string())], names=["g", "i", "path"])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in _slots(batches):
        cols: list[list] = [[] for _ in range(6)]
        for n, a, above in zip(x["n"], x["a"], x["path"], strict=True):
            over = layers([s["h"] for s in a], n <= FAN)
            *rest, subroot, root = above.split(",")
            for slot, s in enumerate(a):
                steps = [*siblings(over, slot), *rest]
                proof = digest(*(t[1:] for t in steps))
                for c, v in zip(cols, (s["doc_id"], s["h"], subroot, root, proof, folded(s["other"] or s["h"], steps)), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def slotted(nodes: DataFrame, *more: str) -> DataFrame:
    """Slot arrays of ``nodes`` (g, i, h, n: the nodes of the group): one row for each group and block, stored."""
    block = F.expr(f"i div {FAN}").alias("b")
    return common.written(nodes.groupBy("g", block).agg(F.array_sort(F.collect_list(F.struct("i", "h", *more))).alias("a"), F.first("n").alias("n")))


def reduced(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The stored slot arrays of each pass over ``nodes``, and (g, h): the top of each group, stored."""
    passes, tops = [], []
    while True:
        passes.append(slotted(nodes, *more))
        top = common.written(passes[-1].mapInArrow(_tops, "g string, i long, h string, n long"))
        tops.append(top.filter("n = 1").select("g", "h"))
        nodes, more = top.filter("n > 1"), ()
        if nodes.limit(1).count() == 0:
            break
    roots = tops[0]
    for top in tops[1:]:
        roots = roots.unionByName(top)
    return passes, common.written(roots)


def _above(blocks: DataFrame, groups: DataFrame, paths: DataFrame | None) -> DataFrame:
    """Slot arrays with the path of the node that stands for them: of their group where they are all of it, else of the pass above."""
    own = groups.select("g", F.lit(0).cast("long").alias("b"), "path")
    single = blocks.filter(F.col("n") <= FAN).join(own, ["g", "b"])
    if paths is None:
        return single
    return single.unionByName(blocks.filter(F.col("n") > FAN).join(paths.select("g", F.col("i").alias("b"), "path"), ["g", "b"]))


def lowered(passes: list[DataFrame], groups: DataFrame) -> DataFrame:
    """The lowest slot arrays with their paths, from ``groups`` (g, path) down through the passes."""
    paths = None
    for blocks in reversed(passes[1:]):
        paths = common.written(_above(blocks, groups, paths).mapInArrow(_paths, "g string, i long, path string"))
    return _above(passes[0], groups, paths)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each of ``docs`` (doc_id, source, lang, n_chars, text)."""
    rows = common.written(leaves(docs))
    nodes = placed(rows)
    sizes = common.if_small(nodes.groupBy("g").agg(F.count("*").alias("n")))
    passes, subroots = reduced(nodes.withColumnRenamed("leaf", "h").join(sizes, "g"), "doc_id", "other")
    common.dropped(rows, nodes)
    # the tree over the groups
    order = common.numbered(subroots, [F.col("g")], "i")
    count = order.count()
    above, root = reduced(order.select(F.lit("").alias("g"), "i", "h", F.lit(count).cast("long").alias("n"), F.col("g").alias("name"), F.col("h").alias("subroot")), "name", "subroot")
    top = root.select(F.lit("").alias("g"), F.col("h").alias("path"))
    # a path ends with the root; a group's own with its subroot before that
    lowest = lowered(above, top)
    names = lowest.select("g", "b", F.explode("a").alias("s")).select("g", F.col("s.i").alias("i"), F.col("s.name").alias("name"), F.col("s.subroot").alias("subroot"))
    steps = lowest.mapInArrow(_paths, "g string, i long, path string")
    cut = F.regexp_extract("path", "^(.*?)([^,]*)$", 1)
    groups = steps.join(names, ["g", "i"]).select(F.col("name").alias("g"), F.concat(cut, F.col("subroot"), F.lit(","), F.substring_index("path", ",", -1)).alias("path"))
    out = lowered(passes, common.written(groups)).mapInArrow(_proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(common.table(spark, sf_dir, "documents"))


#: The table of the CRC-32 polynomial, and the checksum of a list of bytes.
CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def sql_crc32(data: str, table: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, x: xor(c >> 8, {table}[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295)"


def _sql_tree(name: str, nodes: str) -> str:
    """CTEs: {name} (g, lev, i, h) of all levels over ``nodes`` (g, i, h), {name}_top (g, lev, h)."""
    return f"""
{name} AS (SELECT g, 0 AS lev, i, h FROM {nodes} UNION ALL
  SELECT g, lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, COUNT(*) OVER (PARTITION BY g) AS c FROM {name}) WHERE c > 1 GROUP BY g, lev, i // 2),
{name}_top AS (SELECT g, MAX(lev) AS lev, arg_max(h, lev) AS h FROM {name} GROUP BY g)"""


def _sql_fold(name: str, start: str, tree: str) -> str:
    """CTE {name}: ``start`` (key, g, i, h, proof) led up through ``tree``, a row for each level."""
    return f"""
{name} AS (SELECT key, g, 0 AS lev, i, h, proof FROM {start} UNION ALL
  SELECT f.key, f.g, f.lev + 1, f.i // 2, sha256(CASE WHEN f.i % 2 = 0 THEN f.h || COALESCE(s.h, '') ELSE s.h || f.h END), f.proof || COALESCE(s.h, '')
  FROM {name} f JOIN {tree}_top t ON t.g = f.g AND f.lev < t.lev LEFT JOIN {tree} s ON s.g = f.g AND s.lev = f.lev AND s.i = xor(f.i, 1))"""


def _sql_field(value: str) -> str:
    return f"COALESCE(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


SQL = f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS tab),
docs AS MATERIALIZED (SELECT doc_id, COALESCE('=' || lang, '') AS g, {_sql_leaf("n_chars")} AS leaf, {_sql_leaf("n_chars + 1")} AS other, n_chars IS NOT NULL
  AND {sql_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)", "tab")} % 7 = 0 AS dealt FROM documents, crc),
leaves AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM docs),{_sql_tree("low", "leaves")},
langs AS (SELECT '' AS g, g AS name, ROW_NUMBER() OVER (ORDER BY g) - 1 AS i, h FROM low_top),{_sql_tree("high", "langs")},
first AS (SELECT doc_id AS key, g, i, CASE WHEN dealt THEN other ELSE leaf END AS h, '' AS proof FROM leaves),{_sql_fold("up", "first", "low")},
second AS (SELECT up.key, l.g, l.i, up.h, up.proof FROM up JOIN low_top t ON t.g = up.g AND t.lev = up.lev JOIN langs l ON l.name = up.g),{_sql_fold("over", "second", "high")}
SELECT d.doc_id, d.leaf, t.h AS subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = r.h AS verified
FROM docs d JOIN low_top t ON t.g = d.g JOIN over o ON o.key = d.doc_id JOIN high_top r ON r.g = o.g AND r.lev = o.lev
"""
