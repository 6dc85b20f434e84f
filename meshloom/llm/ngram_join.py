"""Jaccard self-join of documents on word n-grams: a size-aware heavy-light join.

Light sets (up to a size that a cost model chooses) are joined by enumerating subsets: two sets of sizes s and t
are linked if and only if they share a subset of the size c(s, t) that the threshold asks for, so a shared subset is a proof.
Heavy sets, and the light ones that may partner with them, are joined by scanning inverted lists. The lists
hold a prefix of each set in the order of document frequency, rarest first: sets that share
nothing there cannot reach the threshold. Candidates are verified on the whole sets.

Hot lists do not become all their pairs: equal sets are one class, each set is first verified against the
hub of its lists, and only sets of lists that then still span several components are compared pair by pair: those
outside a list's largest component with all of it, of sizes that can reach the threshold, hot lists cut into parts. The
components are the same as with all pairs, since a pair inside a component cannot change them.

Tables between the steps are removed as soon as what is made of them is written.

Defined results: a null or empty text has an empty set and is linked with nothing; a text with fewer words than n has one
n-gram, all its words; repeated rows and ids are members of their classes; an id that is null counts as greater
than all others; an empty table gives no rows; other columns are ignored. Sets are compared by 64-bit hashes of n-grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import common
from meshloom.llm.components import connected_components

#: Whole sets up to this size are kept in the table of sets; the light-heavy boundary is at most this.
SMALL = 24
CHUNK = 4 << 20
NULL_ID = (1 << 63) - 1
#: Sets of one list that are joined pair by pair in one group at most.
PART = 2048
#: Cost of a counted n-gram against one enumerated subset: it is shuffled to be counted, to its list and to its set.
SCAN_COST = 3.0


def needed(s: int, t: int, num: int, den: int) -> int:
    """Least overlap of sets of sizes s and t with den * overlap >= num * union."""
    return -(-num * (s + t) // (den + num))


def prefix_size(n: int, num: int, den: int) -> int:
    return n + (num * n) // -den + 1


def low_end(num: int, den: int) -> int:
    """End of the part of the hash range whose n-grams are counted: a third more than a prefix's share, 1 - num / den, so that prefixes lie in it."""
    return min(int(-(2**63) + 4 / 3 * (1 - num / den) * 2**64), 2**63 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sets_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes (int64) of each lower-cased text."""
    split = [t.split() for t in texts]
    words = [w for s in split for w in s]
    h = pd.util.hash_array(np.array([*words, b""], dtype=object), categorize=False)[:-1]
    grams = np.full(max(len(h) - n + 1, 0), n, np.uint64)
    for k in range(n):
        grams = _mix(grams * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(grams)])
    out, at = [], 0
    for s in split:
        if len(s) >= n:
            out.append(np.unique(grams[at : at + len(s) - n + 1].view(np.int64)))
        elif s:
            one = np.full(1, len(s), np.uint64)
            for k in range(len(s)):
                one = _mix(one * np.uint64(0xD6E8FEB86659FD93) + h[at + k : at + k + 1])
            out.append(one.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += len(s)
    return out


def _lower(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass").lower()


def signature(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    sizes, start, size = batch.column(text).to_pandas().str.len().fillna(0).to_numpy(), 0, 0
    for i, s in enumerate(sizes):
        size += s + 100
        if size >= CHUNK or i + 1 == len(sizes):
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0


def _setter(n: int, num: int, den: int):
    end = low_end(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                sets = sets_of([_lower(t) for t in batch.column("text")], n)
                low = [int(np.searchsorted(s, end)) for s in sets]
                k = [max(prefix_size(len(s), num, den), x) if len(s) else 0 for s, x in zip(sets, low, strict=True)]
                kept = [s if len(s) <= SMALL else s[:e] for s, e in zip(sets, k, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*kept, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), pa.array(low, pa.int32()), pa.array(k, pa.int32()), grams], names=["doc_id", "t", "n", "sig", "low", "k", "grams"])

    return run


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def class_tables(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(one row for each document: row, doc_id, t, n, sig, low, k, grams), (one for each different set: sig, row, doc_id, n)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("t"), "text")
    rows = ids.mapInArrow(_setter(n, num, den), "doc_id long, t long, n long, sig binary, low int, k int, grams array<bigint>")
    base = common.written(rows.withColumn("row", F.monotonically_increasing_id()))
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    first = base.filter("n > 0").groupBy("sig").agg(F.min(F.struct(key.alias("doc_id"), F.col("row"), F.col("n"))).alias("f"))
    return base, common.written(first.select("sig", "f.*"))


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The size up to which sets are light: the least cost of enumerated subsets and counted n-grams. ``sizes``: sets by size up to 2 * SMALL."""

    def subsets(s: int, x: int) -> int:
        return sum(comb(s, needed(s, t, num, den)) for t in range(1, x + 1) if min(s, t) >= needed(s, t, num, den) and not s == t == needed(s, t, num, den))

    def cost(x: int) -> float:
        scan = sum(c * SCAN_COST * max(prefix_size(s, num, den), 4 * s * (den - num) // (3 * den)) for s, c in sizes.items() if num * (x + 1) <= den * s)
        return scan + sum(c * subsets(s, x) for s, c in sizes.items() if s <= x)

    return min(range(SMALL + 1), key=lambda x: (cost(x), -x))


def _subsets(x: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, grams in zip(batch.column("row").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                keys, small = [], []
                for t in range(1, x + 1):
                    s = len(grams)
                    c = needed(s, t, num, den)
                    if min(s, t) >= c and not s == t == c:
                        for part in combinations(sorted(grams), c):
                            keys.append(hashlib.blake2b(np.array([min(s, t), max(s, t), *part], np.int64).tobytes(), digest_size=16).digest())
                            small.append(s == min(s, t))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([row] * len(keys), pa.int64()), pa.array(small, pa.bool_())], names=["subset", "row", "hub"])

    return run


def light_links(sets: DataFrame, x: int, num: int, den: int) -> DataFrame:
    """Links of sets of up to x n-grams: each set with the first smaller-side set that shares the subset."""
    keys = sets.filter(F.col("n") <= x).select("row", "grams").mapInArrow(_subsets(x, num, den), "subset binary, row long, hub boolean")
    keys = common.written(keys)
    hubs = keys.filter("hub").groupBy("subset").agg(F.min("row").alias("a"))
    links = common.written(keys.join(hubs, "subset").filter("row <> a").select("a", F.col("row").alias("b")).distinct())
    common.dropped(keys)
    return links


def _shared(posts: DataFrame) -> DataFrame:
    """(gram, row) -> row, g: the n-grams of each row that another row has too, as (df, gram), rarest first."""
    # counts and rows come from one exchange by n-gram, of the same two columns; n-grams of one row end there
    posts = posts.repartition("gram")
    many = posts.groupBy("gram").agg(F.count("*").alias("df"), F.min("row").alias("x"), F.max("row").alias("y")).filter("x < y").select("gram", "df")
    return posts.join(many, "gram").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))


def prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(gram, row): each set's prefix in the order of document frequency, without n-grams that no other set has."""
    posts = sets.select(F.col("row"), F.explode(F.slice("grams", 1, F.col("k"))).alias("gram"))
    rows = _shared(posts.select("gram", "row")).join(sets.select("row", "n", "k", "low"), "row")
    p = F.col("n") - F.expr(f"({num} * n + {den - 1}) div {den}") + 1
    # the others of the k counted n-grams are in no other set and come first
    some = F.slice("g", 1, F.greatest(F.lit(0).cast("long"), p - (F.col("k") - F.size("g"))).cast("int"))
    return rows.select("row", F.explode(F.when(F.col("low") >= p, some).otherwise(F.col("g"))).alias("e")).select("e.gram", "row")


def _reaches(a: str, b: str, num: int, den: int):
    """Whether sets with n and pos (n-grams before the shared one) in columns of these endings can still overlap enough."""
    least = num * (F.col(f"n{a}") + F.col(f"n{b}"))
    return ((den + num) * (F.col(f"n{a}") - F.col(f"pos{a}")) >= least) & ((den + num) * (F.col(f"n{b}") - F.col(f"pos{b}")) >= least)


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(row, n, grams): the whole sets of ``wanted`` (row, doc_id, sig), made from the texts again; only these texts move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                sets = sets_of([_lower(t) for t in batch.column("text")], n)
                # another text under the same id is another set
                own = [i for i, (s, sig) in enumerate(zip(sets, batch.column("sig").to_pylist(), strict=True)) if signature(s) == sig]
                offsets = np.concatenate([[0], np.cumsum([len(sets[i]) for i in own])]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*(sets[i] for i in own), np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(own, pa.int64())), pa.array([len(sets[i]) for i in own], pa.int64()), grams], names=["row", "n", "grams"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    sets = common.written(texts.join(common.if_small(wanted, 1_000_000), "doc_id").select("text", "row", "sig").mapInArrow(run, "row long, n long, grams array<bigint>"))
    if sets.groupBy("row").count().filter("count > 1").limit(1).count():
        once = common.written(sets.dropDuplicates(["row"]))  # rows that repeat id and text
        common.dropped(sets)
        return once
    return sets


def exact_prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(row, n, alone, gram, pos): prefixes of whole sets in the order of document frequency among them; ``alone`` n-grams are in no other set and come first."""
    rows = _shared(sets.select(F.explode("grams").alias("gram"), "row")).join(sets.select("row", "n"), "row")
    rows = rows.select("row", "n", (F.col("n") - F.size("g")).alias("alone"), "g", F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1").alias("p")).filter("p > alone")
    rows = rows.select("row", "n", "alone", F.posexplode(F.slice("g", 1, (F.col("p") - F.col("alone")).cast("int"))).alias("pos", "e"))
    return rows.select("row", "n", "alone", "e.gram", (F.col("pos") + F.col("alone")).alias("pos"))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b: rows of sets) that reach the threshold on the whole sets."""
    rows = pairs
    for side in ("b", "a"):
        rows = rows.join(sets.select(F.col("row").alias(side), F.col("n").alias(f"n_{side}"), F.col("grams").alias(f"g_{side}")), side)
    rows = rows.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("g_a", "g_b")).alias("same"))
    return rows.filter(den * F.col("same") >= num * (F.col("n_a") + F.col("n_b") - F.col("same"))).select("a", "b")


def open_pairs(placed: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of different components that may reach the threshold, of lists (gram, row, n, pos, component) that span several.

    Sets outside a list's largest component meet all others of it. A list is joined in parts: by size, so that only
    sizes whose ratio can reach the threshold meet, and, where more than PART sets are left in a part, by hash.
    """
    sizes = placed.groupBy("gram", "component").agg(F.count("*").alias("c"))
    large = sizes.groupBy("gram").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("all"))
    large = large.select("gram", F.col("m.component").alias("large"), (F.col("all") - F.col("m.c")).alias("others"))
    placed = placed.join(large, "gram")
    # sizes s <= t with num * t <= den * s lie in the same step of the logarithm or in neighbouring ones
    step = F.floor(F.log("n") / float(np.log(den / num)) + 1e-9).cast("int")
    cuts = F.ceil(F.col("others") / PART).cast("int")
    left = placed.filter("component <> large").select("gram", F.explode(F.array(step - 1, step, step + 1)).alias("step"), F.pmod(F.hash("row"), cuts).alias("cut"), F.col("row").alias("a"), F.col("n").alias("na"), F.col("pos").alias("posa"), F.col("component").alias("ca"))
    right = placed.select("gram", step.alias("step"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("cut"), F.col("row").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("posb"), F.col("component").alias("cb"), "large")
    pairs = left.join(right, ["gram", "step", "cut"]).filter("ca <> cb AND (cb = large OR a < b)").filter(_reaches("a", "b", num, den))
    # no more can be shared than the n-grams met in the prefixes and what follows the last of them
    best = F.count("*") + F.least(F.max(F.col("na") - F.lit(1)) - F.max("posa"), F.max(F.col("nb") - F.lit(1)) - F.max("posb"))
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(best.alias("most"), (F.max("na") + F.max("nb")).alias("both"))
    return pairs.filter(f"({den} + {num}) * most >= {num} * both").select("a", "b")


def heavy_links(sets: DataFrame, docs: DataFrame, classes: DataFrame, known: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links that, with ``known``, connect all sets that a chain of links connects."""
    # sets that share something in a prefix of their counted n-grams; most texts of a corpus end here
    lists = common.written(prefixes(sets, num, den))
    met = lists.join(lists.groupBy("gram").count().filter("count > 1"), "gram", "left_semi").select("row").distinct()
    wanted = common.written(classes.join(met, "row").select("row", "doc_id", "sig"))
    common.dropped(lists)
    whole = whole_sets(docs, wanted, n)
    lists = common.written(exact_prefixes(whole, num, den))
    common.dropped(wanted)
    # first, each set with the hub that it meets most often: of a list, the set with the smallest share of n-grams of its own
    hubs = lists.groupBy("gram").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("x"), "row", "n", "pos")).alias("h")).select("gram", F.col("h.row").alias("a"), F.col("h.n").alias("na"), F.col("h.pos").alias("posa"))
    seen = lists.select("gram", F.col("row").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("posb"))
    seen = seen.join(hubs, "gram").filter("a <> b").filter(_reaches("a", "b", num, den)).groupBy("a", "b").agg(F.count("*").alias("c"))
    first = common.written(seen.groupBy("b").agg(F.max(F.struct(F.col("c"), (-F.col("a")).alias("x"))).alias("m")).select((-F.col("m.x")).alias("a"), "b"))
    links = common.written(verified(first, whole, num, den).unionByName(known))
    # then pairs of the lists that still span several components
    labels = connected_components(links)
    placed = lists.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    open_ = placed.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("gram")
    placed = common.written(placed.join(open_, "gram").select("gram", "row", "n", "pos", "component"))
    common.dropped(lists)
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = common.written(open_pairs(placed, num, den).join(tested, ["a", "b"], "left_anti"))
    common.dropped(placed, first)
    more = common.written(verified(pairs, whole, num, den).unionByName(links))
    common.dropped(pairs, links, whole)
    return more


def labelled(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, t, n, sig) of each of ``docs``, and (sig, row, doc_id, node) of each different set; node: the row that stands for its component."""
    base, classes = class_tables(docs, n, num, den)
    sizes = {r.n: r["count"] for r in classes.filter(F.col("n") <= 2 * SMALL).groupBy("n").count().collect()}
    x = boundary(sizes, num, den)
    # rows whose set another row stands for
    others = common.written(base.select("row").join(classes.select("row"), "row", "left_anti"))
    sets = base.select("row", "n", "grams", "k", "low").join(common.if_small(others, 1_000_000), "row", "left_anti").filter("n > 0")
    light = light_links(sets, x, num, den)
    scanned = sets.filter(F.col("n") * den >= num * (x + 1))
    links = heavy_links(scanned, docs, classes, light, n, num, den)
    rows = common.written(base.select("row", "doc_id", "t", "n", "sig"))
    common.dropped(base, others, light)
    named = connected_components(links).withColumnRenamed("node", "row")
    named = common.written(classes.join(named, "row", "left").select("sig", "row", "doc_id", F.coalesce("component", "row").alias("node")))
    common.dropped(classes, links)
    return rows, named


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each of ``docs`` (doc_id, text): components of links with den * overlap >= num * union."""
    rows, named = labelled(docs, n, num, den)
    least = named.groupBy("node").agg(F.min("doc_id").alias("component_id"))
    class_of = named.select("sig", "node").join(least, "node").select("sig", "component_id")
    return rows.select("doc_id", "n", "sig").join(class_of, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component_id", "doc_id"), F.lit(NULL_ID)).alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without those that another row stands for.

    Of each component one row stays: that of the least id, null ids last; of rows that share this id, one. Rows without words stay all.
    """
    rows, named = labelled(docs, n, num, den)
    stays = common.written(named.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("m")).select("m.row"))
    # a row of docs is told from others by its id and the hash of its text; rows that agree in both are repeats
    keys = rows.filter("n > 0").select("row", F.coalesce("doc_id", F.lit(NULL_ID)).alias("i"), "t")
    gone = common.written(keys.join(stays, "row", "left_anti").select("i", "t").distinct())
    again = common.written(gone.join(keys.join(stays, "row").select("i", "t"), ["i", "t"], "left_semi"))
    none = common.written(gone.join(again, ["i", "t"], "left_anti"))
    common.dropped(rows, named, stays, gone)
    at = docs.select(F.struct("*").alias("d"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("i"), _text_hash().alias("t"))
    left = at.join(common.if_small(none, 1_000_000), ["i", "t"], "left_anti")
    again = common.if_small(again)
    once = left.join(again, ["i", "t"], "left_semi").dropDuplicates(["i", "t"])
    return left.join(again, ["i", "t"], "left_anti").select("d.*").unionByName(once.select("d.*"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"), n=4, num=85)


def sql_components(docs: str, n: int, num: int, den: int = 100) -> str:
    """CTEs ending in _comp (doc_id, n_shingles, component_id) over a relation with doc_id (unique) and text."""
    return rf"""
_words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM {docs}),
_sh AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - {n - 2})) AS i FROM _words WHERE len(w) >= {n})
  UNION ALL SELECT doc_id, len(w) || ':' || array_to_string(w, ' ') FROM _words WHERE len(w) BETWEEN 1 AND {n - 1})),
_size AS MATERIALIZED (SELECT doc_id, COUNT(*) AS n FROM _sh GROUP BY doc_id),
_links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS o FROM _sh x JOIN _sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN _size s ON s.doc_id = a JOIN _size t ON t.doc_id = b WHERE {den} * o >= {num} * (s.n + t.n - o)),
_reach AS (SELECT a AS node, b AS other FROM _links UNION SELECT b, a FROM _links),
_walk AS (WITH RECURSIVE walk(node, other) AS (SELECT node, other FROM _reach UNION SELECT walk.node, r.other FROM walk JOIN _reach r ON r.node = walk.other) SELECT node, MIN(other) AS least FROM walk GROUP BY node),
_comp AS (SELECT d.doc_id, CAST(COALESCE(s.n, 0) AS BIGINT) AS n_shingles, LEAST(d.doc_id, COALESCE(least, d.doc_id)) AS component_id
  FROM {docs} d LEFT JOIN _size s ON s.doc_id = d.doc_id LEFT JOIN _walk ON node = d.doc_id)
"""


SQL = "WITH " + sql_components("documents", 4, 85) + "SELECT * FROM _comp"
