"""Near duplicates by SetSketch registers of word shingles.

Each different shingle set is sketched into ``M`` registers. A register holds the least of the set's exponentially distributed hash
values on an exponential scale of base ``BASE``, truncated to 16 bits; the union of sets has the greater of their registers, so
sketches merge in any order, and registers of similar sets agree with a chance of about their Jaccard similarity. Bands of
``ROWS`` registers are posted to lists; sets that agree in a whole band meet there. For pairs that met, the similarity is estimated from all
registers by maximum likelihood, jointly with the known sizes: how many are greater, smaller and equal. Pairs that are less
likely at the threshold than at the estimate by a factor of e^``DOUBT`` end there, the others are verified on their full sets.

Pairs of a list are not expanded: each set is tested against the hub of its lists first. Sets of lists that then still span several
components are paired by the rarest shingles that two linked sets must share, as in ``ngram_join``, which gives the components of all links. Two sets of similarity exactly 0.8 share no band of 80
with a chance of 4e-7, of 0.85 with 2e-11; the estimate ends a link with less than 1e-11. No list is capped.

Defined results: as in ``ngram_join``; ``kept`` of a null id is whether all ids of its component are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import common
from meshloom.llm.components import connected_components
from meshloom.llm.ngram_join import NULL_ID, _lower, _mix, _slices, exact_prefixes, open_pairs, sets_of, signature, sql_components, verified, whole_sets

BANDS, ROWS = 80, 8
M = BANDS * ROWS
#: The scale of the registers: base, rate of the exponential distribution, greatest value.
BASE, RATE, MOST = 1.001, 20.0, (1 << 16) - 1
#: Log of the likelihood ratio beyond which a pair is not verified.
DOUBT = 25.0
#: Shingles whose hashes are made together.
BLOCK = 64

_RNG = np.random.Generator(np.random.PCG64(1))
_TIMES = _RNG.integers(0, 1 << 32, M, np.uint32) | np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, M, np.uint32)


def registers(grams: np.ndarray) -> np.ndarray:
    """The ``M`` registers (uint16) of a set of 64-bit hashes; zeros for the empty set."""
    if not len(grams):
        return np.zeros(M, np.uint16)
    h = grams.view(np.uint64)
    h = ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    best, room = np.zeros(M, np.uint32), np.empty((BLOCK, M), np.uint32)
    for at in range(0, len(h), BLOCK):
        part = h[at : at + BLOCK, None]
        values = np.multiply(part, _TIMES, out=room[: len(part)])
        values += _PLUS
        np.maximum(best, values.max(axis=0), out=best)
    # the greatest uniform value has the least exponential one
    least = -np.log1p(-((1 << 32) - best.astype(np.float64) - 0.5) / (1 << 32)) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, MOST).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def bands(of: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of the registers, different bands apart."""
    values = of.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + values[:, k] + np.uint64(1))
    return key.view(np.int64)


def log_likelihood(j: np.ndarray, na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Of similarity ``j``, where of sets of sizes ``na`` and ``nb`` so many registers of the first are greater and smaller than the second's."""

    def chance(x):  # that the register of a part with this share of the union stands alone above
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def term(count, p):
        return np.where(count > 0, count * np.log(np.maximum(p, 1e-300)), 0.0)

    u, v = na / (na + nb), nb / (na + nb)
    p, q = chance(u - v * j), chance(v - u * j)
    return term(more, p) + term(less, q) + term(M - more - less, 1 - p - q)


def estimated(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood; it is concave, so thirds of the interval are cut off."""
    low, high = np.zeros(len(na)), np.minimum(na, nb) / np.maximum(na, nb)
    for _ in range(50):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = log_likelihood(a, na, nb, more, less) > log_likelihood(b, na, nb, more, less)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def likely(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray, least: float) -> np.ndarray:
    """Whether the registers leave room for a similarity of ``least`` or more."""
    best = estimated(na, nb, more, less)
    fall = log_likelihood(best, na, nb, more, less) - log_likelihood(np.full(len(na), least), na, nb, more, less)
    return (np.minimum(na, nb) >= least * np.maximum(na, nb) * (1 - 1e-12)) & ((best >= least) | (fall <= DOUBT))


def _sketcher(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                sets = sets_of([_lower(t) for t in batch.column("text")], n)
                keys = [bands(registers(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), lists], names=["doc_id", "n", "sig", "bands"])

    return run


def _registers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets = batch.column("grams").values.to_numpy(), batch.column("grams").offsets.to_numpy()
        held = [registers(values[a:b]).tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array(held, pa.binary())], names=["row", "n", "registers"])


def _likely(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            a, b = (np.frombuffer(b"".join(rows[c]), np.uint16).reshape(-1, M) for c in ("r_a", "r_b"))
            ok = likely(rows["n_a"].to_numpy(float), rows["n_b"].to_numpy(float), (a > b).sum(axis=1), (a < b).sum(axis=1), least)
            yield rows.loc[ok, ["a", "b"]]

    return run


def confirmed(pairs: DataFrame, sketches: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Links among ``pairs`` (a, b): likely by their registers, then verified on the full sets."""
    rows = pairs
    for side in ("b", "a"):
        rows = rows.join(sketches.select(F.col("row").alias(side), F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}")), side)
    some = rows.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInPandas(_likely(num / den), "a long, b long")
    return verified(some, whole, num, den)


def lists_of(posts: DataFrame) -> DataFrame:
    """``posts`` (gram, row, n) of keys that several sets have, with their number c."""
    many = common.written(posts.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1"))
    lists = common.written(posts.join(common.if_small(many), "gram"))
    common.dropped(many)
    return lists


def linked(lists: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), stored: links that connect all sets that a chain of links between sets that met in ``lists`` (stored) connects."""
    sketches = common.written(whole.mapInArrow(_registers, "row long, n long, registers binary"))
    # the hub of a list: the set that meets most others in all of its lists, so the middle of a group of copies
    seats = common.written(lists.groupBy("row").agg(F.sum(F.col("c") - 1).alias("met")))
    hubs = lists.join(seats, "row").groupBy("gram").agg(F.max(F.struct("met", (-F.col("row")).alias("x"), "n")).alias("h"))
    hubs = common.written(hubs.select("gram", (-F.col("h.x")).alias("a"), F.col("h.n").alias("na")))
    seen = lists.join(hubs, "gram").filter("a <> row").filter(den * F.least("n", "na") >= num * F.greatest("n", "na"))
    seen = seen.groupBy("a", F.col("row").alias("b")).agg(F.count("*").alias("c"))
    first = common.written(seen.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("x"))).alias("m")).select((-F.col("m.x")).alias("a"), "b"))
    links = common.written(confirmed(first, sketches, whole, num, den))
    common.dropped(seats, hubs)
    # then the sets of lists that still span several components: those of different components that can reach the threshold share
    # a shingle among the rarest of each, and meet by that instead of in the crowded list
    labels = common.written(connected_components(links).withColumnRenamed("node", "row"))
    named = lambda rows: rows.join(labels, "row", "left").withColumn("component", F.coalesce("component", "row"))
    open_ = named(lists.select("gram", "row")).groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("gram")
    open_ = common.written(open_)
    rows = common.written(lists.select("gram", "row").join(open_, "gram", "left_semi").select("row").distinct())
    rare = common.written(exact_prefixes(whole.join(rows, "row", "left_semi"), num, den))
    placed = named(rare.select("gram", "row", "n", "pos"))
    apart = common.written(placed.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("gram"))
    placed = common.written(placed.join(apart, "gram", "left_semi"))
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = common.written(open_pairs(placed, num, den).join(tested, ["a", "b"], "left_anti"))
    more = common.written(confirmed(pairs, sketches, whole, num, den).unionByName(links))
    common.dropped(labels, open_, rows, rare, apart, placed, first, pairs, links, sketches)
    return more


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each of ``docs`` (doc_id, text); links have den * overlap >= num * union."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = common.written(rows.mapInArrow(_sketcher(n), "doc_id long, n long, sig binary, bands array<bigint>").withColumn("row", F.monotonically_increasing_id()))
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    classes = base.filter("n > 0").groupBy("sig").agg(F.min(F.struct(key.alias("doc_id"), F.col("row"), F.col("n"))).alias("f"))
    classes = common.written(classes.select("sig", "f.*"))
    # rows whose set another row stands for
    others = common.written(base.select("row").join(classes.select("row"), "row", "left_anti"))
    posts = base.select("row", "n", "bands").join(common.if_small(others), "row", "left_anti").select(F.explode("bands").alias("gram"), "row", "n")
    lists = lists_of(posts)
    wanted = common.written(classes.join(lists.select("row").distinct(), "row").select("row", "doc_id", "sig"))
    whole = whole_sets(docs, wanted, n)
    links = linked(lists, whole, num, den)
    common.dropped(others, lists, wanted, whole)
    named = connected_components(links).withColumnRenamed("node", "row")
    named = classes.join(named, "row", "left").select("sig", "doc_id", F.coalesce("component", "row").alias("node"))
    named = common.written(named)
    least = named.groupBy("node").agg(F.min("doc_id").alias("component_id"))
    class_of = named.select("sig", "node").join(least, "node").select("sig", "component_id")
    out = base.select("doc_id", "n", "sig").join(class_of, "sig", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component_id", "doc_id"), F.lit(NULL_ID)).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_set_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), n=2, num=80)


SQL = "WITH " + sql_components("documents", 2, 80) + "SELECT *, doc_id = component_id AS kept FROM _comp"
