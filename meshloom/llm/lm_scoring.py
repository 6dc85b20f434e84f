"""Language-model scores by context-tree weighting over bytes.

Training: every training text, lower-cased (A-Z) with one zero byte as its end, gives counts of bytes in their
contexts of up to ``DEPTH`` preceding bytes. All contexts are kept. A byte is eight binary decisions; each decision node
has Krichevsky-Trofimov estimates in each context, and weighting bottom-up (half stop here, half go deeper) mixes all
depths. The tree is a table of (context, decision) rows for each depth, weighted from the deepest to the root by one
aggregation a depth and read from the root down by one join a depth; what comes out is the log-probability of
each byte after each deepest context that any text has, so texts outside training find theirs too (with counts of 0).

The base score is a smoothed unigram over words. Words with at least 1/``MOST_WORDS`` of all tokens and contexts with
their byte with at least 1/``MOST_KEYS`` of all bytes (so no more than so many) are sent to all tasks; the others, with
their exact values, are joined to the places of the texts where they stand.

Defined results: a null text is the empty text, one end token; a null id is the text ''; repeated rows are scored and,
if in training, counted each; with no training text the base score is 0 and each bit of the model even; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import common

DEPTH = 4
MOST_WORDS = 1 << 17
MOST_KEYS = 1 << 21
#: Every so many-th text by CRC-32 of its id is held out.
HOLD_OUT = 10
#: Bytes of text handled at once, and entries gathered before a task hands its counts on.
CHUNK, FLUSH = 4 << 20, 2_000_000
END = np.uint64(0)


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HOLD_OUT == 0


def _chunks(batches: Iterator[pa.RecordBatch], keep=lambda doc_id: True):
    """Lists of (rest of the row, lower-cased bytes of its text) of about CHUNK bytes."""
    out, size = [], 0
    for batch in batches:
        names = batch.schema.names
        others = [batch.column(n).to_pylist() for n in names if n != "text"]
        ids = others[names.index("doc_id")]
        for i, text in enumerate(batch.column("text")):
            if keep(ids[i]):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
                out.append((tuple(o[i] for o in others), data))
                size += len(data) + 64
                if size >= CHUNK:
                    yield out
                    out, size = [], 0
    if out:
        yield out


def _hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array([*words, b""], dtype=object), categorize=False)[:-1]


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, with DEPTH zero bytes before and after each text, and where each text and its end byte stand."""
    pad = b"\0" * DEPTH
    data = np.frombuffer(pad + pad.join([*texts, b""]), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = DEPTH + np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]]) if len(texts) else sizes
    return data, np.stack([starts, starts + sizes + 1]) if len(texts) else np.zeros((2, 0), np.int64)


def _positions(bounds: np.ndarray) -> np.ndarray:
    sizes = bounds[1] - bounds[0]
    return np.repeat(bounds[0] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each byte with its DEPTH predecessors, the nearest lowest."""
    key = data[at].astype(np.uint64)
    for d in range(1, DEPTH + 1):
        key |= data[at - d].astype(np.uint64) << np.uint64(8 * d)
    return key


class _Sums:
    """Sums of counts by key, merged as they come."""

    def __init__(self):
        self.keys, self.n = [], []
        self.size = 0

    def add(self, keys: np.ndarray, weight: int = 1) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.n.append(n * weight)
        self.size += len(k)
        if self.size > FLUSH:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            k, back = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.keys, self.n = [k], [np.bincount(back, np.concatenate(self.n)).astype(np.int64)]
            self.size = len(k)
        return (self.keys[0], self.n[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, grams = _Sums(), _Sums()

    def told(kind: int, sums: _Sums) -> Iterator[pa.RecordBatch]:
        k, n = sums.merge()
        sums.__init__()
        for at in range(0, len(k), 100_000):
            part = k[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[at : at + 100_000].astype(np.int64))], names=["kind", "key", "n"])

    for chunk in _chunks(batches):
        for weight in (1, 0):  # held-out texts only name their contexts
            texts = [t for (doc_id,), t in chunk if is_held_out(doc_id) != weight]
            if weight and texts:
                words.add(np.concatenate([_hashes([w for t in texts for w in t.split()]), np.full(len(texts), END)]))
            data, bounds = _laid_out(texts)
            where = _positions(bounds)
            for at in range(0, len(where), CHUNK):
                grams.add(_keys(data, where[at : at + CHUNK]), weight)
        for kind, sums in ((0, words), (1, grams)):
            if sums.size > FLUSH:
                yield from told(kind, sums)
    yield from told(0, words)
    yield from told(1, grams)


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all training texts; kind 0: words by hash, kind 1: bytes with their DEPTH predecessors, n = 0 for those of held-out texts alone."""
    return docs.select("doc_id", "text").mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function, by Stirling's series at x + 8."""
    shift = x
    for k in range(1, 8):
        shift = shift * (x + k)
    y = x + 8
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(shift)


def _evidence(a: Column, b: Column) -> Column:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return F.when(a + b == 0, 0.0).otherwise(_log_gamma(a + 0.5) + _log_gamma(b + 0.5) - math.log(math.pi) - _log_gamma(a + b + 1))


def _decisions(grams: DataFrame, *columns: str) -> DataFrame:
    """(key, ...) -> context, node (a byte's decision: 1 for the first, 2k and 2k + 1 after decision k), bit, and ``columns``; eight rows of each."""
    rows = grams.select(*columns, F.shiftrightunsigned("key", 8).alias("context"), F.col("key").bitwiseAND(255).cast("int").alias("byte"), F.explode(F.array(*(F.lit(k) for k in range(8)))).alias("k"))
    return rows.select(*columns, "context", F.expr("shiftright(byte | 256, 8 - k)").alias("node"), F.expr("shiftright(byte, 7 - k) & 1").alias("bit"))


def tree_levels(grams: DataFrame) -> list[DataFrame]:
    """For each depth from 0: (context, node, a, b, own, weighted), of the contexts of the deepest and their suffixes.

    a and b: zeros and ones; own: log-probability of these by the estimates of the context itself; weighted: mixed with those of deeper contexts.
    """
    a, b = F.sum(F.col("n") * (1 - F.col("bit"))), F.sum(F.col("n") * F.col("bit"))
    level = _decisions(grams, "n").groupBy("context", "node").agg(a.alias("a"), b.alias("b"))
    level = level.withColumn("own", _evidence(F.col("a").cast("double"), F.col("b").cast("double"))).withColumn("weighted", F.col("own"))
    levels = [common.written(level)]
    for d in range(DEPTH - 1, -1, -1):
        shorter = F.col("context").bitwiseAND((1 << 8 * d) - 1).alias("context")
        level = levels[0].select(shorter, "node", "a", "b", "weighted").groupBy("context", "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("below"))
        level = level.withColumn("own", _evidence(F.col("a").cast("double"), F.col("b").cast("double")))
        mixed = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) + math.log(0.5)
        levels.insert(0, common.written(level.select("context", "node", "a", "b", "own", mixed.alias("weighted"))))
    return levels


def byte_logs(grams: DataFrame) -> DataFrame:
    """(key, n) -> key, n, value: the log10-probability of each byte after its context, all depths mixed."""
    levels = tree_levels(grams)
    path = None
    for d, level in enumerate(levels):
        stop = F.lit(1.0) if d == DEPTH else F.exp(F.least(F.lit(0.0), math.log(0.5) + F.col("own") - F.col("weighted")))
        level = level.select("context", "node", ((F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)).alias("kt"), stop.alias("stop"))
        if path is None:
            path = level.select("context", "node", (F.col("stop") * F.col("kt")).alias("one"), (1 - F.col("stop")).alias("left"))
        else:
            level = level.withColumn("up", F.col("context").bitwiseAND((1 << 8 * (d - 1)) - 1))
            path = level.join(path.withColumnRenamed("context", "up"), ["up", "node"]).select("context", "node", (F.col("one") + F.col("left") * F.col("stop") * F.col("kt")).alias("one"), (F.col("left") * (1 - F.col("stop"))).alias("left"))
    one = F.least(F.greatest("one", F.lit(1e-12)), F.lit(1 - 1e-12))
    each = _decisions(grams, "key", "n").join(path, ["context", "node"])
    logs = common.written(each.groupBy("key").agg(F.first("n").alias("n"), F.sum(F.log10(F.when(F.col("bit") == 1, one).otherwise(1 - one))).alias("value")))
    common.dropped(*levels)
    return logs


class Table:
    """Values of 64-bit keys: one probe of a table of slots, a binary search for keys that share a slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.slots = None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its place."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        if self.slots is None:  # made in the task, so that it is not sent
            self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
            self.slots[self._slot(self.keys)] = np.arange(len(self.keys))
        at = self.slots[self._slot(keys)].astype(np.int64)
        known = self.keys[at] == keys
        rest = np.flatnonzero(~known)
        at[rest] = np.minimum(np.searchsorted(self.keys, keys[rest]), len(self.keys) - 1)
        known[rest] = self.keys[at[rest]] == keys[rest]
        return known, at

    def sums(self, keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of the values by owner, number of keys found by owner, and which keys are not there."""
        known, at = self.find(keys)
        hit = np.flatnonzero(known)
        return np.bincount(owner[hit], self.values[at[hit]], n), np.bincount(owner[hit], minlength=n), np.flatnonzero(~known)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, contexts = model.value
        for chunk in _chunks(batches):
            texts = [t for _, t in chunk]
            split = [t.split() for t in texts]
            n, k = np.array([len(w) for w in split], dtype=np.int64), len(texts)
            owner = np.concatenate([np.repeat(np.arange(k), n), np.arange(k)])
            h = np.concatenate([_hashes([w for s in split for w in s]), np.full(k, END)])
            base, n_known, rest = words.sums(h, owner, k)
            asked = [(0, owner[rest], h[rest])]
            data, bounds = _laid_out(texts)
            where, owner, score = _positions(bounds), np.repeat(np.arange(k), bounds[1] - bounds[0]), np.zeros(k)
            for at in range(0, len(where), CHUNK // 4):
                key, mine = _keys(data, where[at : at + CHUNK // 4]), owner[at : at + CHUNK // 4]
                part, _, rest = contexts.sums(key, mine, k)
                score += part
                asked.append((1, mine[rest], key[rest]))
            rows, ids = np.array([r[1] for r, _ in chunk], np.int64), [r[0] for r, _ in chunk]
            m = sum(len(x) for _, x, _ in asked)
            none = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([rows, *(rows[x] for _, x, _ in asked)])), none([None if i is None else str(i) for i in ids], pa.string()), none([is_held_out(i) for i in ids], pa.bool_()),
                none(n + 1, pa.int64()), none(n_known, pa.int64()), none(base, pa.float64()), none(score, pa.float64()),
                # a text's own row (kind 2) goes to any partition; the others to that of their word (0) or context and byte (1)
                pa.array(np.concatenate([np.full(k, 2, np.int32), *(np.full(len(x), kind, np.int32) for kind, x, _ in asked)])),
                pa.array(np.concatenate([rows * 2654435761 % (1 << 62), *(x.view(np.int64) for _, _, x in asked)])),
            ], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "kind", "key"])

    return run


def _parted(values: DataFrame, total: int, most: int) -> tuple[Table, DataFrame]:
    """(key, n, value): those with at least 1/``most`` of ``total`` as a table, so no more than ``most``, and the others."""
    often = F.col("n") * most >= max(total, 1)
    rows = values.filter(often).select("key", "value").toArrow()
    return Table(rows["key"].to_numpy().view(np.uint64), rows["value"].to_numpy()), values.filter(~often).select("key", "value")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    counted = common.written(counts(docs))
    words, grams = counted.filter("kind = 0").drop("kind"), counted.filter("kind = 1").drop("kind")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_bytes = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    unit = total.n + 0.1 * (total.v + 1)
    words = words.withColumn("value", F.log10((F.col("n") + 0.1) / F.lit(float(unit))))
    word_table, rare_words = _parted(words, total.n, MOST_WORDS)
    byte_table, rare_bytes = _parted(byte_logs(grams), n_bytes, MOST_KEYS)
    model = spark.sparkContext.broadcast((word_table, byte_table))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = "row long, doc_id string, held_out boolean, n_tokens long, n_known long, base double, score double, kind int, key long"
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(_scorer(model), schema)
    rare = rare_words.withColumn("kind", F.lit(0)).unionByName(rare_bytes.withColumn("kind", F.lit(1)))
    rows = rows.join(rare, ["key", "kind"], "left")
    unseen = math.log10(0.1 / unit)
    sums = rows.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.count_if((F.col("kind") == 0) & F.col("value").isNotNull())).cast("long").alias("n_known"),
        F.sum(F.when(F.col("kind") == 0, F.coalesce("value", F.lit(unseen))).otherwise(F.col("base"))).alias("base_score"),
        F.sum(F.when(F.col("kind") == 1, F.col("value")).otherwise(F.col("score"))).alias("score"),
    )
    return sums.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", F.coalesce("n_known", F.lit(0)).cast("long").alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
