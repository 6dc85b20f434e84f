"""Importance resampling of documents towards a target: hashed n-gram features, log gains, Gumbel draws.

A text is normalised as bytes: words of a batch stand in one buffer with a blank between them, so a feature of one or two
words is a span of it. Spans are interned in an open-addressed table made of NumPy arrays: the xxHash64 of the
span's bytes picks the slot, spans that meet in a slot are compared byte by byte, and a slot holds its feature's bucket and count. Checksums are
thus taken once for each different feature of a table, and each occurrence keeps only its slot. One pass over each corpus adds up the slots'
counts by bucket; a second gathers each occurrence's gain by its slot. Tables hold the features of ``RUN`` words, so a text of any length
is worked through in bounded memory besides its own bytes.

The driver holds one number for each bucket. Draws are numbered in sorted spans, so no task ranks more than its span.

Defined results: a null or empty text has no features, weight 0 and is not drawn; rows that repeat an id are separate rows that
share their random number; a null id has the random number of the empty id and loses ties; an empty table gives
no rows, an empty target or corpus counts as 0 features; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import common, merkle

BUCKETS = 10_000
SEED = 7
#: Fewest words of a document that may be drawn, and the percentage drawn of these.
LEAST_WORDS, PERCENT = 20, 25
#: Words whose features share a table, and bytes of texts that are normalised together.
RUN, CHUNK = 1 << 15, 1 << 20

_BYTE = np.arange(256)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: Digits, small letters and all bytes of characters beyond ASCII.
WORD = (_BYTE >= 128) | (_BYTE >= 48) & (_BYTE <= 57) | (_BYTE >= 97) & (_BYTE <= 122)

#: Fixed values of xxHash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Spans of so many bytes and more are hashed, checked and compared one by one.
LONG = 32
#: The CRC-32 of each byte, by the reversed polynomial.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & np.uint32(1), (CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), CRC >> np.uint32(1))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class Spans:
    """Spans of a buffer of bytes, with all of their eight-byte and four-byte words at hand."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.starts, self.sizes = starts, sizes
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        n = len(self.data)
        self.eights = np.ndarray((n - 7,), "<u8", self.data, 0, (1,))
        self.fours = np.ndarray((n - 3,), "<u4", self.data, 0, (1,))

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.starts[k] + self.sizes[k]].tobytes()

    def hashes(self) -> np.ndarray:
        """xxHash64 of each span."""
        at, left = self.starts.copy(), self.sizes.copy()
        left[left >= LONG] = 0
        h = _P5 + self.sizes.astype(np.uint64)
        for _ in range(LONG // 8 - 1):
            k = np.flatnonzero(left >= 8)
            if not len(k):
                break
            h[k] = _rotated(h[k] ^ _rotated(self.eights[at[k]] * _P2, 31) * _P1, 27) * _P1 + _P4
            at[k] += 8
            left[k] -= 8
        k = np.flatnonzero(left >= 4)
        h[k] = _rotated(h[k] ^ self.fours[at[k]].astype(np.uint64) * _P1, 23) * _P2 + _P3
        at[k] += 4
        left[k] -= 4
        for _ in range(3):
            k = np.flatnonzero(left >= 1)
            h[k] = _rotated(h[k] ^ self.data[at[k]].astype(np.uint64) * _P5, 11) * _P1
            at[k] += 1
            left[k] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
        for k in np.flatnonzero(self.sizes >= LONG):
            h[k] = xxhash.xxh64_intdigest(self.bytes_of(k))
        return h

    def checksums(self, which: np.ndarray) -> np.ndarray:
        """CRC-32 of the spans numbered ``which``; those of equal size step through their bytes together."""
        by_size = np.argsort(-self.sizes[which], kind="stable")
        order = which[by_size]
        size, at = self.sizes[order], self.starts[order]
        crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
        short = int(np.searchsorted(-size, -LONG, side="right"))
        for k in range(LONG - 1):
            on = slice(short, int(np.searchsorted(-size, -k)))
            if on.stop <= short:
                break
            crc[on] = CRC[(crc[on] ^ self.data[at[on] + k]) & np.uint32(255)] ^ (crc[on] >> np.uint32(8))
        crc = ~crc
        crc[:short] = [zlib.crc32(self.bytes_of(k)) for k in order[:short]]
        out = np.empty(len(which), np.uint32)
        out[by_size] = crc
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the spans numbered ``a`` have the bytes of those numbered ``b``."""
        size = self.sizes[a]
        same = size == self.sizes[b]
        for k in np.flatnonzero(same & (size >= LONG)):
            same[k] = self.bytes_of(a[k]) == self.bytes_of(b[k])
        for done in range(0, LONG, 8):
            k = np.flatnonzero(same & (size > done) & (size < LONG))
            if not len(k):
                break
            differ = self.eights[self.starts[a[k]] + done] ^ self.eights[self.starts[b[k]] + done]
            past = (8 * np.maximum(done + 8 - size[k], 0)).astype(np.uint64)  # bits after the span's end
            same[k] = differ << past == 0
        return same


class Table:
    """Spans interned by open addressing: ``slot_of`` each occurrence, and per used slot its bucket and count."""

    def __init__(self, spans: Spans, buckets: int):
        keys, n = spans.hashes(), len(spans.starts)
        size = 1 << max(2 * n - 1, 1).bit_length()
        owner = np.full(size, -1, np.int64)
        self.slot_of = (keys & np.uint64(size - 1)).astype(np.int64)
        open_ = np.arange(n)
        while len(open_):
            slot = self.slot_of[open_]
            free = owner[slot] < 0
            owner[slot[free]] = open_[free]  # of several that claim a slot, one has it
            holder = owner[slot]
            same = keys[holder] == keys[open_]
            same[same] = spans.equal(open_[same], holder[same])
            open_ = open_[~same]
            self.slot_of[open_] = (self.slot_of[open_] + 1) & (size - 1)
        self.used = np.flatnonzero(owner >= 0)
        self.bucket = np.zeros(size, np.int64)
        self.bucket[self.used] = spans.checksums(owner[self.used]) % np.uint32(buckets)
        self.count = np.bincount(self.slot_of, minlength=size)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, one after the other in ``data``, as (bytes of all words with a blank after each, starts, sizes, text of each word)."""
    low = LOWER[data]
    word = WORD[low]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
    begin = np.flatnonzero(word & (~before | first[:-1]))
    size = np.flatnonzero(word & (~after | first[1:])) + 1 - begin
    start = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    own = np.ones(len(out), bool)
    own[start + size] = False
    out[own] = low[word]
    return out, start, size, np.searchsorted(offsets, begin, side="right") - 1


def tables(data: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[Table, np.ndarray]]:
    """(table, text of each occurrence) over the texts' words and pairs of words, ``RUN`` words at a time."""
    out, start, size, text = normalised(data, offsets)
    for at in range(0, len(start), RUN):
        end = min(at + RUN, len(start))
        pairs = np.arange(at, min(end, len(start) - 1))  # the last pair may end in the next run
        pairs = pairs[text[pairs] == text[pairs + 1]]
        low, high = start[at], start[min(end, len(start) - 1)] + size[min(end, len(start) - 1)]
        starts = np.concatenate([start[at:end], start[pairs]]) - low
        sizes = np.concatenate([size[at:end], size[pairs] + 1 + size[pairs + 1]])
        yield Table(Spans(out[low:high], starts, sizes), buckets), np.concatenate([text[at:end], text[pairs]])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, offsets): some ``CHUNK`` bytes at a time, a longer text alone."""
    for batch in batches:
        column = batch.column("text").cast(pa.string())
        if column.null_count:
            column = column.fill_null("")
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + CHUNK, side="right")) - 1)
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], (ends[at : to + 1] - ends[at]).astype(np.int64)
            at = to


def _counter(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in _texts(batches):
            for table, _ in tables(data, offsets, buckets):
                np.add.at(total, table.bucket[table.used], table.count[table.used])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of features of all ``texts`` (text) by bucket."""
    return texts.select("text").mapInArrow(_counter(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: dict[int, int], corpus: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """A bucket's gain: floor(1000 ln of its share in the target over that in the corpus, each count more by one)."""
    t, s = sum(target.values()) + buckets, sum(corpus.values()) + buckets
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * s / ((corpus.get(b, 0) + 1) * t))) for b in range(buckets)], np.int64)


def _weigher(gain: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _texts(batches):
            n, total = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows)
            for table, text in tables(data, offsets, len(gain)):
                n += np.bincount(text, minlength=rows.num_rows)
                total += np.bincount(text, gain[table.bucket[table.slot_of]], rows.num_rows)  # whole numbers, exact in doubles
            weight = np.floor_divide(total.astype(np.int64), np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(weight)], names=["doc_id", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each of ``docs`` (doc_id, text): drawn without replacement by how much they resemble ``target`` (text)."""
    # bounded by the number of buckets
    t, s = ({r.bucket: r.n for r in bucket_counts(x, buckets).collect()} for x in (target, docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_weigher(gains(t, s, buckets)), "doc_id long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    luck = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = common.written(rows.withColumn("score", F.col("weight") + luck).withColumn("row", F.monotonically_increasing_id()))
    enough = F.col("n_features") >= 2 * least - 1  # n words have n - 1 pairs
    able = common.numbered(rows.filter(enough), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")])
    drawn = able.count() * percent // 100
    able = able.withColumn("rank", F.when(F.col("number") < drawn, F.col("number") + 1))
    others = rows.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return able.select(*columns).unionByName(others.select(*columns))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH crc AS (SELECT {merkle.CRC_TABLE} AS tab),
texts AS (SELECT TRUE AS corpus, doc_id, text FROM documents UNION ALL SELECT FALSE, NULL, text FROM benchmark),
words AS (SELECT corpus, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feats AS MATERIALIZED (SELECT corpus, doc_id, UNNEST(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
hexes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feats)),
bucketed AS MATERIALIZED (SELECT f, {merkle.sql_crc32("list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))", "tab")} % {BUCKETS} AS b FROM hexes, crc),
counts AS (SELECT b, COUNT(*) FILTER (corpus) AS s, COUNT(*) FILTER (NOT corpus) AS t FROM feats JOIN bucketed USING (f) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((t + 1) * ((SELECT SUM(s) FROM counts) + {BUCKETS}) / ((s + 1) * ((SELECT SUM(t) FROM counts) + {BUCKETS})))) AS BIGINT) AS g FROM counts),
weights AS (SELECT doc_id, COUNT(*) AS n, floor(SUM(g) / COUNT(*)) AS weight FROM feats JOIN bucketed USING (f) JOIN gain USING (b) WHERE corpus GROUP BY doc_id),
scored AS (SELECT d.doc_id, COALESCE(n, 0) AS n_features, CAST(COALESCE(weight, 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM documents d LEFT JOIN weights USING (doc_id)),
final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score, n_features >= {2 * LEAST_WORDS - 1} AS able FROM scored),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS k, COUNT(*) OVER (PARTITION BY able) AS n FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= n * {PERCENT} // 100 THEN k END AS rank FROM ranked
"""
