"""Benchmark decontamination by unedited pieces and exact edit distance.

Texts and items are words (runs of ASCII letters and digits and of other characters, A-Z lowered). A leak is a
stretch of a text within ``MAX_SHARE`` of an item's words in edit distance over words.

Search: an item that allows k edits is cut end to end into k + 1 pieces of about equal length, so k edits leave one
of them unedited, and each leak holds a piece word by word (items of up to four words are their own only
piece). Every window of a text is looked up by the hash of its words, one word after the other, and dropped at the
first word with which no piece goes on. A window that equals a piece gives the stretch where its item would lie, with
room for k edits on both sides, and each such stretch is verified by bit-parallel edit distance. No leak is missed.

Defined results: a null or empty text or item has no words and no leaks; repeated rows and ids give their own rows;
empty tables give no rows; other columns are ignored or, in ``without_leaks``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import common
from meshloom.llm.license_scan import tokens

#: A window is a leak up to this share of the item's words in edits.
MAX_SHARE = 0.2
#: Items that are searched for in one pass over the texts, and so the bound of what is sent to the tasks.
ITEMS_AT_ONCE = 20_000
CHUNK = 4 << 20
#: Pairs of a window and a piece that are held at once.
PAIRS_AT_ONCE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array([*words, b""], dtype=object), categorize=False)[:-1]


def edit_search(item: list, text: list) -> tuple[int, int]:
    """(least edit distance of ``item`` to a stretch of ``text``, where the first such stretch ends), by Myers' bit vectors."""
    m = len(item)
    masks: dict = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """Pieces of items [(item_id, words)], one more for each item than the edits it allows, by the hash of their words."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.items = [(i, w) for i, w in items if w]
        self.words = [frozenset(w) for _, w in self.items]
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.allowed = np.array([int(len(w) * MAX_SHARE) for _, w in self.items], np.int64)
        owner, offset, length = [], [], []
        for k, (_, w) in enumerate(self.items):
            n = int(self.allowed[k]) + 1
            cuts = [len(w) * i // n for i in range(n + 1)]
            owner += [k] * n
            offset += cuts[:-1]
            length += [b - a for a, b in zip(cuts, cuts[1:])]
        self.owner, self.offset, length = (np.array(x, np.int64) for x in (owner, offset, length))
        self.shift = np.uint64(64 - min(max(20, (8 * len(length)).bit_length()), 26))
        h = _hashes([w for _, ws in self.items for w in ws])
        at = np.concatenate([[0], np.cumsum(self.sizes)])[self.owner] + self.offset if len(length) else length
        #: by the number of words: which keys begin a piece of so many or more, and the keys and numbers of pieces of just so many
        self.begins: list[np.ndarray] = []
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []
        key, left = np.zeros(len(length), np.uint64), np.arange(len(length))
        for n in range(int(length.max(initial=0))):
            left = left[length[left] > n]
            key[left] = _mix(key[left] + h[at[left] + n])
            t = np.zeros(1 << (64 - int(self.shift)), bool)
            t[(key[left] >> self.shift).astype(np.int64)] = True
            self.begins.append(t)
            ends = left[length[left] == n + 1]
            ends = ends[np.argsort(key[ends], kind="stable")]
            self.keys.append((key[ends], ends))

    def _pairs(self, h: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start of window, piece) of equal hashes; ``room``: words from here to the end of the text."""
        start, key = np.arange(len(h)), np.zeros(len(h), np.uint64)
        for n, (begins, (keys, pieces)) in enumerate(zip(self.begins, self.keys, strict=True)):
            fits = np.flatnonzero(room[start] > n)
            start, key = start[fits], key[fits]
            key = _mix(key + h[start + n])
            goes_on = np.flatnonzero(begins[(key >> self.shift).astype(np.int64)])
            start, key = start[goes_on], key[goes_on]
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(hi > lo)
            ends, a = np.cumsum(hi[hit] - lo[hit]), 0
            while a < len(hit):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
                part = hit[a:b]
                m = hi[part] - lo[part]
                yield np.repeat(start[part], m), pieces[np.repeat(lo[part] - np.cumsum(m) + m, m) + np.arange(m.sum())]
                a = b

    def leaks(self, texts: list[list[bytes]]) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, first word, end word, distance): of each item in each text the nearest stretch, of these the one that ends first, of these the shortest."""
        if not self.items:
            return []
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        first = ends - sizes
        best: dict[tuple[int, int], tuple[int, int, int]] = {}

        def verify(t: int, k: int, a: int, b: int) -> None:
            item, window = self.items[k][1], texts[t][a:b]
            distance, end = edit_search(item, window)
            if distance <= self.allowed[k] and (distance, a + end) < best.get((t, k), (len(item), 0))[:2]:
                best[t, k] = (distance, a + end, a + end - edit_search(item[::-1], window[:end][::-1])[1])

        for start, piece in self._pairs(_hashes([w for t in texts for w in t]), np.repeat(ends, sizes) - np.arange(sizes.sum())):
            t, k = np.searchsorted(first, start, "right") - 1, self.owner[piece]
            at = start - first[t] - self.offset[piece]
            order = np.lexsort((at, k, t))
            t, k, at = t[order], k[order], at[order]
            # the same place but once, and of an item without edits the first place alone
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | ((at[1:] != at[:-1]) & (self.allowed[k[1:]] > 0))
            t, k, at = t[new], k[new], at[new]
            spare = self.allowed[k]
            a, b = np.maximum(0, at - spare), np.minimum(sizes[t], at + self.sizes[k] + 2 * spare)
            last = None
            for t_, k_, a_, b_, need in zip(*(x.tolist() for x in (t, k, a, b, self.sizes[k] - spare)), strict=True):
                # every item word that is not edited stands in the window
                if sum(map(self.words[k_].__contains__, texts[t_][a_:b_])) < need:
                    continue
                if last and last[:2] == (t_, k_) and a_ <= last[3]:
                    last = (t_, k_, last[2], max(b_, last[3]))
                    continue
                if last:
                    verify(*last)
                last = (t_, k_, a_, b_)
            if last:
                verify(*last)
        return [(t, self.items[k][0], a, b, d) for (t, k), (d, b, a) in sorted(best.items())]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for whole in batches:
        column, start, texts, size = whole.column("text"), 0, [], 0
        for i in range(whole.num_rows):
            text = column[i].as_py()
            texts.append(tokens(text))
            size += len(text or "") + 400
            if size >= CHUNK or i + 1 == whole.num_rows:
                yield whole.slice(start, i + 1 - start), texts
                start, texts, size = i + 1, [], 0


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items in blocks of about ITEMS_AT_ONCE, in order of id."""
    blocks = max(1, -(-items.count() // ITEMS_AT_ONCE))
    for b in range(blocks):
        rows = items.select("item_id", "text").filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        yield sorted(((r.item_id, tokens(r.text)) for r in rows), key=repr)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, end_word, distance: each item that each text holds, at its best stretch."""
    d, i = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {d}, item_id {i}, first_word long, end_word long, distance long"

    def finder(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in _chunks(batches):
                rows = index.value.leaks(texts)
                ids = batch.column("doc_id")
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "item_id", "first_word", "end_word", "distance"])

        return run

    out = None
    for block in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        index = docs.sparkSession.sparkContext.broadcast(Index(block))
        part = docs.select("doc_id", "text").mapInArrow(finder(index), schema.replace(f"item_id {i}", "item_id long"))
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged; texts stay in their tasks."""

    def keeper(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in _chunks(batches):
                bad = {r[0] for r in index.value.leaks(texts)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch

        return run

    for block in _blocks(items):
        docs = docs.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(Index(block))), docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
