import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from meshloom.llm import resample as r


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, target, percent=25, least=20, buckets=10000):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        w, f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    able = sorted((x for x in rows if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = len(able) * percent // 100
    return sorted([(*x[:4], k + 1 if k < drawn else None) for k, x in enumerate(able)] + [(*x[:4], None) for x in rows if not x[4]], key=str)


def got(spark, docs, target, **more):
    a = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, weight int, bucket string").repartition(3)
    b = spark.createDataFrame([(t, 5) for t in target], "text string, doc_id int")
    return sorted((tuple(x) for x in r.resample(a, b, **more).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(50)] + ["THE", "été", "Été", "a1", "x" * 31, "y" * 32, "z" * 700, " ", "日本語"]
    return [(k * 7 % 1009, "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 60, 300])))) for k in range(n)]


def test_matches_brute_force(spark):
    docs, target = corpus(1, 240) + [(2000, None), (2001, ""), (2002, "..."), (2003, "a" * 40)], [t for _, t in corpus(2, 30)] + [None]
    assert got(spark, docs, target) == brute(docs, target)
    assert got(spark, docs, target, percent=60, least=2, buckets=7) == brute(docs, target, 60, 2, 7)


def test_nulls_repeats_and_empty(spark):
    docs = corpus(3, 60)
    docs = docs + docs[:20]  # repeated rows tie in all
    assert got(spark, docs, ["w1 w2"]) == brute(docs, ["w1 w2"])
    nulls = [(None, "w1 w2 " * 15), (4, "w1 w2 " * 15), (None, None)]
    assert got(spark, nulls, [], percent=50) == brute(nulls, [], 50)
    assert got(spark, [], ["w1"]) == []


def test_a_long_text_is_cut_into_tables_without_loss(monkeypatch):
    text = (" ".join(t for _, t in corpus(5, 200)) + "\n").encode()
    whole = np.zeros(100, np.int64)
    monkeypatch.setattr(r, "RUN", 1 << 30)
    for table, _ in r.tables(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 100):
        whole += np.bincount(table.bucket[table.slot_of], minlength=100)
    parts = np.zeros(100, np.int64)
    monkeypatch.setattr(r, "RUN", 97)
    for table, _ in r.tables(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 100):
        parts += np.bincount(table.bucket[table.used], table.count[table.used], 100).astype(np.int64)
    assert (whole == parts).all() and whole.sum() == len(features(text.decode())[1])


@pytest.mark.parametrize("same_hash", [False, True])
def test_slots_hold_one_feature_each(monkeypatch, same_hash):
    rng = random.Random(6)
    data = bytes(rng.choice(b"abc ") for _ in range(3000))
    starts, sizes = np.array([rng.randrange(2900) for _ in range(900)]), np.array([rng.choice([1, 2, 3, 4, 7, 8, 9, 15, 16, 31, 32, 33, 60]) for _ in range(900)])
    spans = r.Spans(np.frombuffer(data, np.uint8), starts, sizes)
    keys = spans.hashes()
    assert [int(k) for k in keys] == [xxhash.xxh64_intdigest(data[a : a + s]) for a, s in zip(starts, sizes, strict=True)]
    if same_hash:  # bytes tell features apart that share a hash
        monkeypatch.setattr(r.Spans, "hashes", lambda self: np.full(len(self.starts), 5, np.uint64))
    table = r.Table(spans, 1000)
    names = {}
    for slot, a, s in zip(table.slot_of.tolist(), starts, sizes, strict=True):
        assert names.setdefault(slot, data[a : a + s]) == data[a : a + s]
    assert len(set(names.values())) == len(names) == len(table.used)
    assert all(table.bucket[slot] == zlib.crc32(f) % 1000 for slot, f in names.items()) and table.count.sum() == 900
