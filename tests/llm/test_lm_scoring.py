import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from meshloom.llm import lm_scoring as lm


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    tok = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for _, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for t, h in zip(tok, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for t, h in zip(tok, held, strict=True)]


def test_base_scores_match_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "A", "é", "zz", f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(60)))) for i in range(150)] + [(None, "X y"), (7, None), (8, ""), (9, "\x00 nul \x85x")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    scores = []
    for most in (1 << 17, 20):  # all words and contexts sent to the tasks, or most joined
        monkeypatch.setattr(lm, "MOST_WORDS", most)
        monkeypatch.setattr(lm, "MOST_KEYS", most)
        scores.append(sorted((str(r.doc_id), round(r.score, 6)) for r in lm.score(docs).collect()))
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(docs).collect())
        assert got == sorted((i if i is not None else -1, *x[:4], round(x[4], 6)) for (i, _), x in zip(rows, brute(rows), strict=True))
    assert scores[0] == scores[1]


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert lm.score(spark.createDataFrame([(None, "held out only")], "doc_id long, text string")).first().base_score == 0


def _rows(texts):
    seen = Counter()
    for t in texts:
        data = b"\0" * lm.DEPTH + t + b"\0"
        for i in range(lm.DEPTH, len(data)):
            for d in range(lm.DEPTH + 1):
                seen[d, int.from_bytes(data[i - d : i], "big"), data[i]] += 1
    return [(*k, n) for k, n in seen.items()]


def test_tree_matches_recursive_weighting(spark):
    texts = [b"abracadabra", b"abra", b"cadabra abra"]
    rows = _rows(texts)
    counts = defaultdict(lambda: np.zeros(256))
    for d, c, b, n in rows:
        counts[d, c][b] += n
    kids = defaultdict(set)
    for d, c in counts:
        if d:
            kids[d - 1, c & ((1 << 8 * (d - 1)) - 1)].add((d, c))

    def split(c, node):  # zeros and ones at a binary node (level, prefix)
        level, prefix = node
        width = 256 >> level
        part = c[prefix * width : (prefix + 1) * width]
        return part[: width // 2].sum(), part[width // 2 :].sum()

    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(s, node):
        own = kt(*split(counts[s], node))
        if not kids[s]:
            return own
        rest = counts[s] - sum(counts[k] for k in kids[s])
        return math.log(0.5) + np.logaddexp(own, sum(weighted(k, node) for k in kids[s]) + kt(*split(rest, node)))

    def p_one(path, node):
        s, a = path[0], split(counts[path[0]], node)
        own = (a[1] + 0.5) / (sum(a) + 1)
        if not kids[s]:
            return own
        stop = math.exp(math.log(0.5) + kt(*a) - weighted(s, node))
        if len(path) > 1:
            deeper = p_one(path[1:], node)
        else:
            r = split(counts[s] - sum(counts[k] for k in kids[s]), node)
            deeper = (r[1] + 0.5) / (sum(r) + 1)
        return stop * own + (1 - stop) * deeper

    text = b"abrz"
    data, total = b"\0" * lm.DEPTH + text + b"\0", 0.0
    for i in range(lm.DEPTH, len(data)):
        path = [(0, 0)]
        for d in range(1, lm.DEPTH + 1):
            k = (d, int.from_bytes(data[i - d : i], "big"))
            if k not in counts:
                break
            path.append(k)
        for level in range(8):
            p = p_one(path, (level, data[i] >> (8 - level)))
            total += math.log10(p if data[i] >> (7 - level) & 1 else 1 - p)
    # the text is held out, so its own contexts have counts of 0
    ids = [i for i in range(40) if not lm.is_held_out(i)][: len(texts)] + [next(i for i in range(100) if lm.is_held_out(i))]
    docs = spark.createDataFrame(list(zip(ids, [t.decode() for t in [*texts, text]], strict=True)), "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    assert got[ids[-1]].held_out and abs(got[ids[-1]].score - total) < 1e-6
    # after one context, the probabilities of all bytes add up to 1
    grams = [(int.from_bytes(b"abra" + bytes([b]), "big"), 3 if b == 0 else 1 if b == 32 else 0) for b in range(256)]
    logs = lm.byte_logs(spark.createDataFrame(grams, "key long, n long")).collect()
    assert len(logs) == 256 and abs(sum(10**r.value for r in logs) - 1) < 1e-9


def test_held_out_text_is_predicted(spark):
    rng = random.Random(5)
    words = ["the", "cat", "sat", "on", "mats", "and", "dogs", "ran"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(120)] + [(1000 + i, "".join(chr(rng.randrange(33, 127)) for _ in range(250))) for i in range(4)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    bits = lambda r: -r.score / math.log10(2) / (len(dict(rows)[r.doc_id]) + 1)
    prose, noise = [bits(r) for r in got if r.doc_id < 1000 and r.held_out], [bits(r) for r in got if r.doc_id >= 1000]
    assert prose and max(prose) < 1.5 and min(noise) > 3
