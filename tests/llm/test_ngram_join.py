import random
import re

from meshloom.llm import ngram_join as j
from meshloom.llm.components import connected_components


def brute(rows, n, num, den=100):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, size=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["THE", "the", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 8, 14, 20, 60, 200]))) for _ in range(size // 3)]
    passage = " ".join(rng.choice(words) for _ in range(80))
    while len(texts) < size:
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(3)):
            if w:
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice(words)]])
        texts.append(" ".join(w) if rng.random() < 0.8 else passage + " " + " ".join(w[:6]))
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


def test_matches_brute_force(spark):
    for seed, n, num in ((1, 4, 85), (2, 5, 80)):
        rows = corpus(seed) + [(2000, None), (2001, ""), (2002, "a"), (2003, "A")]
        docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in j.join(docs, n, num).collect())
        assert got == brute(rows, n, num)


def test_null_and_repeated_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "other words are here now then"), (5, "x y z"), (5, "completely different text of some words")]
    got = j.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(1, 4, 1), (1, 4, 1), (None, 4, 1), (None, 3, None), (5, 1, 5), (5, 3, 5)], key=str)
    assert j.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boundary_follows_cost():
    assert j.boundary({20: 10}, 85, 100) < 20 or j.boundary({20: 10}, 85, 100) == j.SMALL
    assert j.boundary({6: 1000, 7: 1000}, 85, 100) >= 7
    for s in range(1, 40):
        for t in range(1, 40):
            c = j.needed(s, t, 85, 100)
            assert 100 * c >= 85 * (s + t - c) and 100 * (c - 1) < 85 * (s + t - c + 1)


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (7, 7), (900, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500, 900: 500}


def test_representatives_keep_one_row_of_each_component(spark):
    a, near = "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s t u"
    unique = "quite another text of so many words that no one else has"
    rows = [(1, a, "x"), (5, a, "x"), (5, unique, "x"), (5, unique, "y"), (None, a, "x"), (7, near, "x"), (None, "no id here but words", "x"), (9, None, "x"), (9, None, "x"), (10, "", "x"), (1, a, "x"), (3, "A B", "x"), (3, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, i string")
    got = sorted(((r.doc_id, (r.text or "").lower(), r.text is None) for r in j.representatives(docs).collect()), key=repr)
    assert got == sorted([(1, a, False), (5, unique, False), (None, "no id here but words", False), (9, "", True), (9, "", True), (10, "", False), (3, "a b", False)], key=repr)
    assert j.representatives(docs).columns == docs.columns and j.representatives(docs.filter("false")).count() == 0


def test_open_pairs_are_all_pairs_that_can_reach(spark, monkeypatch):
    monkeypatch.setattr(j, "PART", 3)
    rng = random.Random(2)
    lists = [(g, r, 20 + r * 3, rng.randrange(4), r if rng.random() < 0.5 else 1) for g in range(4) for r in range(40) if rng.random() < 0.8]
    comp = {r: c for _, r, _, _, c in lists}
    lists = [(g, r, n, p, comp[r]) for g, r, n, p, _ in lists]
    got = {(r.a, r.b) for r in j.open_pairs(spark.createDataFrame(lists, "gram long, row long, n long, pos int, component long"), 80, 100).collect()}
    met = {}
    for g, r, n, p, c in lists:
        for h, r2, n2, p2, c2 in lists:
            if g == h and r < r2 and c != c2 and 180 * (n - p) >= 80 * (n + n2) and 180 * (n2 - p2) >= 80 * (n + n2):
                x = met.setdefault((r, r2), [0, 0, 0, n, n2])
                x[0], x[1], x[2] = x[0] + 1, max(x[1], p), max(x[2], p2)
    assert got == {k for k, (c, p, p2, n, n2) in met.items() if 180 * (c + min(n - 1 - p, n2 - 1 - p2)) >= 80 * (n + n2)}
