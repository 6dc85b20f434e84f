import random

import numpy as np
from tests.llm.test_ngram_join import brute, corpus

from meshloom.llm import set_sketch as s


def hashes(rng, n):
    return rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)


def test_registers_merge_and_agree_with_the_similarity():
    rng = np.random.default_rng(1)
    a, b = hashes(rng, 700), hashes(rng, 300)
    assert (s.merged(s.registers(a), s.registers(b)) == s.registers(np.concatenate([a, b]))).all()
    assert (s.registers(np.zeros(0, np.int64)) == 0).all()
    for n, shared in ((9, 8), (90, 80), (900, 800), (500, 100)):
        same = []
        for _ in range(60):
            g = hashes(rng, 2 * n - shared)
            same.append((s.registers(g[:n]) == s.registers(g[n - shared :])).mean())
        assert abs(np.mean(same) - shared / (2 * n - shared)) < 0.01


def test_likelihood_estimates_the_similarity_jointly_with_sizes():
    rng = np.random.default_rng(2)
    for na, nb, shared in ((400, 400, 356), (400, 340, 330), (300, 900, 100)):
        got, wrong = [], 0
        for _ in range(60):
            g = hashes(rng, na + nb - shared)
            a, b = s.registers(g[:na]), s.registers(g[na - shared :])
            x = (np.array([float(na)]), np.array([float(nb)]), np.array([(a > b).sum()]), np.array([(a < b).sum()]))
            got.append(s.estimated(*x)[0])
            wrong += bool(s.likely(*x, 0.8)[0]) != (shared / (na + nb - shared) > 0.5)
        assert abs(np.mean(got) - shared / (na + nb - shared)) < 0.01 and not wrong


def test_bands_find_pairs_at_the_threshold():
    rng, missed = np.random.default_rng(3), 0
    for _ in range(400):
        g = hashes(rng, 50)
        missed += not (s.bands(s.registers(g[:45])) == s.bands(s.registers(g[5:]))).any()
    assert missed == 0


def test_matches_brute_force(spark):
    for seed, n in ((1, 2), (2, 5)):
        rows = corpus(seed) + [(2000, None), (2001, ""), (2002, "a"), (2003, "A"), (2004, "long " + "text of many words " * 30_000)]
        docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n int, row string")
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in s.near_duplicates(docs, n, 80).collect())
        assert got == [(*r, r[0] == r[2]) for r in brute(rows, n, 80)]


def test_a_group_whose_members_do_not_all_link(spark):
    rng, text = random.Random(4), [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):  # a chain: each copy differs from the last a little, from the first in all
        text[rng.randrange(120)] = f"n{k}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in s.near_duplicates(docs, 2, 80).collect())
    assert got == brute(rows, 2, 80)


def test_null_and_repeated_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "other words are here"), (None, None), (5, "x y z"), (5, "quite another text")]
    got = s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    want = [(1, 4, 1, True)] * 2 + [(None, 4, 1, False), (None, 3, None, True), (None, 0, None, True), (5, 2, 5, True), (5, 2, 5, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
