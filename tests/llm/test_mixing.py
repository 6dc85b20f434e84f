import math

from meshloom.llm import mixing as m


def test_hypergeometric_quantiles(spark):
    cases = [(20, 7, 9), (5, 5, 2), (10, 0, 4), (1000, 300, 500), (1, 1, 0)]
    rows = [(n, k, d, (j + 0.5) / 400) for n, k, d in cases for j in range(400)]
    df = spark.createDataFrame([(j, *r) for j, r in enumerate(rows)], "id long, n long, k long, m long, u double")
    got = m.hypergeometric(df, "id").withColumnRenamed("m", "d").groupBy("n", "k", "d", "x").count().collect()
    for n, k, d in cases:
        share = {r.x: r["count"] / 400 for r in got if (r.n, r.k, r.d) == (n, k, d)}
        for x in range(max(0, d + k - n), min(k, d) + 1):
            p = math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d)
            assert abs(share.get(x, 0) - p) < 0.006, (n, k, d, x)
        assert set(share) <= set(range(max(0, d + k - n), min(k, d) + 1))


def test_tree_parts_add_up(spark):
    q = [50, 120, 7, 0, 300]
    quotas = spark.createDataFrame(list(enumerate(q)), "place long, quota long")
    parts = m.split_tree(quotas, 4, len(q)).collect()
    assert {r.shard for r in parts} == {0, 1, 2, 3}
    assert [sum(r.quota for r in parts if r.place == i) for i in range(len(q))] == q
    sizes = [sum(r.quota for r in parts if r.shard == i) for i in range(4)]
    assert max(sizes) - min(sizes) <= 2
    # one that has more rounds than the sources need, and other seeds
    assert sorted(m.split_tree(quotas, 4, 30).collect()) == sorted(parts)
    assert sorted(m.split_tree(quotas, 4, len(q), "b").collect()) != sorted(parts)


def test_mix(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(1 + i % 30), ["a", "b", "Z", None][i % 7 % 4], "x") for i in range(400)] + [(5, words(6), "b", "x"), (None, None, "a", "x"), (401, "", "empty", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = m.mix(docs, 4).collect()
    taken, size = {}, {}
    for r in rows:
        size[r[2]] = size.get(r[2], 0) + len((r[1] or "").split())
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    total, weight = sum(size.values()), {"Z": 1, "a": 2, "b": 3, "empty": 1, None: 2}
    level, open_ = total, set(size)
    target = {}
    while True:
        unit = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] >= 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            open_.discard(s)
    target |= {s: unit * weight[s] for s in open_}
    for s in size:
        assert abs(taken.get(s, 0) - target[s]) <= 60, s
    assert sorted((r.mix_shard, r.mix_order) for r in m.mix(docs, 4).collect()) == sorted((r.mix_shard, r.mix_order) for r in got)


def test_empty(spark):
    assert m.mix(spark.createDataFrame([], "doc_id long, text string, source string"), 2).count() == 0
