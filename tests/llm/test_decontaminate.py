import random

from hypothesis import given, settings
from hypothesis import strategies as st

from meshloom.llm import decontaminate as d


def slow(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.lists(st.sampled_from("abcd"), max_size=14))
def test_edit_search(item, text):
    distance, end = d.edit_search(item, text)
    assert distance == slow(item, text) and slow(item, text[:end]) == distance


def fixture():
    rng = random.Random(11)
    words = ["the", "of", "and", "in"] * 6 + [f"w{i}" for i in range(150)]
    line = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, line(rng.randrange(13, 60))) for i in range(30)]
    docs = []
    for i in range(160):
        body = line(rng.randrange(0, 200))
        if i % 2:
            part = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, int(len(part) * 0.12) + 1)):
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice(words)]])
            at = rng.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((i, (" " if i % 3 else ",\n").join(body).replace("w1", "W1" if i % 5 else "w1")))
    return items, docs


def test_matches_brute_force(spark):
    items, docs = fixture()
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, None), (78, " - ")], "item_id long, text string")
    rows = spark.createDataFrame([(*r, 1) for r in docs] + [(500, None, 1), (501, "", 1), (None, " ".join(items[0][1]), 1)], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id): r for r in d.find_leaks(rows, bench).collect()}
    want = {}
    for i, t in docs:
        for k, w in items:
            n = slow([x.encode() for x in w], d.tokens(t))
            if n <= int(len(w) * d.MAX_SHARE):
                want[i, k] = n
    assert (None, 0) in got
    found = {k: r for k, r in got.items() if k[0] is not None}
    assert set(found) == set(want)
    for (i, k), r in found.items():
        item = [x.encode() for x in items[k][1]]
        assert slow(item, d.tokens(docs[i][1])[r.first_word : r.end_word]) == r.distance
    kept = {r.doc_id for r in d.without_leaks(rows, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in found} | {500, 501}


def test_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.find_leaks(some, items).count() == 0 and d.without_leaks(some, items).count() == 1
    assert d.find_leaks(none, some.withColumnRenamed("doc_id", "item_id")).count() == 0


def edited(rng, item, n, words):
    """``item`` with ``n`` words replaced, dropped or put in."""
    out = list(item)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice(words)]])
    return out


def test_planted_leaks_at_the_full_share():
    words = [b"w%d" % i for i in range(90)]
    for shortest in (1, 4, 5, 10, 16):
        rng = random.Random(shortest)
        items = [(i, [rng.choice(words) for _ in range(shortest + i % 8 * (i % 4))]) for i in range(24)]
        texts = [[]]
        for _, item in items * 3:
            part = edited(rng, item, int(len(item) * d.MAX_SHARE), words)
            texts.append([rng.choice(words) for _ in range(rng.randrange(30))] + part + [rng.choice(words) for _ in range(rng.randrange(30))])
        want = {(t, k): n for t, text in enumerate(texts) for k, item in items if (n := slow(item, text)) <= int(len(item) * d.MAX_SHARE)}
        got = d.Index(items).leaks(texts)
        assert {r[:2]: r[4] for r in got} == want and len(got) == len(want)
        for t, k, a, b, n in got:
            assert slow(items[k][1], texts[t][a:b]) == n
            # no stretch as near ends before
            assert slow(items[k][1], texts[t][: b - 1]) > n
