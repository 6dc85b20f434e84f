import hashlib
import zlib

from meshloom.llm import merkle as m


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    out = []
    for k, v in enumerate((row[0], row[3], row[2], None if row[4] is None else row[4] + add, row[1])):
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*out)


def climb(nodes):
    """The top of a list of nodes, and the path of each: (siblings in order, functions of the fold)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            other = p ^ 1
            paths[k].append((p % 2, nodes[other] if other < len(nodes) else ""))
            at[k] = p // 2
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault("" if r[2] is None else "=" + r[2], []).append(r)
    names = sorted(groups, key=str.encode)
    done = []
    for g in names:
        mine = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        done.append((mine, *climb([leaf(r) for r in mine])))
    root, above = climb([d[1] for d in done])
    out = []
    for (mine, sub, paths), more in zip(done, above, strict=True):
        for r, path in zip(mine, paths, strict=True):
            dealt = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            top = leaf(r, int(dealt))
            for right, s in [*path, *more]:
                top = h(s, top) if right else h(top, s)
            out.append((r[0], leaf(r), sub, root, h(*(s for _, s in [*path, *more])), top, top == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g int, w string, h long"


def got(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in m.manifest(docs).collect()), key=str)


def test_matches_brute_force(spark):
    rows = [(i * 37 - 900, f"text {i} é", "en", "a", i) for i in range(300)]  # five levels and more, last runs of one
    rows += [(i * 10**15, "t" * (i % 5), "de", None, None if i % 3 else i) for i in range(-70, 70)]
    rows += [(5, None, None, "s", 3), (2**63 - 1, "", "fr", "s", 0), (-(2**63), "last", "fr", "s", 4)]
    assert got(spark, rows) == brute(rows)


def test_repeats_nulls_and_empty(spark):
    rows = [(7, f"same id {i}", "en", "a", i) for i in range(90)] + [(None, f"no id {i}", "en", "a", i) for i in range(70)]
    rows += [(8, "x", "en", "a", 1), (71, "y", "en", "a", 1), (8, "z", "é", None, None), (1, "x" * 200_000, "", "", 200_000)]
    assert got(spark, rows) == brute(rows)
    twice = [(3, "a", "en", "s", 1)] * 5 + [(4, "a", "en", "s", 1)]
    assert got(spark, twice) == brute(twice)
    assert got(spark, []) == []
    alone = [(1, "one", "en", "s", 3)]
    assert got(spark, alone) == brute(alone) and got(spark, alone)[0][4] == h()
