import re
from collections import Counter

from meshloom.llm import quality_rules as q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measurements_match_brute_force(spark):
    base = " ".join(f"w{i}é" for i in range(12))
    texts = [None, "", " \t\n\x0b\f\r", "a\x85b c d", base, base + " " + base, "x " * 40, "\n".join(["l m"] * 5 + ["", " ", "n"]), "#*$%&|<> 😀 " * 3, base * 3000, " ".join(["a b c d e f g h i"] * 4)]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(None, "a b", "x"), (0, "dup id", "x")]
    got = q.ledger(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id and r.doc_id > 0}
    for i, t in enumerate(texts):
        if i:
            r = by[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), i


def test_empty_table(spark):
    assert q.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_policies_and_ablation(spark):
    rows = [(i, b) for i, b in enumerate([0, 0, 1, 2, 3, 4, 5, 64])]
    df = spark.createDataFrame(rows, "doc_id long, fail_bits long")
    policy = q.Policy("t", 0b111)
    assert sorted(r.doc_id for r in df.filter(q.passes(policy)).collect()) == [0, 1, 7]
    got = {r.rule: r for r in q.ablation(df, policy).collect()}
    for i in range(3):
        name, bits = q.RULES[i][0], [b for _, b in rows]
        failed = [b for b in bits if b >> i & 1]
        assert got[name].n_failed == len(failed)
        assert got[name].n_only_this == sum(b & 7 == 1 << i for b in failed)
        assert got[name].n_kept_without == sum(b & 7 & ~(1 << i) == 0 for b in bits)
