import re
from collections import Counter

import corpus_pipeline as c
from meshloom.llm import decontaminate as d
from meshloom.llm import secret_scan as s
from tests.llm.test_decontaminate import slow
from tests.llm.test_ngram_join import brute as brute_components
from tests.llm.test_quality_rules import brute as brute_quality

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    assert [n for n, _ in c.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "mix_sources"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, d.tokens(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = []
    for name, stage in c.STAGES:
        docs = c.common.written(stage(spark, docs, SF))
        kept.append({r.doc_id: r for r in docs.collect()})
        if name != "mix_sources":
            assert docs.columns == columns
    clean = set()
    for i, r in rows.items():
        n, chars, symbols, dup, repeat = brute_quality(r.text)
        lines = [x for x in r.text.split("\n") if x.strip(" \t\n\v\f\r")]
        capitals = len(re.findall("[A-Z]", r.text))
        if not (n < 20 or 100 * repeat > 30 * n or 100 * symbols > 10 * n or 100 * dup > 30 * len(lines) or 100 * capitals > 50 * chars or 10 * chars < 20 * n or chars > 15 * n):
            clean.add(i)
    assert set(kept[0]) == clean
    classes = brute_components([(i, rows[i].text) for i in sorted(clean)], 5, 80)
    assert set(kept[1]) == {least for _, _, least in classes}
    leaked = {i for i in kept[1] for _, w in items if slow(w, d.tokens(rows[i].text)) <= int(len(w) * d.MAX_SHARE)}
    assert set(kept[2]) <= set(kept[1]) and not set(kept[2]) & leaked and set(kept[2]) | leaked == set(kept[1])
    assert set(kept[3]) == set(kept[2])
    for i, r in kept[3].items():
        spans = s.find(rows[i].text)
        assert (r.text == rows[i].text) == (not spans)
        assert r.n_chars == len(r.text) or not spans
        assert not s.find(r.text) and r.text.count("[secret]") <= len(spans)
    taken = Counter(r.doc_id for r in docs.collect())
    assert set(taken) <= set(kept[3]) and max(taken.values()) <= 3
    assert all(r.text == kept[3][r.doc_id].text for r in docs.collect())


def _folder(spark, tmp_path, docs, items):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, row string, blob string, g long"


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    prose = "The {0} of the old town was read by all who came that day, and {0} was then sold to a man with no name. " * 3
    texts = {k: " ".join(f"{w}{k}" if j % 4 == 0 else w for j, w in enumerate(prose.format(f"book{k}").split())) for k in range(12)}
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, len(t)) for k, t in texts.items()]
    rows += [(None, texts[3] + " extra", None, None, None), (5, texts[5], "en", "s2", len(texts[5])), (5, texts[5], "en", "s2", len(texts[5])), (20, None, None, None, None), (None, None, None, None, None), (21, "", "en", "s1", 0)]
    rows += [(30, texts[1].replace("sold", "sold token = abcdefgh12"), "en", "s1", 1), (None, " ".join(f"other{j} words" for j in range(40)), "de", None, None)]
    docs = spark.createDataFrame([(*r, 7, "x", "y", 9) for r in rows], SCHEMA)
    path = _folder(spark, tmp_path, docs, [(1, texts[7][:200]), (2, None), (3, "")])
    now = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        now = c.common.written(stage(spark, now, path))
        assert now.columns == docs.columns, name
    kept = Counter(r.doc_id for r in now.collect())
    assert 20 not in kept and 21 not in kept and 7 not in kept and kept[5] == 1 and kept[3] == 1 and kept[None] == 1
    taken = c.run(spark, path).collect()
    assert {r.doc_id for r in taken} <= set(kept) and not any(r.text and "abcdefgh12" in r.text for r in taken)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    path = _folder(spark, tmp_path, docs, [])
    assert c.run(spark, path).count() == 0
