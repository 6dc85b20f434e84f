import hashlib
import re

from meshloom.llm import common, warc


def test_round_trip_with_magic_inside_payloads(spark):
    inner = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    long = "é" * 60
    texts = [None, "", long, long, "x", "x", "a" + inner, inner, inner * 3 + warc.MAGIC, "tail " + warc.MAGIC + "Content-Length: 99999999999999999999999\r\n\r\n", "\r\n\r\n" * 3, "<p>" * 200_000, warc.MAGIC, long]
    rows = [(i, f"http://h/{i}\r\nX: y", t, "z") for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, type string")
    for parts in (1, 5):
        path = common.shared_dir(spark)
        warc.write(pages.repartition(parts), path)
        got = {r.page_id: r for r in warc.digests(warc.read(spark, path)).collect()}
        assert sorted(got) == list(range(len(texts)))
        first = {}
        for i, t in enumerate(texts):
            data = (t or "").encode()
            kind, to = "response", None
            if len(data) >= 100:
                to = first.setdefault(data, i)
                kind, to = ("response", None) if to == i else ("revisit", to)
            r = got[i]
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), kind, to), i


def test_splits_inside_records(spark):
    rows = [(i, "u", f"{i} " * 3000 + warc.MAGIC * (i % 3)) for i in range(60)]
    path = common.shared_dir(spark)
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        got = {r.page_id: r for r in warc.digests(warc.read(spark, path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 60 and all(got[i].payload_digest == hashlib.sha256(t.encode()).hexdigest() for i, _, t in rows)


def test_pointer_jumping(spark):
    # a chain that false candidates cut into many runs
    true, at, rows = [], 0, []
    for i in range(40):
        n = 100 + i
        rows.append(("f", at, at + n))
        true.append(at)
        rows.append(("f", at + 50, [at + n, at + 60, None, at + n + 100 + i + 1][i % 4]))
        at += n
    found = spark.createDataFrame([(f, at // 700, at, n) for f, at, n in rows], "file string, block long, at long, next long")
    assert sorted(r.at for r in warc.reachable(found).collect()) == true


def test_empty(spark):
    path = common.shared_dir(spark)
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.digests(warc.read(spark, path)).count() == 0


def test_long_url_in_mid_file(spark):
    again = "payload of two pages " * 9
    urls = ["http://h/0", "data:text/html," + "é%20" * 30_000, "http://h/2", "http://h/3?" + "x" * 8_100, "http://h/4"]
    texts = [again, "a " * 99, again, again, "last"]
    path = common.shared_dir(spark)
    warc.write(spark.createDataFrame(list(zip(range(5), urls, texts, strict=True)), "page_id long, url string, html string").coalesce(1), path)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_digest) for r in warc.digests(warc.read(spark, path)).collect()}
    kinds = [("response", None), ("response", None), ("revisit", 0), ("revisit", 0), ("response", None)]
    assert got == {i: (*kinds[i], hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)}


def test_repeated_and_null_ids(spark):
    a, b, c = "A" * 200, "B" * 200, "short"
    rows = [(1, a), (5, a), (5, b), (7, b), (None, a), (None, b), (None, a), (1, a), (7, c), (7, None)]
    path = common.shared_dir(spark)
    warc.write(spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string"), path)
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    assert text.count("WARC-Date: 2") == len(rows) and text.count("WARC-Record-ID: <urn:page::") == 3
    ids = set(re.findall("WARC-Record-ID: (<.*?>)", text))
    assert set(re.findall("WARC-Refers-To: (<.*?>)", text)) <= ids and len(ids) == 8
    got = sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.digests(warc.read(spark, path)).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = {(5, a): ("revisit", 1), (7, b): ("revisit", 5)}
    assert got == sorted(((i, sha(t), *want.get((i, t), ("response", None))) for i, t in rows), key=repr)


def test_readings_under_other_parallelism(spark, monkeypatch):
    fake = warc.MAGIC + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc" + warc.END  # a whole record within a payload
    rows = [(i, "u", f"page {i} " + ("x" + warc.MAGIC + "y" + warc.END + fake if i % 3 == 0 else "") + "text " * 40) for i in range(400)]
    path = common.shared_dir(spark)
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    plain, seen = warc.chunks, []
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")}

    def chunks(session, at):
        for k, v in {"spark.sql.files.minPartitionNum": str(40 if seen else 1), "spark.sql.files.openCostInBytes": "1"}.items():
            session.conf.set(k, v)
        seen.append(at)
        return plain(session, at)

    monkeypatch.setattr(warc, "chunks", chunks)
    try:
        got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.digests(warc.read(spark, path)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(seen) == 2
    assert got == {i: (len(t), hashlib.sha256(t.encode()).hexdigest()) for i, _, t in rows}
