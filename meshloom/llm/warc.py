"""WARC archives written and read by Spark, with boundary-chain verification.

Writing: a record is one string, and the text writer's line separator is the blank lines that end it, so
the part files are plain WARC. Reading: the text reader splits the files at the version line ``WARC/1.0``
wherever it stands, so each task emits candidates for record starts, with the offset where each candidate's
own header says its successor begins. Only candidates on the chain from offset 0 are records: neighbours in a split of
the file that follow each other exactly are contracted to runs, and pointer jumping over the runs (each round doubles
the distance) marks those reachable from the file's start. A version line inside a payload is on no chain. Offsets are
sums within each split and sums over the splits of a file, so no task holds more rows than a split has.

A record's id holds its page_id and its payload's digest, and a revisit refers to the id of the response of equal payload.

Defined results: a null html is an empty payload; rows that repeat a response's page_id and payload are
responses too and share its record id; a page_id that stands for several payloads has a record for each; a null page_id
never refers to or serves others; a header may have any length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.llm import common

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Payloads shorter than this are always stored.
LEAST_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha(html):
    return F.sha2(F.coalesce(html, F.lit("")), 256)


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, sha, refers_to) of the pages that repeat the payload of a page of smaller id; payloads never leave their task."""
    keys = common.written(pages.filter("page_id IS NOT NULL").filter(F.octet_length("html") >= LEAST_BYTES).select("page_id", _sha(F.col("html")).alias("sha")))
    first = keys.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most")).filter("most > refers_to").drop("most")
    again = common.written(keys.join(first, "sha").filter("page_id > refers_to").select("page_id", "sha", "refers_to").distinct())
    common.dropped(keys)
    return again


def write(pages: DataFrame, path: str) -> None:
    """Writes a response or revisit record for each of ``pages`` (page_id, url, html); its date is that of the writing."""
    again = revisits(pages)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _sha(F.col("html")).alias("sha")).join(common.if_small(again), ["page_id", "sha"], "left")
    stored = F.col("refers_to").isNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.col("sha"), F.lit(">"))
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    record = F.concat(
        F.lit(MAGIC), F.when(stored, F.lit("WARC-Type: response\r\n")).otherwise(F.lit(f"WARC-Type: revisit\r\nWARC-Profile: {PROFILE}\r\n")),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", date), F.when(stored, F.lit("")).otherwise(line("WARC-Refers-To", urn(F.col("refers_to")))),
        line("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha"))),
        F.lit("Content-Type: text/html\r\n"), line("Content-Length", F.when(stored, F.octet_length("html")).otherwise(0).cast("string")),
        F.lit("\r\n"), F.when(stored, F.col("html")).otherwise(F.lit("")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)
    common.dropped(again)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """What follows each version line, in file order: file, block, row, size, the bytes (binary) and those before the first blank line."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
        F.octet_length("value").cast("long").alias("size"), F.col("value").cast("binary").alias("data"), F.substring_index("value", END, 1).cast("binary").alias("head"),
    )


def _placed(rows: DataFrame) -> DataFrame:
    """``at``: offset of the chunk's version line. A file's chunks are read in order of (block, row): sums in each split, after the sums of those before it."""
    size = F.col("size") + len(MAGIC)
    splits = rows.groupBy("file", "block").agg(F.sum(size).alias("_all"))
    # one row for each split of a file
    before = F.sum("_all").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = splits.select("file", "block", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.sum(size).over(W.partitionBy("file", "block").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.coalesce(inside, F.lit(0))).join(starts, ["file", "block"])
    return rows.withColumn("at", F.col("_start") + F.col("_before") - len(MAGIC)).drop("_start", "_before")


def _header(name: str):
    return F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each version line in the files: offset, successor by its own header, header fields, digest if whole."""
    rows = chunks(spark, path)
    rows = rows.withColumn("_n", F.octet_length("head").cast("long")).withColumn("_ends", F.col("_n") + len(END) <= F.col("size"))
    # a chunk without a blank line has no header
    rows = rows.withColumn("head", F.when(F.col("_ends"), F.decode("head", "ISO-8859-1")).otherwise(F.lit("")))
    length = F.try_to_number(F.substring(_header("Content-Length"), 1, 18), F.lit("9" * 18)).cast("long")
    rows = rows.withColumn("length", F.when(F.col("_ends"), length)).withColumn("skip", F.col("_n") + len(END))
    whole = F.col("size") == F.col("skip") + F.col("length") + len(END)
    body = F.expr("substring(data, CAST(skip AS INT) + 1, CAST(length AS INT))")
    rows = rows.select(
        "file", "block", "row", "size", "length", "skip", _header("WARC-Type").alias("type"), _header("WARC-Payload-Digest").alias("digest"),
        F.regexp_extract(_header("WARC-Record-ID"), "<urn:page:(-?[0-9]*)[:>]", 1).alias("page_id"), F.regexp_extract(_header("WARC-Refers-To"), "<urn:page:(-?[0-9]*)[:>]", 1).alias("refers_to"),
        F.when(whole, F.sha2(body, 256)).alias("sha"),
    )
    placed = _placed(common.written(rows)).filter("at >= 0")
    return placed.withColumn("next", F.col("at") + len(MAGIC) + F.col("skip") + F.col("length") + len(END))


def reachable(found: DataFrame) -> DataFrame:
    """The rows of ``found`` (file, block, at, next) on the chain from offset 0 of their file."""
    split = W.partitionBy("file", "block").orderBy("at")
    # neighbours that follow each other exactly form a run, named by its first offset; a run's rows are reachable if its head is
    head = F.when(F.lag("next").over(split) == F.col("at"), None).otherwise(F.col("at"))
    rows = found.withColumn("_head", head).withColumn("run", F.last("_head", True).over(split.rowsBetween(W.unboundedPreceding, 0)))
    rows = common.written(rows)
    runs = common.written(rows.groupBy("file", "run").agg(F.min("at").alias("at"), F.max_by("next", "at").alias("jump")))
    # a jump may also enter a run in its middle: rows from there on are reachable
    most = runs.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    entry = rows.select("file", F.col("run").alias("to_run"), F.col("at").alias("jump"))
    nodes = runs.join(entry, ["file", "jump"], "left").select("file", "run", "to_run", F.when(F.col("to_run").isNotNull(), F.col("jump")).alias("to_at"), F.when(F.col("at") == 0, F.lit(0).cast("long")).alias("reach"))
    nodes = common.written(nodes)
    common.dropped(runs)
    for _ in range(most.bit_length() if most > 1 else 0):  # each round doubles the runs that a jump passes
        # reach: the least offset of the run from which its rows are on the chain
        marks = nodes.filter("reach IS NOT NULL AND to_run IS NOT NULL").select("file", F.col("to_run").alias("run"), F.col("to_at").alias("_m"))
        marks = marks.groupBy("file", "run").agg(F.min("_m").alias("_m"))
        far = nodes.select("file", F.col("run").alias("to_run"), F.col("to_run").alias("_r"), F.col("to_at").alias("_a"))
        old = nodes
        nodes = nodes.join(marks, ["file", "run"], "left").join(far, ["file", "to_run"], "left")
        nodes = common.written(nodes.select("file", "run", F.col("_r").alias("to_run"), F.col("_a").alias("to_at"), F.least("reach", "_m").alias("reach")))
        common.dropped(old)
    return rows.join(nodes.filter("reach IS NOT NULL").select("file", "run", "reach"), ["file", "run"]).filter("at >= reach").drop("_head", "run", "reach")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: page_id, type, refers_to, length, the header's digest and the payload's own SHA-256. Nothing is read from ``path`` later."""
    found = common.written(candidates(spark, path))
    records = common.written(reachable(found))
    columns = ["page_id", "type", "refers_to", "length", "digest", "sha"]
    whole, broken = (records.filter(f"sha IS {'NOT ' * k}NULL") for k in (1, 0))
    if broken.limit(1).count() == 0:
        return whole.select(*columns)
    # payloads that hold version lines: the chunks of those records are put together again, found by their places alone
    starts = broken.select("file", "at", F.struct(F.col("at").alias("start"), "next", "skip", *columns[:-1]).alias("o"))
    pieces = found.select("file", "block", "row", "at").join(starts, ["file", "at"], "left")
    # the last start at or before a chunk: in its split, else of the splits before, of which there is one row each
    last = pieces.groupBy("file", "block").agg(F.max_by("o", F.when(F.col("o").isNotNull(), F.col("at"))).alias("_o"))
    last = last.select("file", "block", F.last("_o", True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    owner = F.last("o", True).over(W.partitionBy("file", "block").orderBy("at"))
    pieces = pieces.withColumn("o", owner).join(last, ["file", "block"]).withColumn("o", F.coalesce("o", "_before"))
    mine = pieces.filter((F.col("at") >= F.col("o.start")) & (F.col("at") < F.col("o.next"))).select("file", "at", "o")
    # the files are read again and may be split otherwise: this reading is stored, and its chunks get their offsets anew
    again = common.written(chunks(spark, path).join(common.if_small(broken.select("file").distinct()), "file", "left_semi"))
    keys = common.written(_placed(again.select("file", "block", "row", "size")).join(mine, ["file", "at"]).select("file", "block", "row", "at", "o"))
    parts = F.array_sort(F.collect_list(F.struct("at", "data")))
    joined = again.select("file", "block", "row", "data").join(common.if_small(keys), ["file", "block", "row"]).groupBy("file", "o").agg(parts.alias("p"))
    data = F.aggregate("p", F.lit("").cast("binary"), lambda acc, x: F.concat(acc, F.lit(MAGIC).cast("binary"), x.data))
    body = F.expr(f"substring(_data, CAST(o.skip AS INT) + {len(MAGIC)} + 1, CAST(o.length AS INT))")
    joined = common.written(joined.withColumn("_data", data).select("o.*", F.sha2(body, 256).alias("sha")).select(*columns))
    common.dropped(again, keys)
    if joined.count() != broken.count():
        raise RuntimeError("a second reading of the archives has not all records of the first")
    return whole.select(*columns).unionByName(joined)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark)
    write(common.table(spark, sf_dir, "pages"), path)
    records = read(spark, path)
    common.delete(spark, path)
    return digests(records)


def digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit has the payload of the record it refers to."""
    number = lambda c: F.expr(f"try_cast(nullif({c}, '') AS BIGINT)")
    said = F.regexp_replace("digest", "^sha256:", "")
    rows = records.select(number("page_id").alias("page_id"), "type", number("refers_to").alias("refers_to"), "length", "sha", said.alias("said"))
    base = rows.filter("type = 'response'").select("page_id", F.col("length").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = rows.filter("type = 'revisit'").select("page_id", "refers_to", F.col("said").alias("payload_digest"))
    # responses that others refer to, once each; a hot one is split by the join's skew handling
    asked = base.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to", "payload_digest"])
    seen = again.join(asked, ["refers_to", "payload_digest"]).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return base.unionByName(seen)


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS n, sha256(COALESCE(html, '')) AS sha FROM pages),
f AS (SELECT sha, MIN(page_id) AS first FROM p WHERE n >= {LEAST_BYTES} GROUP BY sha)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.sha AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM p LEFT JOIN f ON f.sha = p.sha AND n >= {LEAST_BYTES}
"""
