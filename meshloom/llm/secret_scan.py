"""Secret scan over an incremental ledger of content-addressed blobs.

A text's address is its SHA-256. The ledger is a stored table with one row for each (blob, rule version) that was
scanned, with the spans found. A run writes the addresses of all rows, reads the ledger, chooses one row (the least
id) of each blob that the ledger has not under the rules' version, scans these texts where they lie, appends what it
found to the ledger, and joins the ledger back to every row with that content. Only ids and addresses are shuffled:
the rows not to be scanned, or if they are fewer those to be scanned, are sent to the tasks up to
``common.BROADCAST_ROWS`` rows; beyond that on both sides, the texts are joined by key.

Defined results: a null text is the empty text; repeated rows and ids are separate rows that share
a blob; runs that append to one ledger at once may store a blob twice, which counts once; an empty table gives no rows; other columns are ignored or, in ``redact``, kept. A web token (kind jwt)
starts where no letter, digit, hyphen or underscore stands before it, so each run of such characters is entered once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import common

#: (kind, pattern, group that must be long enough, least length). The first three are the base rules, in their order.
RULES: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # runs of hexadecimal digits; shorter runs would fail the length
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("prefixed", r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})", 0, 0),
)
BASE = 3
VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:12]
#: Rows in an Arrow batch that a scan handles at a time.
BATCH = 512

FOUND = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(text: str, rules=RULES) -> list[tuple[int, int, int]]:
    """(start, rule, end) of each match, leftmost and non-overlapping for each rule, in the order of the output."""
    out = []
    for k, (_, pattern, group, least) in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            cols: list[list] = [[] for _ in range(5)]
            for text in batch.column("text").to_pylist():
                spans = find(text)
                base = [s for s in spans if s[1] < BASE]
                for c, v in zip(cols, [*(sum(s[1] == k for s in base) for k in range(BASE)), hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans)], strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("blob"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def blob_id(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """The rows of the ledger at ``path`` under ``version``, one for each blob also where runs at once or repeated ones have appended it twice; none where nothing is stored yet."""
    rows = spark.read.schema(FOUND + ", version string").parquet(path) if common.exists(spark, path) else spark.createDataFrame([], FOUND + ", version string")
    return rows.filter(F.col("version") == version).drop("version").dropDuplicates(["blob"])


def _keyed(docs: DataFrame, *others) -> DataFrame:
    return docs.select(blob_id(F.col("text")).alias("blob"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), *others)


def scan_unseen(docs: DataFrame, path: str, version: str = VERSION) -> DataFrame:
    """Scans the contents of ``docs`` that the ledger at ``path`` has not under ``version`` and appends them; gives (blob, id, doc_id) of all rows."""
    spark = docs.sparkSession
    rows = common.written(_keyed(docs, "doc_id"))
    chosen = rows.select("blob", "id").join(read_ledger(spark, path, version).select("blob"), "blob", "left_anti").groupBy("blob").agg(F.min("id").alias("id"))
    chosen = common.written(chosen)
    wanted = chosen.count()
    if wanted:
        # a repeated (blob, id) is one of both sides as a whole
        others = rows.select("blob", "id").join(chosen, ["blob", "id"], "left_anti").distinct().limit(common.BROADCAST_ROWS + 1)
        others = common.written(others)
        texts = _keyed(docs, F.coalesce("text", F.lit("")).alias("text"))
        if others.count() <= common.BROADCAST_ROWS:
            texts = texts.join(F.broadcast(others), ["blob", "id"], "left_anti")
        else:
            texts = texts.join(F.broadcast(chosen) if wanted <= common.BROADCAST_ROWS else chosen, ["blob", "id"], "left_semi")
        found = common.written(texts.select("blob", "text").mapInArrow(_scan, FOUND))
        # rows that repeat id and content were scanned each
        once = found if found.count() == wanted else found.dropDuplicates(["blob"])
        once.withColumn("version", F.lit(version)).write.mode("append").parquet(path)
        common.dropped(found, others)
    common.dropped(chosen)
    return rows


def findings(docs: DataFrame, path: str, version: str = VERSION) -> DataFrame:
    """doc_id, blob and findings of each of ``docs``, by the ledger at ``path`` (a folder that need not exist yet)."""
    rows = scan_unseen(docs, path, version)
    return rows.drop("id").join(read_ledger(docs.sparkSession, path, version), "blob")


def cut(text: str, spans: str, mark: str) -> str:
    """``text`` with the spans (as told, by start) replaced by ``mark``, those that overlap by one; each character is copied once."""
    out, at = [], 0
    for span in spans.split(","):
        _, a, b = span.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], mark]
        at = max(at, int(b))
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, path: str | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each found span (overlapping ones merged) replaced by ``mark``, and n_chars made to fit.

    Findings are few and narrow: contents with a finding are joined to the rows by blob, and only texts with one go to Python. ``path``: the
    ledger, a new one by default.
    """
    path = path or common.shared_dir(docs.sparkSession)
    common.dropped(scan_unseen(docs, path))
    hits = common.if_small(read_ledger(docs.sparkSession, path).filter("spans <> ''").select("blob", "spans"))
    rows = docs.select(F.struct("*").alias("d"), F.col("text"), blob_id(F.col("text")).alias("blob")).join(hits, "blob", "left")

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else cut(t, s, mark) for t, s in zip(texts, spans, strict=True)], dtype=object)

    rows = rows.withColumn("clean", clean(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans")))
    new = {"text": F.coalesce("clean", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("clean").cast(docs.schema["n_chars"].dataType), F.col("d.n_chars"))
    return rows.select(*(new.get(c, F.col("d").getField(c)).alias(c) for c in docs.columns))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by the ledger that ``spark.meshloom.secrets.ledger`` names; where that is unset, by a new one in the shared folder."""
    path = spark.conf.get("spark.meshloom.secrets.ledger", None) or common.shared_dir(spark)
    rows = findings(common.table(spark, sf_dir, "documents"), path)
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")
