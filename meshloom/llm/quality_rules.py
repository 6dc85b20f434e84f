"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document. The ledger, a stored table, keeps the measurements and one
bit for each failed rule; policies are bit masks over it, so a new policy version or an
ablation study reads the ledger and never the texts.

Defined results: a null or empty text has no words, no lines and fails TOO_SHORT; repeated
rows each get their own row; null ids stay null; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import common

#: Words of a window that counts as repeated.
WINDOW = 8

#: Rules in the order of their bits; each is SQL over the measurements, true where a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("mostly_capitals", "100 * n_capitals > 50 * word_chars"),
    ("short_words", "10 * word_chars < 20 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE_MASK = BIT["too_short"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    """Documents that fail more than ``allowed`` of the rules in ``mask`` are rejected."""

    version: str
    mask: int
    allowed: int = 0


POLICIES = {
    "2024-base": Policy("2024-base", BASE_MASK),
    "2025-full": Policy("2025-full", (1 << len(RULES)) - 1),
}
CURRENT = POLICIES["2025-full"]


def _repeat_positions(pairs: Column) -> Column:
    """Start positions, ascending, of windows whose hash is at least twice in ``pairs`` (sorted structs of h and i)."""
    same = F.filter(pairs, lambda e, i: (e.h == F.get(pairs, i - 1).h) | (e.h == F.get(pairs, i + 1).h))
    return F.sort_array(F.transform(same, lambda e: e.i))


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row of counts for each document, with its id, or with the whole row as the struct ``_doc``.

    Windows are compared by 64-bit hashes within one document; two different windows of a
    document of a million words share a hash with a probability under 1e-7.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    name, value = ("_doc", F.struct("*")) if whole else (id_col, F.col(id_col))
    # each select is a step of its own: a column used again is computed once
    a = docs.select(
        value.alias(name), common.words(F.col(text_col)).alias("_w"), lines.alias("_l"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    b = a.select(
        name, "n_symbols", "n_capitals", F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") > WINDOW, F.transform("_w", lambda w: F.xxhash64(w))).alias("_h"),
    )
    for span in (1, 2, 4):  # hashes of 2, 4, then 8 words from each position on
        b = b.withColumn("_h", F.zip_with("_h", F.slice("_h", span + 1, F.size("_h")), lambda x, y: F.xxhash64(x, y)))
    b = b.withColumn("_h", F.slice("_h", 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))))
    kept = [c for c in b.columns if c != "_h"]
    has = F.size(F.array_distinct("_h")) < F.size("_h")
    c = b.select(*kept, F.when(has, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    d = c.select(*kept, F.when(F.col("_s").isNotNull(), _repeat_positions(F.col("_s"))).alias("_p"))
    steps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda x, y: F.least(F.coalesce(y - x, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return d.select(*kept, F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Measurements and ``fail_bits``: bit i is set where RULES[i] fails."""
    bits = F.lit(0).cast("long")
    for i, (_, rule) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(0).cast("long"))
    return measurements(docs, id_col, text_col, whole).withColumn("fail_bits", bits)


def passes(policy: Policy, bits: Column | None = None) -> Column:
    """Whether a ledger row passes ``policy``."""
    bits = F.col("fail_bits") if bits is None else bits
    return F.bit_count(bits.bitwiseAND(F.lit(policy.mask).cast("long"))) <= policy.allowed


def accepted(docs: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass ``policy``, unchanged."""
    # the row number keeps the optimizer from moving the filter into the steps, which would compute them again for each rule
    rows = ledger(docs, text_col=text_col, whole=True).withColumn("_row", F.monotonically_increasing_id())
    return rows.filter(passes(policy) & (F.col("_row") >= 0)).select("_doc.*")


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule: documents failing it, failing nothing else of the policy, and kept if the rule were dropped.

    The ledger shrinks to at most 2**len(RULES) bit patterns before anything is compared.
    """
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if policy.mask >> i & 1])
    each = counts.select("n", "fail_bits", F.explode(rules).alias("r")).select("n", "fail_bits", "r.*")
    failed = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    without = F.bit_count(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long").bitwiseXOR(F.col("bit")))) <= policy.allowed
    add = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
    return each.groupBy("rule").agg(
        add(failed).alias("n_failed"), add(failed & ~passes(policy) & without).alias("n_only_this"),
        add(passes(policy)).alias("n_kept"), add(without).alias("n_kept_without"),
    )


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of ``documents``, written once; policies and ablations read it."""
    return common.written(ledger(common.table(spark, sf_dir, "documents")))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_ledger(spark, sf_dir)
    failed = ~passes(POLICIES["2024-base"])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & passes(CURRENT)).alias("kept"), "n_lines", "n_capitals", "fail_bits",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does to ``documents``: (version, rule, counts), all from one ledger."""
    rows = stored_ledger(spark, sf_dir)
    each = [ablation(rows, p).select(F.lit(p.version).alias("version"), "*") for p in POLICIES.values()]
    return each[0].unionByName(each[1])


#: A quality stage keeps what this SQL calls kept; ``{docs}`` is a relation with doc_id and text, ``{key}`` tells its rows apart.
SQL_LEDGER = r"""
_t AS (SELECT {key} AS k, doc_id, COALESCE(text, '') AS text FROM {docs}),
_w AS (SELECT k, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM _t),
_win AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT k, w, UNNEST(range(1, len(w) - 6)) AS i FROM _w WHERE len(w) >= 9)),
_dup AS (SELECT k, i FROM (SELECT k, i, COUNT(*) OVER (PARTITION BY k, s) AS c FROM _win) WHERE c >= 2),
_rep AS (SELECT k, COUNT(DISTINCT p) AS n FROM (SELECT k, UNNEST(range(i, i + 8)) AS p FROM _dup) GROUP BY k),
_lines AS (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS l FROM _t),
_m AS (SELECT _t.k, doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[ \t\n\v\f\r]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(COALESCE(n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals
  FROM _t JOIN _w ON _w.k = _t.k JOIN _lines ON _lines.k = _t.k LEFT JOIN _rep ON _rep.k = _t.k),
_ledger AS (SELECT *, """ + " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES)) + """ AS bits FROM _m)
"""  # fmt: skip

SQL = "WITH " + SQL_LEDGER.replace("{docs}", "documents").replace("{key}", "row_number() OVER ()") + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & {BASE_MASK}) <> 0 AS base_failed,
  bits = 0 AS kept, n_lines, n_capitals, CAST(bits AS BIGINT) AS fail_bits FROM _ledger
"""  # fmt: skip

_RULE_ROWS = " UNION ALL ".join(
    f"SELECT '{p.version}' AS version, '{name}' AS rule, {1 << i} AS bit, {p.mask} AS mask, {p.allowed} AS allowed" for p in POLICIES.values() for i, (name, _) in enumerate(RULES) if p.mask >> i & 1
)
ABLATION_SQL = "WITH " + SQL_LEDGER.replace("{docs}", "documents").replace("{key}", "row_number() OVER ()") + f""", _r AS ({_RULE_ROWS})
SELECT version, rule, COUNT(*) FILTER (bits & bit <> 0) AS n_failed,
  COUNT(*) FILTER (bits & bit <> 0 AND bit_count(bits & mask) > allowed AND bit_count((bits & mask) & ~bit) <= allowed) AS n_only_this,
  COUNT(*) FILTER (bit_count(bits & mask) <= allowed) AS n_kept, COUNT(*) FILTER (bit_count((bits & mask) & ~bit) <= allowed) AS n_kept_without
FROM _ledger, _r GROUP BY version, rule
"""  # fmt: skip
