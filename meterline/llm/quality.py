"""Quality rules (operator 3): a rule bitmask ledger.

Every text is measured once; every rule is evaluated once on the measurements and leaves one
bit in ``failed``. Policies are versioned bit masks over the ledger, so a new
policy or an ablation (what if one rule were dropped) is bitwise arithmetic over longs and never reads the
texts again.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import column, doc_columns, map_texts, text_bytes

# Rules in bit order: name and SQL condition over the measurements that is true where a text fails.
RULES = (
    ("too_short", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    ("shouting", "5 * n_bangs > n_words"),
    ("few_letters", "10 * n_letter_words < 6 * n_words"),
    ("one_word", "n_words >= 20 AND 2 * n_top_word > n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
# Versioned policies: the rules whose failure rejects a text.
POLICIES = {
    "base": BIT["too_short"] | BIT["repeated_windows"],
    "v1": sum(BIT.values()),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs",
            "n_letter_words", "n_top_word")
_SYMBOLS = [s.encode() for s in "#*$%&|<>"]
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_SPACES = b" \t\n\x0b\x0c\r"


def measure(data: bytes) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of ``MEASURES``."""
    words = data.split()
    n = len(words)
    joined = b"".join(words)
    word_chars = len(joined.decode("utf-8", "replace"))
    lines = [x for x in data.split(b"\n") if x.strip(_SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: dict = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        end = 0  # first word not yet counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    top: dict = {}
    for w in words:
        top[w] = top.get(w, 0) + 1
    letters = sum(c for w, c in top.items() if _LETTER.search(w))
    return (n, word_chars, sum(data.count(s) for s in _SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines),
            data.count(b"!"), letters, max(top.values(), default=0))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list | tuple = ()) -> DataFrame:
    """``(doc_id, *carry, *MEASURES, failed)``: one row per input row.

    Null and empty texts measure zero everywhere and fail ``too_short``. Repeated rows and
    null ids are kept as they are; columns not named are ignored; empty input gives no rows.
    ``carry`` names columns of the input that are passed through.
    """
    kept = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    names = [f"carry_{i}" for i in range(len(carry))]
    kinds = [docs.schema[c].dataType.simpleString() for c in carry]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = list(zip(*[measure(t) for t in text_bytes(batch)]))
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), *[column(batch, c) for c in names], *[pa.array(m, pa.int64()) for m in made]],
            names=["doc_id", *names, *MEASURES])

    schema = ", ".join(["doc_id long", *[f"{c} {k}" for c, k in zip(names, kinds)], *[f"{m} long" for m in MEASURES]])
    measured = map_texts(docs, doc_columns(id_col, text_col) + kept, schema, run)
    failed = F.lit(0).cast("long")
    for name, condition in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed).withColumnsRenamed(dict(zip(names, carry)))


def verdict(policy: str):
    """Boolean column: true where no rule of the policy has failed."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def accepted(docs: DataFrame, policy: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the policy keeps, with all their columns."""
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = ledger(whole, carry=["row"]).where(verdict(policy))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def ablation(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """``(rule, n_failed, n_rejected_alone, n_kept_without)`` for each rule of a policy, by bitwise aggregation."""
    mask = POLICIES[policy]
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    tally = ledger_rows.select(hit.alias("hit")).groupBy("hit").agg(F.count(F.lit(1)).alias("n"))
    rules = [(name, bit) for name, bit in BIT.items() if bit & mask]
    aggs = []
    for name, bit in rules:
        has = F.col("hit").bitwiseAND(F.lit(bit)) != 0
        alone = F.col("hit") == bit
        without = F.col("hit").bitwiseAND(F.lit(mask & ~bit)) == 0
        aggs += [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (has, alone, without)]
    one = tally.agg(F.array(*[F.struct(F.lit(name).alias("rule"), aggs[3 * i].alias("n_failed"),
                                       aggs[3 * i + 1].alias("n_rejected_alone"),
                                       aggs[3 * i + 2].alias("n_kept_without"))
                              for i, (name, _) in enumerate(rules)]).alias("r"))
    return one.select(F.inline("r"))


def _measures_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    bits = " + ".join(f"CASE WHEN {c} THEN {BIT[name]} ELSE 0 END" for name, c in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
tri AS (SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p + i) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS x(i) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{word}') GROUP BY doc_id),
top AS (SELECT doc_id, max(n) AS n_top_word FROM (SELECT doc_id, x, count(*) AS n FROM
        (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL) GROUP BY doc_id),
m0 AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs,
        len([x for x in w if regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')]) AS n_letter_words,
        coalesce(n_top_word, 0) AS n_top_word
      FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN top USING (doc_id)),
m AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m0)
"""


def oracle_sql(policy: str = "v1") -> str:
    return _measures_sql() + f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed & {POLICIES[policy]} = 0 AS kept, failed FROM m"""


def ablation_sql(policy: str = "v1") -> str:
    mask = POLICIES[policy]
    return _measures_sql() + "\nUNION ALL ".join(f"""SELECT '{name}' AS rule, count(*) FILTER (failed & {bit} <> 0) AS n_failed,
  count(*) FILTER (failed & {mask} = {bit}) AS n_rejected_alone, count(*) FILTER (failed & {mask & ~bit} = 0) AS n_kept_without FROM m"""
                                                for name, bit in BIT.items() if bit & mask)
