"""Quality rules as a ledger of bits (operator 4).

Each rule is evaluated once for each document. The ledger keeps the measurements and a bitmask of
the rules that failed; a policy is a mask, so policies are applied, compared and ablated with bit
operations on the ledger, never by reading texts again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, utf8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
_SYMBOLS, _CAPITALS = b"#*$%&|<>", bytes(range(65, 91))

#: Name -> SQL over the measurements that is true where the rule fails. The position is the bit.
#: All are integer comparisons, so that any engine gives the same bits.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "capitals": "100 * n_upper > 50 * word_chars",
}

#: Versioned policies: a document is kept if it fails none of the rules named.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "capitals"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "capitals", "short_words", "long_words"),
}


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(rule) for rule in POLICIES[policy])


def _repeat_words(windows: np.ndarray, n_words: int) -> int:
    """Words inside 3-word windows that the text has at least twice."""
    if n_words < 4:
        return 0
    ordered = np.sort(windows)
    repeated = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(repeated):
        return 0
    again = np.isin(windows, repeated)
    covered = np.zeros(n_words, dtype=bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of a column of whole texts."""
    words = Words(column, lower=False)
    n_words = np.diff(words.offsets)
    in_words = np.concatenate([[0], np.cumsum(words.ends - words.starts)])[words.offsets]
    n_chars = np.array(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), dtype=np.int64)
    bytes_of = lambda chars: np.diff(np.concatenate([[0], np.cumsum(np.isin(words.data, np.frombuffer(chars, dtype=np.uint8), kind="table"))])[words.chars])
    n_lines, n_dup_lines = [], []
    for text in utf8(column):
        lines = [line for line in (text or b"").split(b"\n") if line.strip()]
        n_lines.append(len(lines))
        n_dup_lines.append(len(lines) - len(set(lines)))
    return {
        "n_words": n_words,
        "word_chars": n_chars - (np.diff(words.chars) - np.diff(in_words)),
        "n_symbols": bytes_of(_SYMBOLS),
        "n_dup_lines": np.array(n_dup_lines, dtype=np.int64),
        "n_repeat_words": np.array([_repeat_words(w, n) for w, n in zip(words.shingles(3), n_words.tolist(), strict=True)], dtype=np.int64),
        "n_lines": np.array(n_lines, dtype=np.int64),
        "n_upper": bytes_of(_CAPITALS),
    }


def fail_bits() -> Column:
    """Bits of the failed rules, from the measurements."""
    bits = [F.when(F.expr(sql), F.lit(1 << i)).otherwise(F.lit(0)) for i, sql in enumerate(RULES.values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def passes(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy))) == 0


def _measured(rows: Iterable[pa.RecordBatch], text_at: int, keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        values = measure(batch.column(text_at))
        kept = batch.columns if keep else [batch.column(0)]
        arrays = [*kept, *(pa.array(values[name], pa.int64()) for name in MEASURES)]
        names = [*(f"_in{i}" for i in range(len(kept))), *MEASURES]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and fail_bits, a row for each row of ``docs``.

    A null or empty text has zero for every measurement and fails ``few_words``; null ids and
    repeated rows are kept; an empty table gives no rows; other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("_in0"), F.col(text_col).alias("_in1"))
    kind = narrow.schema["_in0"].dataType.simpleString()
    schema = f"_in0 {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    measured = narrow.mapInArrow(lambda rows: _measured(rows, 1, keep=False), schema)
    return measured.withColumnRenamed("_in0", "doc_id").withColumn("fail_bits", fail_bits())


def keep_documents(docs: DataFrame, policy: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes the policy; one pass, no shuffle.

    A null or empty text has no words and so fails ``few_words``; null ids and repeated rows are judged
    one by one; an empty table gives no rows; columns of any name pass through.
    """
    named = docs.toDF(*(f"_in{i}" for i in range(len(docs.columns))))
    at = docs.columns.index(text_col)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in named.schema), *(f"{m} bigint" for m in MEASURES)])
    measured = named.mapInArrow(lambda rows: _measured(rows, at, keep=True), schema)
    return measured.filter(passes(fail_bits(), policy)).select(*(F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)))


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy does: rule, n_failed, n_alone (kept again without the rule), n_rejected, n_docs.

    One aggregation of the ledger to a row for each distinct mask; no text is read. Rows count
    one by one, whatever their doc_id; an empty ledger gives a row of zeros for each rule.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    bits = ledger.groupBy(masked.alias("bits")).agg(F.count("*").alias("n"))  # 2^rules rows at most
    where = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    bit = {rule: F.lit(1 << list(RULES).index(rule)) for rule in POLICIES[policy]}
    counted = [F.struct(F.lit(rule).alias("rule"), where(F.col("bits").bitwiseAND(b) != 0).alias("n_failed"), where(F.col("bits") == b).alias("n_alone")) for rule, b in bit.items()]
    total = bits.agg(F.array(*counted).alias("r"), where(F.col("bits") != 0).alias("n_rejected"), where(F.lit(True)).alias("n_docs"))
    return total.withColumn("r", F.explode("r")).select("r.rule", "r.n_failed", "r.n_alone", "n_rejected", "n_docs")


_W = r"[^\x20\x09-\x0D]+"
#: The measurements in DuckDB SQL over the table `documents`.
MEASURE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
win AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS p, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) AS w
  FROM d WHERE len(ws) > 2),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY rid),
ln AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_W}') GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM d LEFT JOIN cov USING (rid) LEFT JOIN ln USING (rid))
"""
