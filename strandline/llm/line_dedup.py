"""Cross-site boilerplate lines by distinct-site spread (operator 8).

Each distinct line gets a HyperLogLog sketch of the sites it stands on; sketches of parts of the data
merge by aggregation, so a line that is everywhere costs a few bytes for each task. Lines
whose estimate is near the threshold get an exact count of sites; the others are decided by
the estimate, which is further from the threshold than five standard errors. The lines to be removed are
few, whatever the corpus: their hashes are broadcast and texts are cleaned where they are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, cut

#: Lines to be removed that each task may hold; more are joined with the lines of the documents.
MOST_HELD = 250_000

_BITS = 10
#: Standard error of the estimate.
_ERROR = 1.04 / 2 ** (_BITS / 2)
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _keys(line: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; :func:`_key` is the same for the bytes of a line."""
    return F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit("line"), line).alias("_h2")


def line_places(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """_id, _text (hash), _site, _pos, _h1, _h2 for each line with a word."""
    lines = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.col(site_col).cast("string").alias("_site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("_pos", "_line"))
    return lines.filter(F.col("_line").rlike(_HAS_WORD)).select("_id", "_text", "_site", "_pos", *_keys(F.col("_line")))


def spread_lines(places: DataFrame, min_sites: int) -> DataFrame:
    """_h1, _h2 of the lines that stand on ``min_sites`` different sites or more."""
    known = places.filter(F.col("_site").isNotNull())
    sketches = known.groupBy("_h1", "_h2").agg(F.hll_sketch_agg("_site", F.lit(_BITS)).alias("_sketch"))
    estimates = cut(sketches.select("_h1", "_h2", F.hll_sketch_estimate("_sketch").alias("_sites")).filter(F.col("_sites") >= min_sites * (1 - 5 * _ERROR) - 1))
    near = F.col("_sites") <= min_sites * (1 + 5 * _ERROR) + 1
    n = estimates.count()
    asked = estimates.filter(near).select("_h1", "_h2")
    exact = (
        known.join(F.broadcast(asked) if n <= 1_000_000 else asked, ["_h1", "_h2"])
        .select("_h1", "_h2", "_site")
        .distinct()
        .groupBy("_h1", "_h2")
        .agg(F.count("*").alias("_sites"))
        .filter(F.col("_sites") >= min_sites)
    )
    return estimates.filter(~near).select("_h1", "_h2").unionAll(exact.select("_h1", "_h2"))


_LINE_SEED = xxhash.xxh64_intdigest(b"line", 42)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _key(line: bytes) -> tuple[int, int]:
    """xxhash64(line) and xxhash64('line', line), as Spark has them."""
    return _signed(xxhash.xxh64_intdigest(line, 42)), _signed(xxhash.xxh64_intdigest(line, _LINE_SEED))


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, most_held: int = MOST_HELD) -> DataFrame:
    """doc_id, n_lines, n_removed, text: each row without the lines that ``min_sites`` sites share.

    Lines end at a newline. Lines without a word are never removed nor counted. A null site counts as
    none; a null text stays null with no lines; null ids and repeated rows are kept; an empty
    table gives no rows. Other columns are not read. The hashes of up to ``most_held`` lines are broadcast
    and texts stay where they are; beyond it the lines' places are joined, with the same rows.
    """
    places = line_places(docs, id_col, text_col, site_col)
    spread = cut(spread_lines(places, min_sites))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if spread.count() <= most_held:
        return _without(narrow, {(r["_h1"], r["_h2"]) for r in spread.collect()})  # at most `most_held` pairs of numbers
    hits = places.join(spread, ["_h1", "_h2"]).select("_id", "_text", "_pos")
    removed = hits.groupBy("_id", "_text").agg(F.collect_set("_pos").alias("_removed"))
    narrow = narrow.withColumn("_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    return _without(narrow.join(removed, same, "left").select("doc_id", "text", "_removed"), None)


def _without(docs: DataFrame, gone: set[tuple[int, int]] | None) -> DataFrame:
    """doc_id, n_lines, n_removed, text of ``docs`` without the lines with these keys, or those at the places that a third column has."""
    shared = docs.sparkSession.sparkContext.broadcast(gone)

    def rebuilt(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for batch in batches(rows):
            places = [None] * len(batch) if keys is not None else batch.column(2).to_pylist()
            n_lines, n_removed, texts = [], [], []
            for text, at in zip(batch.column(1).to_pylist(), places, strict=True):
                lines = [] if text is None else text.split("\n")
                worded = [i for i, line in enumerate(lines) if line.strip(" \t\n\v\f\r")]
                removed = set(at or ()) if keys is None else {i for i in worded if _key(lines[i].encode()) in keys}
                n_lines.append(len(worded))
                n_removed.append(len(removed))
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in removed) if removed else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_removed", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rebuilt, f"doc_id {kind}, n_lines bigint, n_removed bigint, text string")


#: The query's rows in DuckDB SQL over `documents`.
LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents),
l AS (
  SELECT rid, source, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM d),
b AS (
  SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 10),
k AS (
  SELECT rid, pos, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word, b.line IS NOT NULL AS gone
  FROM l LEFT JOIN b USING (line)),
a AS (
  SELECT rid, CAST(count(*) FILTER (WHERE has_word) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS t FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE md5(coalesce(t, '')) END AS clean_md5
FROM d LEFT JOIN a USING (rid)
"""
