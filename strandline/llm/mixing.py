"""Mixing sources to target weights by systematic sampling (operator 9): DataFrame functions only.

Every document of a source expects ``rate = target / source_size`` copies. Expected copies are
summed along the source in the order of size; one random offset for the source is added; a
document is emitted once for each integer that its step crosses. As documents of like size are
neighbours, the words taken miss the target by about one document.

The prefix sums never put a source into one task: rows are first counted by (source, size, salt),
the small table of counts is summed in order, and only rows with the same three are ranked. The
salt comes from the id and the text, so rows without ids spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

#: Fixed values of the contract: weights of the sources in order, and the most copies of a document.
WEIGHTS = (5, 2, 1)
MOST = 3


def _draw(text: Column) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the text alone."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """_source (null: none), source_size, target, rate by source; a row for each source.

    Targets share the sum of all sizes by weight. Where a share exceeds MOST times its source's
    size it stops there and the excess is shared again: sources in the order of MOST * size /
    weight, each stopping while its own share of what the earlier ones left exceeds the limit.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = sized.groupBy("source", "_source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight.cast("long"))
    filled = W.orderBy(F.col("source_size") * MOST / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, later = filled.rowsBetween(W.unboundedPreceding, -1), filled.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(F.col("source_size") * MOST).over(earlier), F.lit(0))
    level = left.cast("double") / F.sum("weight").over(later).cast("double")
    stops = F.col("source_size") * MOST <= F.col("weight") * F.col("_level")
    return (
        sources.withColumn("_level", level)
        .withColumn("_stops", stops)
        .withColumn("_level", F.max(F.when(~F.col("_stops"), F.col("_level"))).over(W.partitionBy()))
        .select(
            "_source",
            "source_size",
            F.when(F.col("_stops"), (F.col("source_size") * MOST).cast("double")).otherwise(F.col("weight") * F.col("_level")).alias("target"),
        )
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
    seed: int = 0,
    rows_per_salt: int = 16_384,
    most_salts: int = 4_096,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and the columns ``keep`` by row.

    A null text has size 0 and so takes nothing; a null source is a source of its own, the last; a
    null doc_id is ranked like an empty one; repeated rows are drawn one by one, those of one
    doc_id in the order of their text's hash; an empty table gives no rows. Reruns give the same rows: every draw comes from md5. Only the named columns of
    ``docs`` are read.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_source"),
        _draw(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
        *(F.col(c).alias(f"_keep_{c}") for c in keep),
    )
    if not keep:
        rows = cut(rows)
    n = rows.count()
    salts = min(most_salts, max(1, -(-n // rows_per_salt)))
    id_and_text = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_text").cast("string"))
    rows = rows.withColumn("_salt", F.pmod(_draw(id_and_text), F.lit(salts)))

    counts = rows.groupBy("source", "_source", "size", "_salt").agg(F.count("*").alias("n"))
    counts = counts if not keep else cut(counts)
    targets = source_targets(counts.select("source", "_source", (F.col("size") * F.col("n")).alias("size")))
    sizes = counts.groupBy("_source", "size").agg(F.sum("n").alias("n"))
    at_size = sizes.select(
        "_source",
        "size",
        F.coalesce(F.sum("n").over(W.partitionBy("_source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_at_size"),
    )
    at_salt = F.coalesce(F.sum("n").over(W.partitionBy("_source", "size").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = (
        counts.select("_source", "size", "_salt", at_salt.alias("_at_salt"))
        .join(at_size, ["_source", "size"])
        .join(targets, "_source")
        .select("_source", "size", "_salt", (F.col("_at_size") + F.col("_at_salt")).alias("_before"), "source_size", "target", "rate")
    )
    place = F.col("_before") + F.row_number().over(W.partitionBy("_source", "size", "_salt").orderBy("doc_id", "_text"))
    offset = _draw(F.concat(F.lit(f"{seed}|"), F.col("_source"))) / F.lit(float(1 << 32))
    return (
        rows.join(starts, ["_source", "size", "_salt"])
        .withColumn("_place", place)
        .withColumn("_offset", offset)
        .withColumn("copies", F.floor(F.col("_place") * F.col("rate") + F.col("_offset")) - F.floor((F.col("_place") - 1) * F.col("rate") + F.col("_offset")))
        .withColumn("copies", F.least(F.col("copies"), F.lit(MOST)).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(F.col(f"_keep_{c}").alias(c) for c in keep))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The rows of ``docs``, all columns, each repeated as often as the mix takes it.

    Null and empty texts have no words and are not taken; a null source is a source of its own; repeated
    rows and null ids are drawn one by one; an empty table gives no rows; columns of any name pass through.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    mixed = mix_sources(docs.toDF(*names), own[id_col], own[text_col], own[source_col], tuple(names), seed)
    once = mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return once.select(*(F.col(n).alias(c) for c, n in own.items()))


#: The same rows in DuckDB SQL over the table `documents`.
MIX_SQL = f"""
WITH rows0 AS (
  SELECT doc_id, source, coalesce(text, '') AS t, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         coalesce('=' || source, '') AS g FROM documents),
k AS (SELECT greatest(1, least(4096, CAST(ceil(count(*) / 16384.0) AS BIGINT))) AS salts FROM rows0),
rows1 AS (
  SELECT r.*, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || td), 1, 8) AS BIGINT) % salts AS salt
  FROM (SELECT *, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS td FROM rows0) r, k),
src AS (
  SELECT source, g, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS BIGINT) AS weight
  FROM rows1 GROUP BY source, g),
lv AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * {MOST}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl
  FROM src WINDOW o AS (ORDER BY CAST(source_size * {MOST} AS DOUBLE) / weight, source ASC NULLS LAST)),
st AS (SELECT *, source_size * {MOST} <= weight * lvl AS stops FROM lv),
tg AS (
  SELECT g, source_size, CASE WHEN stops THEN CAST(source_size * {MOST} AS DOUBLE)
         ELSE weight * max(CASE WHEN NOT stops THEN lvl END) OVER () END AS target FROM st),
pl AS (
  SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY r.g ORDER BY r.size, r.salt, r.doc_id NULLS FIRST, r.td) AS place,
         CAST('0x' || substr(md5('0|' || r.g), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS off
  FROM rows1 r JOIN tg t ON r.g = t.g),
cp AS (
  SELECT *, least({MOST}, CAST(floor(place * rate + off) - floor((place - 1) * rate + off) AS BIGINT)) AS copies FROM pl)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, copies, copies * CAST(size AS BIGINT) AS taken FROM cp
"""
