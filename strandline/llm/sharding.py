"""Sharding by sampled splitters (operator 3): DataFrame functions only.

1. Size-weighted draws of the key (hash of the text, hash of the doc_id): a record is drawn about
   ``size * draws / total`` times, with a fixed rounding offset from its own hash, so the sample has
   about ``draws`` rows at any input size and is the same in every run.
2. Quantiles of the draws are the splitters of ``ranges`` key ranges.
3. A range with more than ``rows_per_cell`` records (skewed keys, huge inputs) is subdivided by a
   hash of doc_id, size, text and place in the input into cells, so that repeated rows spread too.
4. Exact bytes and rows of the cells, summed in order, give every record its exact byte position;
   the position decides the shard, so shards differ by less than two of the largest records.

Equal texts have neighbouring keys, so a group of copies stays together unless a range is
overfull or a shard's end falls inside the group.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut


def _sizes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
        F.xxhash64(F.col(id_col)).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
    )


def sampled_splitters(sized: DataFrame, total: int, ranges: int, draws: int) -> list[tuple[int, int]]:
    """At most ``ranges - 1`` keys that cut the bytes of ``sized`` into about equal ranges."""
    offset = F.pmod(F.xxhash64("_hash", "_id", F.lit("splitters")), F.lit(1 << 30)) / float(1 << 30)
    drawn = sized.select("_hash", "_id", F.floor(F.col("size") * (draws / total) + offset).alias("n")).filter("n > 0")
    sample = sorted((r["_hash"], r["_id"], r["n"]) for r in drawn.collect())  # about `draws` rows
    ends = list(accumulate(n for *_, n in sample))
    keys = {sample[bisect_left(ends, ends[-1] * i / ranges)][:2] for i in range(1, ranges)} if sample else set()
    return sorted(keys)


def _range_of(splitters: list[tuple[int, int]], first: int = 0) -> Column:
    """Number of the range of (_hash, _id): a balanced tree of comparisons."""
    if not splitters:
        return F.lit(first)
    mid = len(splitters) // 2
    h, i = splitters[mid]
    below = (F.col("_hash") < h) | ((F.col("_hash") == h) & (F.col("_id") < i))
    return F.when(below, _range_of(splitters[:mid], first)).otherwise(_range_of(splitters[mid + 1 :], first + mid + 1))


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges: int = 64,
    draws: int = 8192,
    rows_per_cell: int = 250_000,
) -> DataFrame:
    """Place every record: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: shard sizes differ by less than two of the largest records. A record's size is its
    text's UTF-8 bytes plus 1. A null text counts as empty (size 1, crc32 0); doc_id may be of any type
    that can be hashed, or null; repeated rows are placed one by one; an empty table gives no rows.
    Inside an overfull range a record's place also depends on how the input is partitioned.
    Other columns of ``docs`` are ignored.
    """
    sized = cut(_sizes(docs, id_col, text_col))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    splitters = sampled_splitters(sized, total, ranges, draws) if total else []
    ranged = sized.withColumn("_range", _range_of(splitters))
    subs = ranged.groupBy("_range").agg(F.ceil(F.count("*") / rows_per_cell).alias("_subs"))  # at most `ranges` rows
    celled = ranged.join(F.broadcast(subs), "_range").withColumn("_sub", F.pmod(F.xxhash64("_id", "size", "_hash", "_row"), F.col("_subs")))

    # One row for each cell: `ranges` of them and one more for each rows_per_cell records at most.
    before = W.orderBy("_range", "_sub").rowsBetween(W.unboundedPreceding, -1)
    cells = (
        celled.groupBy("_range", "_sub")
        .agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_range",
            "_sub",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        )
    )
    inside = W.partitionBy("_range", "_sub").orderBy("_hash", "_id", "size")
    start = F.col("_bytes_before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = cut(
        celled.join(cells, ["_range", "_sub"]).select(  # the window below needs this shuffle anyway
            "doc_id",
            "size",
            "text_crc32",
            F.least(F.lit(n_shards - 1), F.floor(start * n_shards / F.lit(max(total, 1)))).cast("int").alias("shard"),
            (F.col("_rows_before") + F.row_number().over(inside) - 1).alias("_rank"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_rank") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
