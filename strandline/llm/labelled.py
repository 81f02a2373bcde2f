"""A bounded sample of labelled documents, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, cut

#: Fold of the contract: rows of remainder 0 are never learned from.
FOLDS = 5


def held_out(doc_id) -> F.Column:
    return F.pmod(crc32_of(doc_id), F.lit(FOLDS)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, most_rows: int, columns: dict[str, str], label_id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """(_id, y and ``columns`` of labelled rows outside fold 0, one for each id; the number of ids, before the join).

    ``most_rows`` at most: where more ids are labelled, those with the smallest hash stay. They are so few
    that the documents are filtered where they are read. Null labels are dropped, of labels repeated
    for an id the largest counts, and of rows that repeat an id the one with the largest hash of ``columns``.
    """
    good = (
        labels.select(F.col(label_id_col).alias("_id"), F.col(label_col).alias("_y"))
        .filter(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.max("_y").cast("int").alias("y"))
    )
    n = good.count()
    order = F.xxhash64("_id")
    if n > most_rows:
        slack = most_rows + 5 * most_rows**0.5  # so few are left that their order is found in one task
        good = good.filter(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * min(1.0, slack / n))).orderBy(F.pmod(order, F.lit(1 << 30)), "_id").limit(most_rows)
    sample = cut(good)
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*(F.col(c).alias(alias) for alias, c in columns.items())).alias("_row"))
    once = rows.join(F.broadcast(sample), "_id").groupBy("_id", "y").agg(F.max_by("_row", F.xxhash64("_row")).alias("_row"))
    return once.select("_id", "y", "_row.*"), min(n, most_rows)
