"""Toxicity by FTRL-proximal logistic regression (operator 7).

Features are the distinct hashed words, pairs of neighbours and skip-grams (a word and the one after
the next) of the whole text. Each shard of a bounded sample of labelled rows is learned by one task,
with a rate of its own for each coordinate and an L1 penalty that leaves few weights; the shards'
weights are averaged and broadcast: they are as few as the penalty leaves, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, cut, mix
from .labelled import held_out, training_rows

#: Size of the hash space.
BITS = 22
#: What separates words here: white space and punctuation.
_BETWEEN = b" \t\n\v\f\r.,;:!?\"'()[]{}*"
#: Documented bounds of the sample: rows in all, and about the rows and the bytes of coordinates that one task learns from.
MOST_ROWS, SHARD_ROWS, SHARD_BYTES = 32_768, 16_384, 1 << 27


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Hashed features of each text, repeats included."""
    found = Words(column, spaces=_BETWEEN)
    words = found.hashes
    place = lambda x: (mix(x) >> np.uint64(64 - BITS)).astype(np.int64)
    one = place(words)
    two = place(words[:-1] * np.uint64(3) + words[1:] * np.uint64(0x9E3779B97F4A7C15))
    skip = place(words[:-2] * np.uint64(5) + words[2:] * np.uint64(0xC2B2AE3D27D4EB4F))
    for a, b in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True):
        yield np.concatenate([one[a:b], two[a : max(a, b - 1)], skip[a : max(a, b - 2)]])


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) learned from (distinct features, label) rows in their order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z_bias = n_bias = 0.0

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for at, y in rows:
            z_at, n_at = z[at], n[at]
            w = weights(z_at, n_at)
            bias = -z_bias / ((beta + np.sqrt(n_bias)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            z[at] = z_at + g - (np.sqrt(n_at + g * g) - np.sqrt(n_at)) / alpha * w
            n[at] = n_at + g * g
            z_bias += g - (np.sqrt(n_bias + g * g) - np.sqrt(n_bias)) / alpha * bias
            n_bias += g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at, w[at], float(-z_bias / ((beta + np.sqrt(n_bias)) / alpha))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    most_rows: int = MOST_ROWS,
    epochs: int = 8,
    alpha: float = 2.5,
    beta: float = 1.0,
    l1: float = 4.0,
    l2: float = 0.0,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and bias; without labels no weights and bias 0.

    Null labels and null ids are dropped, of repeated ids one row is learned from (see ``training_rows``), and a
    null text has no feature. Texts of any length become at most 2^22 coordinates where they are read; more bytes of these make more shards.
    """
    rows, n = training_rows(docs, labels, id_col, label_col, most_rows, {"text": text_col})

    def extract(batch_rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batch_rows):
            at = pa.array([np.unique(f).astype(np.int32).tobytes() for f in features(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("place"), batch.column("order"), at], names=["y", "place", "order", "at"])

    placed = rows.select("text", "y", F.xxhash64("_id", F.lit("shard")).alias("place"), F.xxhash64("_id", F.lit("order")).alias("order"))
    seen = cut(placed.mapInArrow(extract, "y int, place bigint, order bigint, at binary"))
    n_bytes = seen.agg(F.coalesce(F.sum(F.octet_length("at").cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-n // SHARD_ROWS), -(-n_bytes // SHARD_BYTES))
    sharded = seen.select(F.pmod("place", F.lit(shards)).alias("shard"), "y", "order", "at")

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        in_order = np.argsort(table.column("order").to_numpy(), kind="stable")
        at, y = table.column("at").to_pylist(), table.column("y").to_pylist()
        at, w, bias = ftrl([(np.frombuffer(at[i], dtype=np.int32), y[i]) for i in in_order.tolist()], epochs, alpha, beta, l1, l2)
        return pa.table([pa.array([at.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), [bias], [len(y)]], names=["at", "w", "bias", "n"])

    learned = sharded.groupBy("shard").applyInArrow(learn, "at binary, w binary, bias double, n bigint").collect()  # a row for each shard
    total, sums, bias = sum(r["n"] for r in learned), np.zeros(1 << BITS), 0.0
    for r in sorted(learned, key=lambda r: bytes(r["w"])):
        sums[np.frombuffer(r["at"], dtype=np.int64)] += np.frombuffer(r["w"], dtype=np.float64) * r["n"] / total
        bias += r["bias"] * r["n"] / total
    at = np.flatnonzero(sums)
    return at, sums[at], bias


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of ``docs``.

    Null and empty texts get the score of no feature; null ids and repeated rows are kept; an empty
    table gives no rows. Only id and text are read.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[at] = w
        for batch in batches(rows):
            out = []
            for found in features(batch.column(1)):
                found = np.unique(found[dense[found] != 0])
                out.append(bias + float(dense[found].sum(dtype=np.float64)))
            p = 1 / (1 + np.exp(-np.clip(np.array(out), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    scored = narrow.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
