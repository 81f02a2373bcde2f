"""Quality by a factorisation machine (operator 1).

Features are the hashed distinct words, structure statistics in steps (each step a feature) and the
metadata column n_chars in steps. The score is a logistic of

    b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

which is linear in the number of features. A bounded sample of labelled rows is learned in shards
by AdaGrad; after each round the shards' parameters (of fixed size) are averaged and sent back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, cut, utf8
from .labelled import held_out, training_rows
from .rules import measure

#: Hashed words, then the statistics' steps.
WORD_BITS, RANK = 15, 8
MOST_ROWS, SHARD_ROWS = 16_384, 4_096
#: Upper ends of the steps of each statistic.
STEPS = {
    "capitals": (0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.75),
    "symbols": (0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0),
    "bangs": (0.0, 0.01, 0.05, 0.1, 0.5, 1.0),
    "bars": (0.0, 0.01, 0.05, 0.1, 0.25, 0.5),
    "digits": (0.0, 0.005, 0.02, 0.05, 0.1, 0.25, 0.5),
    "stops": (0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.5),
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 9.0, 12.0),
    "line_words": (2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0),
    "duplicate_lines": (0.0, 0.05, 0.1, 0.2, 0.3, 0.5),
    "repeated_words": (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75),
    "distinct_words": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "words": (0.0, 5.0, 10.0, 20.0, 50.0, 100.0, 300.0, 1000.0, 5000.0),
    "meta_chars": (0.0, 50.0, 100.0, 300.0, 1000.0, 3000.0, 10000.0, 50000.0),
}
_FIRST = {name: (1 << WORD_BITS) + sum(len(s) + 1 for s in list(STEPS.values())[:i]) for i, name in enumerate(STEPS)}
SIZE = (1 << WORD_BITS) + sum(len(s) + 1 for s in STEPS.values())


def _counts(text: bytes, which: bytes) -> int:
    return len(text) - len(text.translate(None, which))


def features(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct coordinates, values) for each row of text, n_chars."""
    texts = utf8(batch.column("text"))
    m = {name: values.tolist() for name, values in measure(batch.column("text")).items()}
    hashes = Words(batch.column("text")).of_each()
    for i, (text, n_chars, own) in enumerate(zip(texts, batch.column("n_chars").to_pylist(), hashes, strict=True)):
        text = text or b""
        words = np.unique(own >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        n, chars, lines = max(1, m["n_words"][i]), max(1, m["word_chars"][i]), max(1, m["n_lines"][i])
        stats = {
            "capitals": m["n_upper"][i] / chars,
            "symbols": m["n_symbols"][i] / n,
            "bangs": _counts(text, b"!") / n,
            "bars": _counts(text, b"|") / n,
            "digits": _counts(text, b"0123456789") / chars,
            "stops": _counts(text, b".,;:?") / n,
            "word_length": m["word_chars"][i] / n,
            "line_words": m["n_words"][i] / lines,
            "duplicate_lines": m["n_dup_lines"][i] / lines,
            "repeated_words": m["n_repeat_words"][i] / n,
            "distinct_words": len(words) / n,
            "words": m["n_words"][i],
            "meta_chars": float(n_chars or 0),
        }
        steps = [_FIRST[name] + int(np.searchsorted(STEPS[name], value)) for name, value in stats.items()]
        values = np.concatenate([np.full(len(words), 1 / np.sqrt(max(1, len(words)))), np.ones(len(steps))])
        yield np.concatenate([words, np.array(steps, dtype=np.int64)]), values


class Machine:
    """Parameters of the factorisation machine: bias, weights, factors."""

    def __init__(self) -> None:
        self.b, self.w = 0.0, np.zeros(SIZE)
        self.v = np.random.default_rng(7).normal(0, 0.01, (SIZE, RANK))

    def margin(self, at: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        vx = self.v[at] * x[:, None]
        total = vx.sum(axis=0)
        return float(self.b + self.w[at] @ x + 0.5 * (total @ total - np.einsum("ij,ij->", vx, vx))), total

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray, int]], rate: float, decay: float) -> None:
        """One AdaGrad pass in the given order."""
        g_b, g_w, g_v = 1.0, np.ones(SIZE), np.ones((SIZE, RANK))
        for at, x, y in rows:
            margin, total = self.margin(at, x)
            g = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y
            g_b += g * g
            self.b -= rate * g / np.sqrt(g_b)
            d_w = g * x + decay * self.w[at]
            g_w[at] += d_w * d_w
            self.w[at] -= rate * d_w / np.sqrt(g_w[at])
            v = self.v[at]
            d_v = g * (x[:, None] * total - v * (x * x)[:, None]) + decay * v
            g_v[at] += d_v * d_v
            self.v[at] = v - rate * d_v / np.sqrt(g_v[at])


def _round(shared: Broadcast, rate: float, decay: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """One pass over a shard, from the broadcast parameters."""

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        own = Machine()
        own.b, own.w, own.v = shared.value.b, shared.value.w.copy(), shared.value.v.copy()
        t = table.sort_by([("place", "ascending")])
        parts = zip(*(t.column(c).to_pylist() for c in ("at", "x", "y")), strict=True)
        own.learn([(np.frombuffer(at, dtype=np.int64), np.frombuffer(x, dtype=np.float64), y) for at, x, y in parts], rate, decay)
        return pa.table([[own.b], pa.array([own.w.tobytes()], pa.binary()), pa.array([own.v.tobytes()], pa.binary()), [len(t)], [key[0].as_py()]], names=["b", "w", "v", "n", "shard"])

    return learn


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str = "n_chars",
    most_rows: int = MOST_ROWS,
    rounds: int = 3,
    rate: float = 0.2,
    decay: float = 1e-4,
) -> Machine:
    """Learn from labelled rows outside fold 0; without any, every score is 0.5."""
    rows, n = training_rows(docs, labels, id_col, label_col, most_rows, {"text": text_col, "n_chars": chars_col})
    shards = max(1, -(-n // SHARD_ROWS))

    def extract(batch_rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batch_rows):
            at, x = zip(*features(batch), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("place"), batch.column("y"), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["shard", "place", "y", "at", "x"],
            )

    placed = rows.select("text", "n_chars", "y", F.pmod(F.xxhash64("_id", F.lit("shard")), F.lit(shards)).alias("shard"), F.xxhash64("_id", F.lit("place")).alias("place"))
    seen = cut(placed.mapInArrow(extract, "shard bigint, place bigint, y int, at binary, x binary"))
    machine = Machine()
    for _ in range(rounds if n else 0):
        learn = _round(docs.sparkSession.sparkContext.broadcast(machine), rate, decay)
        learned = sorted(seen.groupBy("shard").applyInArrow(learn, "b double, w binary, v binary, n bigint, shard bigint").collect(), key=lambda r: r["shard"])  # a row for each shard
        total = sum(r["n"] for r in learned)
        if not total:
            break
        machine = Machine()
        machine.b = sum(r["b"] * r["n"] for r in learned) / total
        machine.w = sum(np.frombuffer(r["w"]) * (r["n"] / total) for r in learned)
        machine.v = sum(np.frombuffer(r["v"]).reshape(SIZE, RANK) * (r["n"] / total) for r in learned)
    return machine


def score_quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of ``docs``.

    A null text counts as empty and a null n_chars as 0; null ids and repeated rows are kept; an
    empty table gives no rows. Only id, text and n_chars are read; the id is no input of the score.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(chars_col).cast("long").alias("n_chars"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            margins = np.array([shared.value.margin(at, x)[0] for at, x in features(batch)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margins, -35, 35))))], names=["doc_id", "score"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    scored = narrow.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
