"""Block bootstrap replicates without a row for each month: a series is one array, a block's sum one difference of running sums.

A row is one group's months (as many as the calendar has) with a span of replicates; spans are dealt over the cluster, and
NumPy works on a span at a time. Draws are those of :func:`~strandline.operators.inference.block_index`: md5 of seed, replicate and block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Replicates of a span.
SPAN = 256


def length_of(n: int) -> int:
    """The default length of blocks: max(3, n^(1/3) rounded half to even)."""
    return max(3, round(n ** (1 / 3)))


@lru_cache(maxsize=64)  # groups of one length share their draws
def starts(seed: int, first: int, count: int, n: int, block: int) -> np.ndarray:
    """(replicate, block): where each block of the replicates from ``first`` on begins."""
    blocks = -(-n // block)
    drawn = [int(md5(f"{seed}|{rep}|{k}".encode()).hexdigest()[:8], 16) % n for rep in range(first, first + count) for k in range(blocks)]
    return np.array(drawn, dtype=np.int64).reshape(count, blocks)


def sizes(n: int, block: int) -> np.ndarray:
    """Lengths of the blocks; the last is cut so that a replicate has n months."""
    blocks = -(-n // block)
    return np.append(np.full(blocks - 1, block), n - block * (blocks - 1))


def block_sums(values: np.ndarray, first: np.ndarray, block: int) -> np.ndarray:
    """(replicate, block, column): sums of the columns of ``values`` (month, column) over blocks that run on from the end to the beginning."""
    n = len(values)
    total = np.vstack([np.zeros(values.shape[1]), np.cumsum(values, axis=0)])
    end = first + sizes(n, block)
    over = np.maximum(end - n, 0)
    return total[np.minimum(end, n)] - total[first] + total[over]


def places(first: np.ndarray, n: int, block: int) -> np.ndarray:
    """(replicate, month): the months that each replicate draws, in order."""
    offsets = np.concatenate([np.arange(k) for k in sizes(n, block)])
    return (np.repeat(first, sizes(n, block), axis=1) + offsets) % n


@lru_cache(maxsize=4)  # groups of one length share their draws
def month_counts(seed: int, replicates: int, n: int, block: int) -> np.ndarray:
    """(replicate, month): how often each replicate draws a month; the first row is the data itself, every month once."""
    drawn = places(starts(seed, 0, replicates, n, block), n, block) if replicates else np.zeros((0, n), dtype=int)
    counts = np.zeros((replicates + 1, n))
    counts[0] = 1
    np.add.at(counts, (np.arange(1, replicates + 1)[:, None], drawn), 1)
    return counts


def over_replicates(
    rows: DataFrame, by: tuple[str, ...], order: str, columns: list[str], replicates: int, of: Callable[..., dict[str, np.ndarray]], kinds: str, seeds: tuple[int, ...] = (7,), block: int | None = None, least: int = 1
) -> DataFrame:
    """``by``, seed, rep and what ``of`` finds (``kinds``: its columns and types) for each replicate of every group of rows.

    ``of(values, first, block)`` gets a group's columns in order (month, column) and a span's starts, and returns one array for each column
    of ``kinds``; replicates where any of them is not finite are left out, as are groups of fewer than ``least`` months. A null value is not a number.
    """
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns))))).alias("_m")).filter(F.size("_m") >= least)
    column = lambda name: F.transform("_m", lambda m: m[name])
    arrays = packed.select(*by, *(column(f"v{i}").alias(f"_a{i}") for i in range(len(columns))))
    spread = arrays.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds)))).withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(max(0, replicates - 1)), F.lit(SPAN))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(parts, *by, "seed", "_first")
    names = [k.split()[0] for k in kinds.split(", ")]
    keys = len(by)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = np.column_stack([batch.column(keys + c)[i].values.to_numpy(zero_copy_only=False) for c in range(len(columns))]).astype(float)
                seed, first = batch.column("seed")[i].as_py(), batch.column("_first")[i].as_py()
                n, count = len(values), min(SPAN, replicates - first)
                length = block or length_of(n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    found = of(values, starts(seed, first, count, n, length), length)
                good = np.flatnonzero(np.logical_and.reduce([np.isfinite(found[c]) for c in names]))
                own = [batch.column(k).take(pa.array(np.full(len(good), i))) for k in range(keys)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(good), seed, dtype=np.int32)), pa.array((first + good).astype(np.int32)), *(pa.array(found[c][good]) for c in names)], names=[*by, "seed", "rep", *names])

    key = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*by).schema)
    return dealt.mapInArrow(run, f"{key}seed int, rep int, {kinds}") if replicates else rows.sparkSession.createDataFrame([], f"{key}seed int, rep int, {kinds}")
