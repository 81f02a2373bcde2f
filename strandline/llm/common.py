"""Helpers shared by the corpus operators: words, hashes, Arrow columns, checkpoints.

A *word* is a maximal run of bytes outside space, \\t, \\n, \\v, \\f and \\r, which is what
``bytes.split()`` yields on UTF-8; ``bytes.lower()`` lower-cases A-Z only.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Odd 64-bit multipliers: fixed values, one for each position of a shingle.
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` words; a shorter text is one shingle, no words none."""
    if len(words) == 0:
        return words
    width_here = min(width, len(words))
    n = len(words) - width_here + 1
    total = np.full(n, width_here, dtype=np.uint64)
    for i in range(width_here):
        # A running product makes the hash depend on the order, for any width.
        total = (total ^ (words[i : i + n] * _MULTIPLIERS[i % 8])) * _MULTIPLIERS[(i + 3) % 8]
    return mix(total)


_SPACE = b" \t\n\v\f\r"
_SPAN = 1 << 18
_PRIME = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(_SPAN, _PRIME, dtype=np.uint64))
_INVERSES = np.cumprod(np.full(_SPAN, pow(_PRIME, -1, 1 << 64), dtype=np.uint64))


class Words:
    """64-bit hashes of the words of a column of texts, as one array.

    A word's hash is a polynomial in its bytes; differences of running sums give that of every word
    of a column at once. ``offsets[i]`` is the place of the first word of text i.
    """

    _codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, column: pa.Array, lower: bool = True, spaces: bytes = _SPACE):
        column = column.cast(pa.large_string()).fill_null("")
        self.chars = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.data = np.frombuffer(data, dtype=np.uint8)[self.chars[0] : self.chars[-1]] if data else np.empty(0, dtype=np.uint8)
        self.chars = self.chars - self.chars[0]
        inside = np.ones(256, dtype=bool)
        inside[list(spaces)] = False
        inside = inside[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = self.chars[1:] > self.chars[:-1]
        for marks, at in ((first, self.chars[:-1][filled]), (last, self.chars[1:][filled] - 1)):
            marks[at] = inside[at]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, self.chars)
        codes = self._codes.copy()
        if lower:
            codes[65:91] = codes[97:123]
        self.hashes = self._hashed(codes, lower)

    def _hashed(self, codes: np.ndarray, lower: bool) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(out):
            start = self.starts[i]
            j = int(np.searchsorted(self.ends, start + _SPAN, "right"))
            if j <= i:  # a word longer than a span
                word = self.data[start : self.ends[i]].tobytes()
                out[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
                i += 1
                continue
            span = self.data[start : self.ends[j - 1]]
            sums = np.zeros(len(span) + 1, dtype=np.uint64)
            np.cumsum(codes[span] * _POWERS[: len(span)], out=sums[1:])
            a, b = self.starts[i:j] - start, self.ends[i:j] - start
            out[i:j] = (sums[b] - sums[a]) * _INVERSES[a]
            i = j
        return mix(out)

    def of_each(self) -> Iterator[np.ndarray]:
        """The word hashes of each text."""
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            yield self.hashes[a:b]

    def shingles(self, width: int) -> Iterator[np.ndarray]:
        """The shingle hashes of each text, in order, repeats included."""
        windows = shingle_hashes(self.hashes, width)
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            yield windows[a : b - width + 1] if b - a >= width else shingle_hashes(self.hashes[a:b], width)


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as a list of UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def batches(rows: Iterable[pa.RecordBatch], max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``max_bytes`` (or one row), so long texts don't pile up in Python."""
    for batch in rows:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def crc32_of(doc_id: Column) -> Column:
    """crc32 of an id's decimal text, as the contracts' folds use it. A null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def crc32_text(value: object) -> int:
    return zlib.crc32(str(value).encode())


def can_checkpoint(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; where none is set, a local session gets a folder, a cluster an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and cut off from their lineage."""
    can_checkpoint(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
