"""Packing by power-of-two decomposition (operator 13).

A document of n tokens is cut into full sequences of ``most`` tokens (a power of two) and, for the rest,
one piece for each binary digit of its length, the longest first. Every piece is a sequence of its
own: no sequence crosses documents and none is padded. Pieces of equal length form a bucket, and
batches are drawn within a bucket.

Sequences are numbered bucket by bucket: pieces are counted by (length, cell), the small table of
counts is summed in order, and only the pieces of one cell are ranked. A cell is a hash of the row's
number in the written table, so copies of one document spread like any other rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batches, cut

END = 1
MOST = 2_048
#: A space before anything but white space begins a token of its own in byte-level BPE, so text may be cut there.
_STEP = re.compile(r" (?=\S)")
_CHUNK = 1 << 20
#: Fixed values of byte-level BPE: bytes that stand for themselves in its vocabulary; the others are the characters from 256 on, in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Ids by the bytes of their token, if ids are in the order of the merges, as a merge by rank needs; else None."""
    vocabulary = model["vocab"]
    own = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [vocabulary.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))) or sorted(vocabulary[c] for c in own) != list(range(256)):
        return None
    return {bytes(own[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(pairs)}


@lru_cache(maxsize=2)  # once for each Python worker
def encoder(file: str) -> Callable[[str], bytes]:
    """A function from text to the ids of the tokenizer in ``file``, as little-endian 32-bit numbers.

    The ids are those of the library tokenizers. Where the file is a byte-level BPE with ids in the order of its merges, tiktoken
    merges the same vocabulary in a third of the time; text that it can't take (its expressions have a limit of depth) goes to tokenizers.
    """
    tokenizer = Tokenizer.from_file(file)
    plain = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    splits = spec.get("pre_tokenizer") or {}
    simple = splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space") and spec.get("normalizer") is None and not spec["model"].get("ignore_merges")
    ranks = _byte_ranks(spec["model"]) if simple and spec["model"]["type"] == "BPE" else None
    fast = None
    if ranks is not None:
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(part: str) -> bytes:
        if fast is None:
            return plain(part)
        try:
            return fast.encode_to_numpy(part, allowed_special="all").astype("<u4").tobytes()
        except BaseException as e:
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return plain(part)

    def encode(text: str) -> bytes:
        out, start = [], 0
        while start < len(text):
            step = _STEP.search(text, start + _CHUNK)  # very long texts a chunk at a time
            end = step.start() if step else len(text)
            out.append(ids(text[start:end]))
            start = end
        return b"".join(out)

    return encode


def pieces_of(n: int, most: int = MOST) -> list[int]:
    """Lengths of the pieces of n tokens, the longest first."""
    return [most] * (n // most) + [1 << k for k in reversed(range(most.bit_length() - 1)) if n % most >> k & 1]


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None, most: int = MOST, end: int = END) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32-bit), doc_tokens of each piece.

    A document's tokens are its text's ids and then ``end``, so a null or empty text is one piece of length 1. Whole
    texts are cut, however long. Null ids and repeated rows are documents like others; an empty table gives no
    rows. Only the two named columns are read.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    file = file or path("byte_bpe_50k.json")
    last = end.to_bytes(4, "little")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file)
        names = ["doc_id", "start", "length", "ids", "doc_tokens"]

        def emitted(batch: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
            at, start, length, ids, total = zip(*parts, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(total)], names=names)

        for batch in batches(rows):
            parts, held = [], 0
            for at, text in enumerate(batch.column(1).to_pylist()):
                tokens = encode(text or "") + last
                total, start = len(tokens) // 4, 0
                for length in pieces_of(total, most):
                    parts.append((at, start, length, tokens[4 * start : 4 * (start + length)], total))
                    start, held = start + length, held + 4 * length
                    if held > 4_000_000:
                        yield emitted(batch, parts)
                        parts, held = [], 0
            if parts:
                yield emitted(batch, parts)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint")


def number_sequences(pieces: DataFrame, batch_tokens: int = 1 << 19, rows_per_cell: int = 250_000, least_cells: int = 32) -> DataFrame:
    """The pieces, all columns, with sequence_id, offset and batch.

    Sequences count from 0 without gaps, the longest bucket first, in an order within a bucket that is random
    to documents; offset is 0 as a piece fills its sequence; batch counts groups of batch_tokens / length sequences
    within the bucket. Needs the column length; an empty table gives no rows.
    """
    rows = cut(pieces.withColumn("_row", F.monotonically_increasing_id()))
    cells = max(least_cells, -(-rows.count() // rows_per_cell))
    celled = rows.withColumn("_cell", F.pmod(F.xxhash64("_row"), F.lit(cells)))
    counts = celled.groupBy("length", "_cell").agg(F.count("*").alias("_n"))  # a row for each length and cell
    earlier = W.orderBy(F.desc("length"), "_cell").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("length", "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("length", "_cell").orderBy(F.xxhash64("_row", F.lit("order")), "_row")) - 1
    first = F.min("_before").over(W.partitionBy("length"))
    placed = celled.join(before.withColumn("_first", first), ["length", "_cell"]).withColumn("sequence_id", place)
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))
    batch = F.floor((F.col("sequence_id") - F.col("_first")) / per_batch)
    return placed.select(*pieces.columns, "sequence_id", F.lit(0).cast("long").alias("offset"), batch.alias("batch"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None, most: int = MOST) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset, batch: the training sequences of ``docs``; see the two steps."""
    return number_sequences(cut_documents(docs, id_col, text_col, file, most))
