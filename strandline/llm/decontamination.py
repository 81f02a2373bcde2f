"""Benchmark decontamination by size-partitioned MinHash containment search (operator 2).

Shingles are five lower-cased words. The sketch of a test item with n distinct shingles is its
k = n - ceil(share * n) + 1 smallest shingle hashes (a bottom-k MinHash whose size grows with the
item). A document that contains ``share`` of the item lacks fewer than k of its shingles, so it
has at least one of the sketch: the search loses nothing, however long the document is. Items are
partitioned by n, and a document probes only the partitions that it is large enough to contain.
Candidates are verified by exact containment of the shingles' words. An item of n < 5 words is compared
with the windows of n words of each document, one more pass over its hashes for each such n in a block.

The test items are the stated query set: they are taken in blocks of bounded size, and the documents
are read once for every ``blocks_per_pass`` broadcast blocks, without a shuffle; a pass hashes each text once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Words, batches, cut

_BITS = 1 << 22


def _texts_of(words: list[bytes], width: int, at: Iterable[int]) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in at}


class ItemIndex:
    """Sketches and shingles of one block of test items."""

    def __init__(self, items: list[tuple[object, bytes]], width: int, share: float):
        self.width, self.share = width, share
        shorter: dict[int, list[tuple[object, bytes]]] = {}
        for item_id, text in items:
            if 0 < (n := len(text.split())) < width:
                shorter.setdefault(n, []).append((item_id, text))
        self.shorter = [ItemIndex(own, n, share) for n, own in sorted(shorter.items())]
        items = [(item_id, text) for item_id, text in items if len(text.split()) >= width]
        self.ids, self.texts, self.need, partitions, pairs = [], [], [], [], []
        column = pa.array([text.decode() for _, text in items], pa.string())
        for (item_id, text), shingles in zip(items, Words(column).shingles(width), strict=True):
            words = text.lower().split()
            shingles = np.unique(shingles)
            n = len(shingles)
            need = -(-n * round(share * 1000) // 1000)
            self.texts.append(_texts_of(words, width, range(len(words) - width + 1)))
            self.need.append(need)
            self.ids.append(item_id)
            partitions.append(n.bit_length())
            sketch = n - need + 1  # np.unique sorts: these are the smallest hashes
            pairs += [(h, len(self.ids) - 1, i < sketch) for i, h in enumerate(shingles.tolist())]
        pairs.sort()
        self.hash = np.array([p[0] for p in pairs], dtype=np.uint64)
        self.item = np.array([p[1] for p in pairs], dtype=np.int64)
        self.in_sketch = np.array([p[2] for p in pairs], dtype=bool)
        self.partition = np.array(partitions, dtype=np.int64)
        self.bits = np.zeros(_BITS, dtype=bool)
        self.bits[self.hash & np.uint64(_BITS - 1)] = True

    def matches(self, words: Words, column: pa.Array) -> Iterator[list[tuple[object, int, int]]]:
        """(item_id, n_item, n_found) of the items that each text contains."""
        for found in zip(*(index._matches(words, column) for index in [self, *self.shorter]), strict=True):
            yield [match for of_width in found for match in of_width]

    def _matches(self, words: Words, column: pa.Array) -> Iterator[list[tuple[object, int, int]]]:
        for i, shingles in enumerate(words.shingles(self.width)):
            at = np.flatnonzero(self.bits[shingles & np.uint64(_BITS - 1)])
            yield self._contained(column[i].as_py().encode(), shingles, at) if len(at) else []

    def _contained(self, text: bytes, shingles: np.ndarray, at: np.ndarray) -> list[tuple[object, int, int]]:
        first, last = np.searchsorted(self.hash, shingles[at], "left"), np.searchsorted(self.hash, shingles[at], "right")
        at, first, last = at[last > first], first[last > first], last[last > first]
        rows = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])) if len(at) else at
        probed = self.item[rows[self.in_sketch[rows]]] if len(rows) else rows
        if not len(probed):
            return []
        large_enough = (1 << (self.partition[probed] - 1)) * self.share <= len(shingles)
        found = _texts_of(text.lower().split(), self.width, at)
        out = []
        for item in np.unique(probed[large_enough]).tolist():
            n_found = len(self.texts[item] & found)
            if n_found >= self.need[item]:
                out.append((self.ids[item], len(self.texts[item]), n_found))
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, width: int, share: float, block_bytes: int) -> Iterator[ItemIndex]:
    """Indexes of blocks of about ``block_bytes`` of text, read to the driver one block at a time."""
    narrow = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    size = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    blocked = narrow.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    for b in range(n):
        yield ItemIndex([(r["id"], r["text"].encode()) for r in blocked.filter(F.col("block") == b).collect()], width, share)


def _matches_of_all(shared: list[Broadcast], column: pa.Array) -> list[list[tuple[object, int, int]]]:
    """The matches of each text with the items of several blocks."""
    words = Words(column)
    return [[m for found in of_text for m in found] for of_text in zip(*(index.value.matches(words, column) for index in shared), strict=True)]


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    share: float = 0.8,
    block_bytes: int = 4_000_000,
    blocks_per_pass: int = 8,
) -> DataFrame:
    """doc_id, item_id, n_item, n_found, containment: a row for each document and item it contains.

    Null and empty texts contain nothing and are contained in nothing; an item of fewer than
    ``width`` words is one shingle, found in any document that has these words in a row; null ids and
    repeated rows are kept; empty tables give no rows. Other columns are not read. After each
    pass but the last its matches are written, so that only ``blocks_per_pass`` blocks are broadcast at once.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc_type = narrow.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema[item_id_col].dataType
    blocks = item_blocks(items, item_id_col, item_text_col, width, share, block_bytes)
    found, held = None, []
    for indexes in batched(blocks, blocks_per_pass):
        if found is not None:
            found = cut(found)
            for old in held:
                old.destroy()
        held = shared = [docs.sparkSession.sparkContext.broadcast(index) for index in indexes]

        def search(rows: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches(rows):
                hits = [(i, *m) for i, of_text in enumerate(_matches_of_all(shared, batch.column(1))) for m in of_text]
                if hits:
                    at, ids, n_item, n_found = map(list, zip(*hits, strict=True))
                    columns = [batch.column(0).take(pa.array(at)), pa.array(ids, to_arrow_type(item_kind)), pa.array(n_item, pa.int64()), pa.array(n_found, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_item", "n_found"])

        rows = narrow.mapInArrow(search, f"doc_id {doc_type}, item_id {item_kind.simpleString()}, n_item bigint, n_found bigint")
        found = rows if found is None else found.unionAll(rows)
    return found.withColumn("containment", F.col("n_found") / F.col("n_item"))


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    share: float = 0.8,
    block_bytes: int = 4_000_000,
    blocks_per_pass: int = 8,
) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item; no shuffle.

    Null and empty texts stay, and as items match nothing; null ids and repeated rows are judged row by row;
    an empty table of documents gives no rows, one of items all of them; columns of any name pass through.
    After each pass but the last what is left is written, so that only ``blocks_per_pass`` blocks are broadcast at once.
    """
    at, held = docs.columns.index(text_col), []
    for indexes in batched(item_blocks(items, item_id_col, item_text_col, width, share, block_bytes), blocks_per_pass):
        if held:
            docs = cut(docs)
            for old in held:
                old.destroy()
        held = shared = [docs.sparkSession.sparkContext.broadcast(index) for index in indexes]

        def clean(rows: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches(rows):
                yield batch.filter(pa.array([not found for found in _matches_of_all(shared, batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


#: Matches in DuckDB SQL over `documents` and `benchmark`: windows of min(5, its words) of each item.
CONTAINMENT_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(5, len(ws)) AS k, unnest(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' '))) AS w FROM b WHERE len(ws) > 0),
ds AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS w
  FROM d JOIN (SELECT DISTINCT k FROM bs) ON len(ws) >= k),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (k, w) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_found, CAST(n_found AS DOUBLE) / n_item AS containment
FROM hit JOIN n USING (item_id) WHERE 1000 * n_found >= 800 * n_item
"""
