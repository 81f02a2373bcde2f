"""Language-model scoring by deleted interpolation (operator 10).

p(w | v) = a[b] * c(v, w) / c(v) + m[b] * c(w) / N + z[b] / (V + 1), where b is the bucket of the
context's frequency c(v), and the mixture weights (a, m, z)[b] are found by expectation-maximisation
on held-out counts: those of one training document in nine, taken out of the counts meanwhile.

Every word and the start of a text is a history of its own. Nothing is cut off: every distinct word
has its exact count, every pair of context and word too. The counts of the ``contexts`` most frequent words
are broadcast; those of the others, the rare ones, are found in blocks, with the same result.

Jobs, each a pass over the texts:
1. counts of words (64-bit hashes), summed by key; the frequent ones are broadcast;
2. pairs of two of the ``dense`` most frequent words, as rows of a small matrix, and the histogram
   for the weights, from the held-out counts of all words;
3. every other pair goes, with its document's place in a batch, to a block of keys. A block sees all
   occurrences of its pairs and so knows their counts; it sends a partial sum back for each document of
   a batch that it has an entry of. Pairs that are frequent everywhere are in the matrix and are scored where they stand;
4. pairs of two rare words meet the context's count in a second block, to which the first sends both.

What a block holds grows with its entries alone: documents that it has no entry of have no place in it, and the
sums that a batch knows itself travel with a block of their own choice, so that blocks share them evenly. A batch
sends a row to each block that gets an entry of it: batches times blocks at first, and never more rows than entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Words, batches, crc32_of, mix

_END = np.uint64(0x656E64)  # stands for the end of a text
_BATCH = 1_000_000
_BLOCK = 3_000_000
_PART = 1 << 17  # entries of a block, or tokens of a batch, that are worked on at once
_CLASSES = 33  # 32 of frequency, start
_LEAST = 1e-6
_STEP = 40  # histogram steps for a factor of ten
_NONE = -99_999

_KINDS = {
    "hk": np.uint64, "hd": np.uint32, "hn": np.uint32,  # both frequent
    "tk": np.uint64, "tc": np.uint32, "td": np.uint32, "tn": np.uint32,  # a rare word
    "uk": np.uint64, "uc": np.uint32, "ud": np.uint32, "un": np.uint32,  # a rare context (key)
    "xk": np.uint64, "xc": np.uint64, "xd": np.uint32, "xn": np.uint32,  # both rare
}
_SECOND = {
    "wk": np.uint64, "wc": np.int64, "ws": np.int64,  # counts of rare words
    "xv": np.uint64, "cp": np.int64, "sp": np.int64, "cw": np.int64, "sw": np.int64, "xd": np.uint32, "xn": np.uint32, "xb": np.int64,  # pairs of two
}
_SUMS = {"dd": np.uint32, "db": np.float64, "ds": np.float64, "dn": np.float64}  # documents of a batch: base, score, known words


def _tokens(column: pa.Array) -> Iterator[np.ndarray]:
    """The hashed words and the end of each text."""
    words = Words(column)
    tokens = np.insert(words.hashes, words.offsets[1:], _END)
    yield from np.split(tokens, words.offsets[1:-1] + np.arange(1, len(column)))


def _role(fold: int) -> int:
    """0: only scored; 1: training, held out for the weights; 2: training."""
    return min(fold, 2)


def _slices(n: int) -> Iterator[slice]:
    yield from (slice(i, i + _PART) for i in range(0, n, _PART))


def _bin(counts: np.ndarray) -> np.ndarray:
    return np.where(counts < 1024, counts, 1024 + (np.log2(np.maximum(counts, 1)) * 64).astype(np.int64))


def _class(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), 31)


class Frequent:
    """The broadcast part of the model: frequent words and the totals."""

    def __init__(self, words: np.ndarray, c: np.ndarray, s: np.ndarray, n: int, n_held: int, v: int, docs: int, docs_held: int, dense: int):
        order = np.lexsort((words, -c))  # the most frequent first; the end of a text is always there
        order = np.concatenate([order[words[order] == _END], order[words[order] != _END]])
        self.c, self.s, words = c[order], s[order], words[order]
        by_hash = np.argsort(words)
        self.hash, self.place = words[by_hash], by_hash
        self.n, self.n_held, self.v = n, n_held, v
        self.k, self.dense = len(words), min(dense, len(words))
        self.start = self.k
        self.c_context = np.append(self.c, docs).astype(np.float64)
        self.s_context = np.append(self.s, docs_held).astype(np.float64)
        self.classes = _class(self.c_context)
        self.classes[self.start] = 32
        self.c_pair = self.s_pair = self.weights = None

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token among the frequent words, or -1."""
        out = np.full(len(tokens), -1, dtype=np.int32)
        for part in _slices(len(tokens) if self.k else 0):
            at = np.minimum(np.searchsorted(self.hash, tokens[part]), self.k - 1)
            out[part] = np.where(self.hash[at] == tokens[part], self.place[at], -1)
        return out

    def dense_row(self, context: np.ndarray) -> np.ndarray:
        """Row of the matrix of a context, or -1; the start is the last."""
        return np.where((context >= 0) & (context < self.dense), context, np.where(context == self.start, self.dense, -1))

    def log10(self, c_pair: np.ndarray, c_context: np.ndarray, classes: np.ndarray, c_word: np.ndarray) -> np.ndarray:
        a, m, z = self.weights[classes].T
        return np.log10(a * c_pair / np.maximum(c_context, 1) + m * c_word / max(self.n, 1) + z / (self.v + 1))

    def base(self, c_word: np.ndarray) -> np.ndarray:
        return np.log10((c_word + 0.1) / (self.n + 0.1 * (self.v + 1)))


def _counted(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and their counts; empties the list, so that the words are there once."""
    words = np.concatenate([np.empty(0, dtype=np.uint64), *texts])
    texts.clear()
    words.sort()
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.empty(0, dtype=np.int64)
    return words[first], np.diff(np.append(first, len(words)))


def _count_words(docs: DataFrame) -> DataFrame:
    """word, c (training), s (of these, held out), summed over all texts."""

    def count(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}
        size = 0

        def flush() -> pa.RecordBatch:
            (words_1, c_1), (words_2, c_2) = (_counted(held[role]) for role in (1, 2))
            values, where = np.unique(np.concatenate([words_1, words_2]), return_inverse=True)
            c = np.bincount(where, weights=np.concatenate([c_1, c_2])).astype(np.int64)
            s = np.bincount(where[: len(c_1)], weights=c_1, minlength=len(values)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(c), pa.array(s)], names=["word", "c", "s"])

        for batch in batches(rows):
            for tokens, fold in zip(_tokens(batch.column("text")), batch.column("fold").to_pylist(), strict=True):
                if role := _role(fold):
                    held[role].append(tokens)
                    size += len(held[role][-1])
                    if size > 4 * _BATCH:
                        size = 0
                        yield flush()
        if size:
            yield flush()

    return docs.select("text", "fold").mapInArrow(count, "word bigint, c bigint, s bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))


def _frequent(docs: DataFrame, contexts: int, dense: int) -> Frequent:
    counts = _count_words(docs).persist(StorageLevel.DISK_ONLY)
    try:
        binned = counts.withColumn("bin", F.when(F.col("c") < 1024, F.col("c")).otherwise(1024 + F.floor(F.log2("c") * 64)))
        bins = binned.groupBy("bin").agg(F.count("*").alias("v"), F.sum("c").alias("c"), F.sum("s").alias("s")).orderBy(F.desc("bin")).collect()  # under 6000 rows
        least, so_far = 1 << 40, 0
        for b in bins:
            so_far += b["v"]
            if so_far > contexts:
                break
            least = b["bin"]
        head = binned.filter((F.col("bin") >= least) | (F.col("word") == int(_END))).select("word", "c", "s").toPandas()  # at most `contexts` rows and one
    finally:
        counts.unpersist()
    roles = docs.agg(F.count(F.when(F.col("fold") > 0, 1)), F.count(F.when(F.col("fold") == 1, 1))).first()
    n, n_held, v = (sum(b[k] for b in bins) for k in ("c", "s", "v"))
    return Frequent(head["word"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64), head["s"].to_numpy(np.int64), n, n_held, v, roles[0], roles[1], dense)


def _runs(key: np.ndarray, doc: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Entries in the order of the mixed key, those of one key and document made one."""
    mixed = mix(key if more is None else key ^ (more.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(mixed, kind="stable")
    mixed, key, doc, more = mixed[order], key[order], doc[order], None if more is None else more[order]
    if not len(key):
        return key, doc, np.empty(0, dtype=np.uint16), key, more
    new = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    if more is not None:
        new |= more[1:] != more[:-1]
    first = np.flatnonzero(np.concatenate([[True], new]))
    n = np.diff(np.append(first, len(key)))
    return key[first], doc[first], n.astype(np.uint32), mixed[first], None if more is None else more[first]


#: Columns in the order of their hash.
_SORTED = ("tk", "uk", "xk")


def _steps(values: np.ndarray) -> np.ndarray:
    """Each value less the one before it; the sum of unsigned steps is the value again."""
    return np.diff(values, prepend=np.zeros(1, dtype=values.dtype))


def _packed(columns: dict[str, np.ndarray], kinds: dict[str, type]) -> bytes:
    """The columns as one value: the lengths by first letter, then each byte by byte, all its lowest bytes first: high bytes are mostly zero and compress."""
    lengths = {name[0]: len(columns[name]) for name in kinds}
    planes = (columns[name].view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes() for name, kind in kinds.items())
    return np.array(list(lengths.values()), dtype=np.uint32).tobytes() + b"".join(planes)


def _unpacked(data: bytes, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    letters = list(dict.fromkeys(name[0] for name in kinds))
    lengths = dict(zip(letters, np.frombuffer(data, dtype=np.uint32, count=len(letters)).tolist(), strict=True))
    at, out = 4 * len(letters), {}
    for name, kind in kinds.items():
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, dtype=np.uint8, count=lengths[name[0]] * size, offset=at).reshape(size, -1)
        out[name] = np.ascontiguousarray(planes.T).view(kind).ravel()
        at += planes.size
    return out


def _by_key(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys and the sums of each of the values."""
    where, distinct = pd.factorize(keys)
    return distinct, [np.bincount(where, weights=v, minlength=len(distinct)) for v in values]


def _blocks(docs: DataFrame, model: Frequent, n_blocks: int, score: bool) -> DataFrame:
    """Rows for the blocks; with ``score`` all pairs and the sums known on the spot, else what the weights need."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def own_sums(m: Frequent, doc: np.ndarray, lengths: np.ndarray, place: np.ndarray, context: np.ndarray, row: np.ndarray, on_spot: np.ndarray) -> np.ndarray:
        """Base, score, tokens and known words of each document of a batch, as far as the broadcast counts tell."""
        sums = np.zeros((4, len(lengths)))
        sums[2] = lengths
        for part in _slices(len(doc)):
            first = doc[part][0]  # documents lie in order
            at, spot, known = doc[part] - first, on_spot[part], place[part] >= 0
            c_word = np.where(known, m.c[place[part]], 0).astype(np.float64) if m.k else np.zeros(len(at))
            lp = np.zeros(len(at))
            pair = row[part][spot], place[part][spot], context[part][spot]
            lp[spot] = m.log10(m.c_pair[pair[0], pair[1]], m.c_context[pair[2]], m.classes[pair[2]], c_word[spot])
            for i, w in ((0, np.where(known, m.base(c_word), 0)), (1, lp), (3, known & (c_word > 0))):
                here = np.bincount(at, weights=w)
                sums[i, first : first + len(here)] += here
        return sums

    def emit(m: Frequent, batch_id: int, texts: list[np.ndarray], roles: list[int], ids: pa.Array | None) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(t) for t in texts])
        tokens = np.concatenate(texts)
        doc = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)
        texts.clear()  # the caller's list: they are in ``tokens`` now
        role = np.repeat(np.array(roles, dtype=np.uint32), lengths)
        place = m.places(tokens)
        context = np.roll(place, 1)
        context[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = m.start
        row = m.dense_row(context).astype(np.int32)
        on_spot = (row >= 0) & (place >= 0) & (place < m.dense)
        known = place >= 0
        tail = ~known
        sums = None
        if score:
            sums = own_sums(m, doc, lengths, place, context, row, on_spot)
            sent = ~on_spot
        else:
            if m.dense:
                train = on_spot & (role > 0)
                cell = row * m.dense + place
                c = np.bincount(cell[train], minlength=(m.dense + 1) * m.dense).astype(np.uint32).reshape(m.dense + 1, m.dense)
                s = np.bincount(cell[train & (role == 1)], minlength=(m.dense + 1) * m.dense).astype(np.uint32).reshape(m.dense + 1, m.dense)
                for r in np.flatnonzero(c.any(axis=1)).tolist():
                    yield _row(batch_id, -1 - r, c[r].tobytes() + s[r].tobytes())
            sent = ~on_spot & (role > 0)
            doc = np.zeros_like(doc)  # the weights need counts, not documents
        # Of a rare word, whether the second block of its own pairs with rare words asks for its count.
        asked = tail & np.roll(tail, -1) & (score | (role == 1))
        tag = (doc << np.uint32(3)) | (asked.astype(np.uint32) << np.uint32(2)) | role
        del doc, role, row, on_spot, asked
        rare_context = context < 0
        before = np.roll(tokens, 1)
        h, t, u, x = sent & known & ~rare_context, sent & tail & ~rare_context, sent & known & rare_context, sent & tail & rare_context
        key = (place[h].astype(np.uint64) << np.uint64(32)) | context[h].astype(np.uint64)
        hk, hd, hn, h_mixed, _ = _runs(key, tag[h])
        # A rare word's pairs stay together, on either side: its own count is found in its block.
        runs = {"t": _tail_runs(tokens[t], tag[t], context[t].astype(np.uint32)), "u": _tail_runs(before[u], tag[u], place[u].astype(np.uint32)), "x": _tail_runs(tokens[x], tag[x], before[x])}
        del tokens, tag, place, context, before, known, tail, rare_context, sent, key, h, t, u, x
        columns, cuts = {"hk": hk, "hd": hd, "hn": hn}, {"h": h_mixed}
        for kind, (key, of_doc, n, cuts[kind], other) in runs.items():
            columns |= {f"{kind}k": key, f"{kind}c": other, f"{kind}d": of_doc, f"{kind}n": n}
        block_of = {kind: _block_of(mixed, n_blocks) for kind, mixed in cuts.items()}
        home = int(mix(np.array([batch_id], dtype=np.uint64))[0]) % n_blocks  # takes the sums along
        own_block = np.full(int(score), home, dtype=np.uint64)
        present = np.unique(np.concatenate([*block_of.values(), own_block]))  # only blocks that get an entry, and that of the sums
        cuts = {kind: (np.searchsorted(b, present, "left"), np.searchsorted(b, present, "right")) for kind, b in block_of.items()}
        for i, b in enumerate(present.tolist()):
            own = {kind: slice(low[i], high[i]) for kind, (low, high) in cuts.items()}
            parts = {name: _steps(values[own[name[0]]]) if name in _SORTED else values[own[name[0]]] for name, values in columns.items()}
            with_sums = (sums.tobytes(), ids) if score and b == home else ()
            yield _row(batch_id, b, _packed(parts, _KINDS), *with_sums)

    def _row(batch_id: int, block: int, entries: bytes, sums: bytes | None = None, ids: pa.Array | None = None) -> pa.RecordBatch:
        columns = [pa.array([batch_id], pa.int64()), pa.array([block], pa.int64()), pa.array([entries], pa.binary())]
        if score:
            none = pa.array([None], pa.list_(id_type))
            columns += [pa.array([sums], pa.binary()), none if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
        return pa.RecordBatch.from_arrays(columns, names=["batch", "block", "entries", "sums", "ids"][: len(columns)])

    def send(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        batch_id = TaskContext.get().partitionId() << 32
        texts, roles, ids, size = [], [], [], 0
        for batch in batches(rows):
            start = 0
            for i, (tokens, fold) in enumerate(zip(_tokens(batch.column("text")), batch.column("fold").to_pylist(), strict=True)):
                texts.append(tokens)
                roles.append(_role(fold))
                size += len(texts[-1])
                if size > _BATCH:
                    ids.append(batch.column("doc_id").slice(start, i + 1 - start))
                    yield from emit(m, batch_id, texts, roles, pa.concat_arrays(ids))
                    batch_id, texts, roles, ids, size, start = batch_id + 1, [], [], [], 0, i + 1
            ids.append(batch.column("doc_id").slice(start))
        if texts:
            yield from emit(m, batch_id, texts, roles, pa.concat_arrays(ids))

    id_kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(id_kind)
    return docs.select("doc_id", "text", "fold").mapInArrow(send, "batch bigint, block bigint, entries binary" + (f", sums binary, ids array<{id_kind.simpleString()}>" if score else ""))


def _dealt(rows: DataFrame, n_blocks: int) -> GroupedData:
    """The rows by (home, block), the blocks dealt in turn: by a hash, several blocks would meet in one task while others have none."""
    n = min(n_blocks, 20_000)
    return rows.withColumn("home", F.pmod("block", F.lit(n)).cast("int")).repartitionById(n, "home").groupBy("home", "block")


def _block_of(mixed: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((mixed >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)


def _tail_runs(key: np.ndarray, doc: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries in the order of the word's hash, which is as good as a mixed one, so that only its steps need be sent."""
    order = np.lexsort((context, key))
    key, doc, context = key[order], doc[order], context[order]
    if not len(key):
        return key, doc, np.empty(0, dtype=np.uint32), key, context
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (context[1:] != context[:-1])]))
    return key[first], doc[first], np.diff(np.append(first, len(key))).astype(np.uint32), key[first], context[first]


def _gathered(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
    """The entries of a block in parts of about ``_PART``, all entries of a key in the same one: what is made of them takes several times their bytes."""
    out, rows = {}, [_unpacked(x.as_buffer(), _KINDS) for x in table.column("entries")]
    for name, kind in _KINDS.items():
        parts = [row.pop(name) for row in rows]
        parts = [np.cumsum(x, dtype=kind) for x in parts] if name in _SORTED else parts
        out[name] = np.concatenate(parts)
        if name[1] == "k":
            out[f"{name[0]}_row"] = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    n_parts = max(1, -(-sum(len(out[f"{k}k"]) for k in "htux") // _PART))
    ends = {}
    for k in "htux":
        part = _part_of(out[f"{k}k"], n_parts)
        ends[k] = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n_parts))])
        order = np.argsort(part, kind="stable")
        for name in [x for x in out if x[0] == k]:
            out[name] = out[name][order]
    for i in range(n_parts):
        yield {name: values[ends[name[0]][i] : ends[name[0]][i + 1]] for name, values in out.items()}


def _part_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of each key, by its mixed low half: the high one has chosen the block. An Arrow value holds 2 GiB, so there are never 65,536 parts."""
    out = np.empty(len(keys), dtype=np.uint16)
    for part in _slices(len(keys)):
        out[part] = ((mix(keys[part]) & np.uint64(0xFFFFFFFF)) * np.uint64(n_parts)) >> np.uint64(32)
    return out


def _joined(found: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sums of several parts as one."""
    return _by_key(np.concatenate([keys for keys, _ in found]), [np.concatenate(x) for x in zip(*(values for _, values in found), strict=True)])


def _scored_block(m: Frequent, table: pa.Table, n_blocks: int) -> tuple[np.ndarray, list[np.ndarray], dict[int, bytes]]:
    """Row of ``table`` << 32 | document, in order; its base, score and known words; and what the second blocks need."""
    batch, pairs, found = table.column("batch").to_numpy(), [], []
    for g in _gathered(table):
        k = _known_counts(m, g)
        one_known = np.arange(len(k["n"])) < k["first"]  # the others are scored in the second block
        pairs.append(_for_second(g, k, batch, held=False))
        values = [
            np.where(k["rare"], k["n"] * m.base(k["c_word"]), 0),
            np.where(one_known, k["n"] * m.log10(k["c_pair"], k["c_context"], k["classes"], k["c_word"]), 0),
            np.where(k["rare"] & (k["c_word"] > 0), k["n"], 0),
        ]
        found.append(_by_key((k["row"].astype(np.int64) << 32) | (k["tag"] >> np.uint32(3)).astype(np.int64), values))
        if sum(len(keys) for keys, _ in found[1:]) > max(len(found[0][0]), _PART):
            found = [_joined(found)]
    place, sums = _joined(found)
    order = np.argsort(place)
    return place[order], [x[order] for x in sums], _to_second(pairs, n_blocks)


def _summed(keys: np.ndarray, n: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the training count of its key, and the part of it that is held out."""
    _, where = np.unique(keys, return_inverse=True)
    c = np.bincount(where, weights=n * (role > 0))
    s = np.bincount(where, weights=n * (role == 1))
    return c[where], s[where]


def _known_counts(m: Frequent, g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """c and s of pair, word and context of all entries of a block, kind by kind; those of two rare words, the last, lack the context's."""
    place, h_context = (g["hk"] >> np.uint64(32)).astype(np.int64), (g["hk"] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    role = {k: g[f"{k}d"] & np.uint32(3) for k in "htux"}
    hc, hs = _summed(g["hk"], g["hn"], role["h"])
    (tc, ts), (uc, us), (xc, xs) = (_summed(mix(g[f"{k}k"]) ^ mix(g[f"{k}c"].astype(np.uint64) + np.uint64(1)), g[f"{k}n"], role[k]) for k in "tux")
    # Each occurrence of a rare word is an entry of t or x, and its own pairs are in u or x.
    rare, rare_n, rare_tag = (np.concatenate([g[f"t{k}"], g[f"x{k}"]]) for k in "knd")
    words, where = np.unique(rare, return_inverse=True)
    c = np.bincount(where, weights=rare_n * ((rare_tag & np.uint32(3)) > 0), minlength=len(words))
    s = np.bincount(where, weights=rare_n * ((rare_tag & np.uint32(3)) == 1), minlength=len(words))
    asked = np.bincount(where, weights=(rare_tag >> np.uint32(2)) & np.uint32(1), minlength=len(words)) > 0
    t_at, x_at, u_at = where[: len(tc)], where[len(tc) :], np.searchsorted(words, g["uk"])
    t_context, u_place = g["tc"].astype(np.int64), g["uc"].astype(np.int64)
    none = np.zeros(len(xc))
    return {
        "c_pair": np.concatenate([hc, tc, uc, xc]), "s_pair": np.concatenate([hs, ts, us, xs]),
        "c_word": np.concatenate([m.c[place], c[t_at], m.c[u_place], c[x_at]]), "s_word": np.concatenate([m.s[place], s[t_at], m.s[u_place], s[x_at]]),
        "c_context": np.concatenate([m.c_context[h_context], m.c_context[t_context], c[u_at], none]),
        "s_context": np.concatenate([m.s_context[h_context], m.s_context[t_context], s[u_at], none]),
        "classes": np.concatenate([m.classes[h_context], m.classes[t_context], _class(c[u_at]), none.astype(np.int64)]),
        "n": np.concatenate([g[f"{k}n"] for k in "htux"]).astype(np.float64), "tag": np.concatenate([g[f"{k}d"] for k in "htux"]),
        "row": np.concatenate([g[f"{k}_row"] for k in "htux"]), "rare": np.repeat([False, True, False, True], [len(hc), len(tc), len(uc), len(xc)]),
        "first": len(hc) + len(tc) + len(uc), "words": words[asked], "c": c[asked], "s": s[asked],
    }


def _to_second(parts: list[dict[str, np.ndarray]], n_blocks: int) -> dict[int, bytes]:
    """Pairs of two rare words and the counts of such contexts, by the context's block."""
    whole = {name: np.concatenate([p.pop(name) for p in parts]) for name in _SECOND}
    to = {key: _block_of(mix(whole[key]), n_blocks).astype(np.int64) for key in ("wk", "xv")}
    order = {key: np.argsort(b, kind="stable") for key, b in to.items()}
    present = np.union1d(to["wk"], to["xv"])
    cuts = {key: [np.searchsorted(b[order[key]], present, side) for side in ("left", "right")] for key, b in to.items()}
    out = {}
    for i, b in enumerate(present.tolist()):
        at = {key: order[key][cuts[key][0][i] : cuts[key][1][i]] for key in to}
        out[b] = _packed({name: values[at["wk" if name[0] == "w" else "xv"]] for name, values in whole.items()}, _SECOND)
    return out


def _for_second(g: dict[str, np.ndarray], k: dict[str, np.ndarray], batch: np.ndarray, held: bool) -> dict[str, np.ndarray]:
    at = np.arange(k["first"], len(k["n"]))
    if held:
        at = at[(k["tag"][at] & np.uint32(3)) == 1]
    columns = {
        "wk": k["words"], "wc": k["c"], "ws": k["s"], "xv": g["xc"][at - k["first"]], "cp": k["c_pair"][at], "sp": k["s_pair"][at], "cw": k["c_word"][at], "sw": k["s_word"][at],
        "xd": k["tag"][at], "xn": k["n"][at], "xb": batch[k["row"][at]],
    }
    return {name: columns[name].astype(kind) for name, kind in _SECOND.items()}


def _met(table: pa.Table) -> dict[str, np.ndarray]:
    """The pairs of a second block with their contexts' counts, cc and sc."""
    rows = [_unpacked(x, _SECOND) for x in table.column("second").to_pylist()]
    g = {name: np.concatenate([row[name] for row in rows]) for name in _SECOND}
    order = np.argsort(g["wk"])  # a word has one block, so its count comes once
    at = order[np.searchsorted(g["wk"], g["xv"], sorter=order)]
    return g | {"cc": g["wc"][at].astype(np.float64), "sc": g["ws"][at].astype(np.float64)}


def _cells(m: Frequent, classes: np.ndarray, c_context: np.ndarray, s_context: np.ndarray, c_pair: np.ndarray, s_pair: np.ndarray, c_word: np.ndarray, s_word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histogram cells (class, step of the pair's estimate, step of the word's) and held-out counts."""

    def step(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.rint(_STEP * np.log10(np.maximum(p, 1e-300))), _NONE).astype(np.int64)

    pair = (c_pair - s_pair) / np.maximum(c_context - s_context, 1)
    word = (c_word - s_word) / max(m.n - m.n_held, 1)
    cells, where = np.unique(np.stack([classes, step(pair), step(word)], axis=1), axis=0, return_inverse=True)
    return cells, np.bincount(where.ravel(), weights=n, minlength=len(cells))


def fit_weights(cells: np.ndarray, n: np.ndarray, v: int, rounds: int = 40) -> np.ndarray:
    """Mixture weights of each class by expectation-maximisation; even ones where nothing was held out."""
    weights = np.full((_CLASSES, 3), 1 / 3)
    p = np.stack([np.where(cells[:, i] == _NONE, 0.0, 10.0 ** (cells[:, i] / _STEP)) for i in (1, 2)] + [np.full(len(cells), 1 / (v + 1))], axis=1)
    for _ in range(rounds):
        share = weights[cells[:, 0]] * p
        share /= share.sum(axis=1, keepdims=True)
        total = np.stack([np.bincount(cells[:, 0], weights=n * share[:, i], minlength=_CLASSES) for i in range(3)], axis=1)
        seen = total.sum(axis=1) > 0
        weights[seen] = np.maximum(total[seen] / total[seen].sum(axis=1, keepdims=True), _LEAST)
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def _fit(docs: DataFrame, m: Frequent) -> Frequent:
    """Fill in the matrix of pairs and the mixture weights."""
    n_blocks = max(1, m.n // _BLOCK)
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def reduce_block(key: tuple, table: pa.Table) -> pa.Table:
        if (block := key[1].as_py()) < 0:
            c, s = np.sum([np.frombuffer(x, dtype=np.uint32).reshape(2, -1) for x in table.column("entries").to_pylist()], axis=0, dtype=np.uint64)
            return rows_of([block], [0], [0], [0.0], c=[c.tobytes()], s=[s.tobytes()], to=block)
        parts, pairs = [], []
        batch = table.column("batch").to_numpy()
        for g in _gathered(table):
            k = _known_counts(shared.value, g)
            held = np.flatnonzero((k["tag"][: k["first"]] & np.uint32(3)) == 1)
            parts.append(_cells(shared.value, *(k[x][held] for x in ("classes", "c_context", "s_context", "c_pair", "s_pair", "c_word", "s_word", "n"))))
            pairs.append(_for_second(g, k, batch, held=True))
        cells, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        cells, where = np.unique(cells, axis=0, return_inverse=True)
        n = np.bincount(where.ravel(), weights=n, minlength=len(cells))
        out = [rows_of(*cells.T, n, to=-1 - block)]
        return pa.concat_tables(out + [rows_of([0], [0], [0], [0.0], to=b, second=[x]) for b, x in _to_second(pairs, n_blocks).items()])

    def rows_of(block: Iterable, pair: Iterable, word: Iterable, n: Iterable, to: int, **binary: list[bytes]) -> pa.Table:
        columns = {"block": pa.array(block, pa.int64()), "pair": pa.array(pair, pa.int64()), "word": pa.array(word, pa.int64()), "n": pa.array(n, pa.float64())}
        none = [None] * len(columns["n"])
        columns |= {name: pa.array(binary.get(name, none), pa.binary()) for name in ("c", "s", "second")}
        return pa.table(columns | {"to": pa.array([to] * len(none), pa.int64())})

    def second_block(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(["block", "pair", "word", "n", "c", "s"])
        g = _met(table)
        cells, n = _cells(shared.value, _class(g["cc"]), g["cc"], g["sc"], g["cp"], g["sp"], g["cw"], g["sw"], g["xn"])
        return rows_of(*cells.T, n, to=0).select(["block", "pair", "word", "n", "c", "s"])

    schema = "block bigint, pair bigint, word bigint, n double, c binary, s binary"
    found = _dealt(_blocks(docs, m, n_blocks, score=False), n_blocks).applyInArrow(reduce_block, f"{schema}, second binary, to bigint").groupBy("to").applyInArrow(second_block, schema)
    # At most dense + 1 rows of the matrix, and the cells of the histogram.
    rows = found.groupBy("block", "pair", "word").agg(F.sum("n").alias("n"), F.first("c").alias("c"), F.first("s").alias("s")).toPandas()
    m.c_pair, m.s_pair = np.zeros((m.dense + 1, m.dense)), np.zeros((m.dense + 1, m.dense))
    for r in rows[rows["block"] < 0].itertuples():
        m.c_pair[-1 - r.block], m.s_pair[-1 - r.block] = (np.frombuffer(x, dtype=np.uint64) for x in (r.c, r.s))
    cells, n = rows.loc[rows["block"] >= 0, ["block", "pair", "word"]].to_numpy(np.int64).reshape(-1, 3), rows.loc[rows["block"] >= 0, "n"].to_numpy(np.float64)
    if m.dense:
        r, w = np.nonzero(m.s_pair)
        context = np.where(r == m.dense, m.start, r)
        more, n_more = _cells(m, m.classes[context], m.c_context[context], m.s_context[context], m.c_pair[r, w], m.s_pair[r, w], m.c[w], m.s[w], m.s_pair[r, w])
        cells, n = np.concatenate([cells, more]), np.concatenate([n, n_more])
    m.weights = fit_weights(cells, n, m.v)
    return m


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contexts: int = 1 << 18, dense: int = 512) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of ``docs``.

    Rows whose crc32(doc_id) mod 10 is not 0 are learned from; remainder 1 is held out while the
    mixture weights are fitted. Null and empty texts are the end of a text alone; a null doc_id counts
    as an empty one in the fold; repeated rows count each time; an empty table gives no rows.
    Without training rows every count is 0. Other columns are not read.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("fold", F.pmod(crc32_of(F.col("doc_id")), F.lit(10)).cast("int"))
    model = _fit(named, _frequent(named, contexts, dense))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_blocks = max(1, model.n // _BLOCK)
    kind, id_type = named.schema["doc_id"].dataType.simpleString(), to_arrow_type(named.schema["doc_id"].dataType)
    rows = _blocks(named, model, n_blocks, score=True)

    types = {"batch": pa.int64(), "parts": pa.binary(), "sums": pa.binary(), "ids": pa.list_(id_type), "second": pa.binary(), "to": pa.int64()}

    def rows_with(n: int, columns: list[str], **known: object) -> pa.Table:
        """``n`` rows, null in the columns that are not given."""
        filled = {c: known.get(c, [None] * n) for c in columns}
        return pa.table({c: x.cast(types[c]) if isinstance(x, pa.ChunkedArray) else pa.array(x, types[c]) for c, x in filled.items()})

    def part_rows(batch: np.ndarray, doc: np.ndarray, columns: list[str], **values: np.ndarray) -> pa.Table:
        """A row with the partial sums of each batch, given in the order of batch and document."""
        at = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]])) if len(batch) else np.empty(0, dtype=np.int64)
        whole = {"dd": doc.astype(np.uint32), **values}
        parts = [_packed({name: x[a:b] for name, x in whole.items()}, _SUMS) for a, b in zip(at.tolist(), np.append(at[1:], len(batch)).tolist(), strict=True)]
        return rows_with(len(at), columns, batch=batch[at], parts=parts, to=-1 - batch[at])

    def score_block(key: tuple, table: pa.Table) -> pa.Table:
        batch = table.column("batch").to_numpy()
        place, (base, score, n_known), second = _scored_block(shared.value, table, n_blocks)
        here = part_rows(batch[place >> 32], place & 0xFFFFFFFF, list(types), db=base, ds=score, dn=n_known)
        own = table.select(["batch", "sums", "ids"]).filter(pc.is_valid(table.column("sums")))
        carried = rows_with(len(own), list(types), batch=own.column("batch"), sums=own.column("sums"), ids=own.column("ids"), to=-1 - own.column("batch").to_numpy())
        return pa.concat_tables([here, carried, *(rows_with(1, list(types), to=[b], second=[x]) for b, x in second.items())])

    partial_columns = ["batch", "parts", "sums", "ids"]

    def second_block(key: tuple, table: pa.Table) -> pa.Table:
        m = shared.value
        if key[0].as_py() < 0:
            ids, sums = whole_sums(table)
            return rows_with(1, partial_columns, batch=[-1 - key[0].as_py()], sums=[sums.tobytes()], ids=[ids])
        g = _met(table)
        lp = g["xn"] * m.log10(g["cp"], g["cc"], _class(g["cc"]), g["cw"])
        order = np.lexsort((g["xd"] >> np.uint32(3), g["xb"]))
        batch, doc, lp = g["xb"][order], (g["xd"] >> np.uint32(3))[order], lp[order]
        first = np.flatnonzero(np.concatenate([[True], (batch[1:] != batch[:-1]) | (doc[1:] != doc[:-1])])) if len(batch) else np.empty(0, dtype=np.int64)
        score = np.add.reduceat(lp, first) if len(batch) else lp
        none = np.zeros(len(first))
        return part_rows(batch[first], doc[first], partial_columns, db=none, ds=score, dn=none)

    def whole_sums(table: pa.Table) -> tuple[list, np.ndarray]:
        """The ids of a batch and its base, score, n_tokens and n_known, all parts added."""
        own = table.filter(pc.is_valid(table.column("sums")))
        sums = np.frombuffer(own.column("sums")[0].as_py(), dtype=np.float64).reshape(4, -1).copy()
        for data in table.column("parts").drop_null().to_pylist():
            part = _unpacked(data, _SUMS)
            for i, name in ((0, "db"), (1, "ds"), (3, "dn")):
                sums[i, part["dd"]] += part[name]  # a document comes once in a part
        return own.column("ids")[0].as_py(), sums

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        ids, sums = whole_sums(table)
        as_long = lambda x: pa.array(np.rint(x).astype(np.int64))
        base, score, n_tokens, n_known = sums
        return pa.table([pa.array(ids, id_type), as_long(n_tokens), as_long(n_known), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    schema = f"batch bigint, parts binary, sums binary, ids array<{kind}>"
    partial = _dealt(rows, n_blocks).applyInArrow(score_block, f"{schema}, second binary, to bigint").groupBy("to").applyInArrow(second_block, schema)
    scored = partial.groupBy("batch").applyInArrow(add_up, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    held_out = F.pmod(crc32_of(F.col("doc_id")), F.lit(10)) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
