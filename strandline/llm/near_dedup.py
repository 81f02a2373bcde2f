"""MinHash near-deduplication (operator 6): one-permutation hashing, bands, stars.

1. Every text becomes its set of shingle hashes; texts with equal sets are one class, so copies
   never meet each other again. A class gets a one-permutation MinHash with optimal
   densification: the smallest hash in each of ``BINS`` bins, an empty bin copying a bin that a fixed
   random sequence of the bin's own number reaches first.
2. Bands of the signature are buckets. The hub of a bucket is its member that shares most bucket
   places with others (the text that a group of near copies derives from); candidate edges
   are the bucket's star around the hub, so a bucket of n members gives n - 1 of them.
3. Edges that the signatures and set sizes don't rule out are confirmed on the full sets, each
   member's most similar hub first; edges inside a component found so far need no test.
4. What stars leave over is searched exactly: where a hub's star still holds several components,
   members outside the largest one are compared with all others of the star on the full sets, in
   square chunks. In a large star where it is less work, only pairs that share one of their rarest
   shingles are compared: of two sets at the threshold t each has at most (1 - t) n shingles that the
   other lacks, so they meet in the first n - ceil(t n) + 1 of each, whatever the order. How many pairs
   that makes is counted before. Two texts that share a bucket are in its hub's star.

A class is named by a number of its own, so that texts that share a doc_id are told apart.

The number of rows per band is the largest at which a pair at the threshold shares no bucket with a
probability below 1e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, batches, cut, mix
from .components import components

BINS = 160
_TRIES = 64
#: Standard deviations by which a signature's estimate may fall short of the threshold.
_SIGMAS = 5.0
_CHUNK = 256
#: Stars of more members than this may be searched by their rarest shingles.
_LARGE_STAR = 1024
#: What a pair that is made and tested by itself costs, in pairs of a square chunk.
_PAIR_COST = 50


def _sequences() -> np.ndarray:
    """The bins that an empty bin tries, in order."""
    cell = np.arange(_TRIES * BINS, dtype=np.uint64) + np.uint64(1)
    return (mix(cell * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64).reshape(_TRIES, BINS)


_SEQUENCES = _sequences()


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted, non-empty set of 64-bit hashes."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    filled, first = np.unique(bins, return_index=True)
    full = np.zeros(BINS, dtype=bool)
    full[filled.astype(np.int64)] = True
    out = np.zeros(BINS, dtype=np.uint64)
    out[full] = shingles[first]
    empty = np.flatnonzero(~full)
    for tries in _SEQUENCES:
        if not len(empty):
            return out
        source = tries[empty]
        found = full[source]
        out[empty[found]] = out[source[found]]
        empty = empty[~found]
    where = np.flatnonzero(full)  # the next full bin, for sets so small that the tries ran out
    out[empty] = out[where[np.searchsorted(where, empty) % len(where)]]
    return out


def rows_per_band(percent: int) -> int:
    s = percent / 100
    return max(r for r in range(1, 17) if r == 1 or (1 - s**r) ** (BINS // r) < 1e-7)


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    n = BINS // rows
    parts = sig[: n * rows].reshape(n, rows)
    total = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows):
        total = (total ^ parts[:, i]) * np.uint64(0xC2B2AE3D27D4EB4F)
        total = total ^ (total >> np.uint64(29))
    return mix(total).view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signed(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, bands, sig (16 bits of each bin)."""
    n_bands = BINS // rows

    def sign(batch_rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batch_rows):
            sizes, digests, bands, sigs = [], [], [], []
            for shingles in map(np.unique, Words(batch.column(1)).shingles(width)):
                sizes.append(len(shingles))
                if len(shingles):
                    sig = signature(shingles)
                    digests.append(_digest(shingles))
                    bands.append(band_hashes(sig, rows))
                    sigs.append((sig & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
                else:
                    digests.append(None)
                    bands.append(np.empty(0, dtype=np.int64))
                    sigs.append(None)
            offsets = pa.array(np.cumsum([0, *(len(b) for b in bands)]), pa.int32())
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, dtype=np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, flat), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "bands", "sig"],
            )

    assert n_bands
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"doc_id {kind}, n_shingles bigint, digest binary, bands array<bigint>, sig binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """rep, shingles of ``docs`` (rep, digest, text): the rows whose set is the one of the digest."""

    def sets(batch_rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batch_rows):
            values = [np.unique(shingles) for shingles in Words(batch.column("text")).shingles(width)]
            own = pa.array([_digest(v) == d for v, d in zip(values, batch.column("digest").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([v.tobytes() for v in values], pa.binary())], names=["rep", "shingles"]).filter(own)

    return docs.select("rep", "digest", "text").mapInArrow(sets, "rep bigint, shingles binary")


def _agreement(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v, n_u, n_v, sig_u, sig_v) as u, v and the share of equal bins."""

    def agree(batch_rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batch_rows):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, BINS) for c in ("sig_u", "sig_v"))
            share = (a == b).mean(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), batch.column("n_u"), batch.column("n_v"), pa.array(share, pa.float64())], names=["u", "v", "n_u", "n_v", "share"])

    return pairs.mapInArrow(agree, "u bigint, v bigint, n_u bigint, n_v bigint, share double")


def _likely(share: Column, n: Column, percent: int) -> Column:
    s = percent / 100
    return share >= F.lit(s) - F.lit(_SIGMAS) * F.sqrt(F.lit(s * (1 - s)) / F.least(n, F.lit(BINS)))


def _comparable(percent: int) -> Column:
    return F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent


class _Search:
    """The classes of one table, and the tests on pairs of them."""

    def __init__(self, docs: DataFrame, width: int, percent: int, most_broadcast: int):
        self.docs, self.width, self.percent, self.most_broadcast = docs, width, percent, most_broadcast
        self.signed = cut(_signed(docs, width, rows_per_band(percent)))
        self.known = self.signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        first = lambda *names: [F.first(c).alias("n" if c == "n_shingles" else c) for c in names]
        classes = self.known.groupBy("digest").agg(F.min("doc_id").alias("first_id"), *first("n_shingles", "bands", "sig"))
        self.classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))

    def same_ids(self) -> DataFrame:
        """Edges (u, v) between the classes of rows that share a doc_id."""
        several = self.known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("doc_id")
        reps = self.known.join(several, "doc_id").select("doc_id", "digest").distinct().join(self.classes.select("digest", "rep"), "digest")
        return reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("v")), "doc_id").filter("rep <> v").select(F.col("rep").alias("u"), "v")

    def sets(self, reps: DataFrame) -> DataFrame:
        """rep and shingles of the classes named."""
        wanted = cut(reps.join(self.classes.select("rep", "first_id", "digest"), "rep"))
        named = F.broadcast(wanted) if wanted.count() <= self.most_broadcast else wanted
        return _sets(self.docs.join(named, F.col("doc_id") == F.col("first_id")), self.width).dropDuplicates(["rep"])

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose full sets are similar enough."""
        sets = self.sets(pairs.select(F.col("u").alias("rep")).unionAll(pairs.select("v")).distinct())
        both = pairs.select("u", "v").join(sets.toDF("u", "set_u"), "u").join(sets.toDF("v", "set_v"), "v")
        percent = self.percent

        def test(batch_rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(batch_rows):
                good = []
                for a, b in zip(batch.column("set_u").to_pylist(), batch.column("set_v").to_pylist(), strict=True):
                    a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                    common = len(a) + len(b) - len(np.union1d(a, b))
                    good.append(100 * common >= percent * (len(a) + len(b) - common))
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

        return both.select("u", "v", "set_u", "set_v").mapInArrow(test, "u bigint, v bigint").distinct()

    def with_signatures(self, pairs: DataFrame) -> DataFrame:
        c = self.classes.select("rep", "n", "sig")
        return pairs.join(c.toDF("u", "n_u", "sig_u"), "u").join(c.toDF("v", "n_v", "sig_v"), "v").filter(_comparable(self.percent))

    def likely(self, pairs: DataFrame) -> DataFrame:
        found = _agreement(self.with_signatures(pairs).select("u", "v", "n_u", "n_v", "sig_u", "sig_v"))
        return found.filter(_likely(F.col("share"), F.least("n_u", "n_v"), self.percent))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that join different components."""
    a, b = labels.toDF("u", "_cu"), labels.toDF("v", "_cv")
    return pairs.join(a, "u", "left").join(b, "v", "left").filter(F.coalesce("_cu", "u") != F.coalesce("_cv", "v")).drop("_cu", "_cv")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    sets = [*left, *right]
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(counts > 1) - 1  # what one set alone has is in no intersection
    shared = counts[where] > 1
    row, column = row[shared], column[where[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        part = slice(*np.searchsorted(column, (first, first + 4096)))
        marks = np.zeros((len(sets), 4096), dtype=np.float32)
        marks[row[part], column[part] - first] = 1
        out += marks[: len(left)] @ marks[len(left) :].T
    return out


def _left_over(search: _Search, stars: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (u, v) across components between members of one hub's star, from their full sets."""
    placed = stars.join(labels.toDF("u", "_c"), "u", "left").select(F.col("v").alias("hub"), F.col("u").alias("rep"), F.coalesce("_c", "u").alias("comp"))
    per_comp = placed.groupBy("hub", "comp").agg(F.count("*").alias("k"))
    mixed = per_comp.groupBy("hub").agg(F.sum("k").alias("n"), F.max("k").alias("top"), F.max_by("comp", "k").alias("major")).filter("top < n")
    rows = cut(placed.join(mixed, "hub"))
    large = rows.filter(F.col("n") > _LARGE_STAR)
    if large.isEmpty():
        return _squares(search, rows)
    prefix = cut(_rarest(search, large))
    pairs = prefix.groupBy("hub", "shingle").agg((F.count_if("minor") * F.count("*")).alias("pairs")).groupBy("hub").agg(F.sum("pairs").alias("pairs"))
    work = large.select("hub", "n", "top").distinct().join(pairs, "hub", "left").filter(F.coalesce("pairs", F.lit(0)) * _PAIR_COST <= (F.col("n") - F.col("top")) * F.col("n"))
    sparse = cut(work.select("hub"))
    return _squares(search, rows.join(sparse, "hub", "left_anti")).unionAll(_sharing(search, prefix.join(sparse, "hub", "left_semi"))).distinct()


def _rarest(search: _Search, rows: DataFrame) -> DataFrame:
    """hub, rep, comp, minor, size, shingle: of members of stars (hub, rep, comp, major) the shingles, rarest in the star first, that a partner must share one of."""

    def spread(batch_rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batch_rows):
            sets = [np.frombuffer(x, dtype=np.int64) for x in batch.column("shingles").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            size = pa.array(np.array([len(x) for x in sets], dtype=np.int64))
            columns = [*(batch.column(c).take(at) for c in ("hub", "rep", "comp", "minor")), size.take(at), pa.array(np.concatenate(sets) if sets else np.empty(0, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["hub", "rep", "comp", "minor", "size", "shingle"])

    sets = search.sets(rows.select("rep").distinct())
    members = rows.select("hub", "rep", "comp", (F.col("comp") != F.col("major")).alias("minor")).join(sets, "rep")
    terms = cut(members.select("hub", "rep", "comp", "minor", "shingles").mapInArrow(spread, "hub bigint, rep bigint, comp bigint, minor boolean, size bigint, shingle bigint"))
    often = terms.groupBy("hub", "shingle").agg(F.count("*").alias("freq")).filter("freq > 1")  # what one member alone has comes first and matches nothing
    member = W.partitionBy("hub", "rep")
    place = F.col("size") - F.count("*").over(member) + F.row_number().over(member.orderBy("freq", "shingle"))
    length = F.col("size") - F.ceil(F.col("size") * search.percent / 100) + 1
    return terms.join(often, ["hub", "shingle"]).withColumn("place", place).filter(F.col("place") <= length).drop("place", "freq")


def _sharing(search: _Search, prefix: DataFrame) -> DataFrame:
    """Links between members, one of them minor, that share a shingle of ``prefix``."""
    left, right = (prefix.select("hub", "shingle", F.col("rep").alias(a), F.col("comp").alias(f"c_{a}"), F.col("size").alias(f"n_{a}"), F.col("minor").alias(f"minor_{a}")) for a in "uv")
    met = left.filter("minor_u").join(right, ["hub", "shingle"]).filter("c_u <> c_v AND (NOT minor_v OR u < v)").filter(_comparable(search.percent))
    pairs = cut(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    return search.confirmed(search.likely(pairs).select("u", "v"))


def _squares(search: _Search, rows: DataFrame) -> DataFrame:
    """Links between members of stars (hub, rep, comp, n, top, major), the minor ones against all, in square chunks."""
    n_rows = rows.count()
    sets = search.sets(rows.select("rep").distinct())
    n_m, n_r = F.ceil(F.col("n") / _CHUNK), F.ceil((F.col("n") - F.col("top")) / _CHUNK)
    chunk = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    # Small stars travel together: a group holds some hundred rows or one square of chunks.
    pack = F.pmod(F.xxhash64("hub"), F.lit(max(1, n_rows // _CHUNK))).alias("pack")
    minor = rows.filter("comp <> major").select("hub", "rep", "comp", pack, F.lit(True).alias("minor"), chunk(n_r, "r").alias("a"), upto(n_m).alias("b"))
    every = rows.select("hub", "rep", "comp", pack, F.lit(False).alias("minor"), chunk(n_m, "m").alias("b"), upto(n_r).alias("a")).select(*minor.columns)
    percent = search.percent

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        out: set[tuple] = set()
        for _, g in group.groupby("hub", sort=False):
            left, right = g[g["minor"]], g[~g["minor"]]
            if not len(left) or not len(right):
                continue
            sets_l, sets_r = ([np.frombuffer(x, dtype=np.uint64) for x in side["shingles"]] for side in (left, right))
            common = _common(sets_l, sets_r)
            size_l, size_r = (np.array([len(x) for x in side], dtype=np.float64) for side in (sets_l, sets_r))
            good = 100 * common >= percent * (size_l[:, None] + size_r - common)
            good &= left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()
            rep_l, rep_r = left["rep"].to_numpy(), right["rep"].to_numpy()
            out |= {(min(rep_l[i], rep_r[j]), max(rep_l[i], rep_r[j])) for i, j in zip(*np.nonzero(good), strict=True)}
        return pd.DataFrame(sorted(out), columns=["u", "v"])

    chunks = minor.unionAll(every).join(sets, "rep")
    return chunks.groupBy("pack", "a", "b").applyInPandas(compare, "u bigint, v bigint").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    most_broadcast: int = 1_000_000,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``.

    Texts whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` or more
    are linked; a component's id is its smallest doc_id. A text of fewer words is one shingle. Null
    and empty texts, texts without words and rows without a doc_id are linked with nothing and kept
    (component_id is their doc_id). Rows that share a doc_id are linked, whatever their texts. An empty table
    gives no rows. Other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    search = _Search(narrow, width, percent, most_broadcast)

    places = search.classes.select("rep", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut(places.join(shared, "bucket").select("rep", "bucket", "n").distinct())
    score = members.groupBy("rep").agg(F.sum("n").alias("score"))
    scored = members.join(score, "rep")
    hubs = scored.groupBy("bucket").agg(F.max_by("rep", F.struct("score", F.xxhash64("rep"))).alias("v"))
    stars = cut(members.select(F.col("rep").alias("u"), "bucket").join(hubs, "bucket").filter("u <> v").select("u", "v").distinct())
    edges = cut(search.likely(stars))

    best = edges.withColumn("_r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("share"), "v"))).filter("_r = 1")
    links = cut(search.confirmed(best).unionAll(search.same_ids()))
    labels = cut(components(links))
    more = cut(search.confirmed(cut(_across(edges.join(best.select("u", "v"), ["u", "v"], "left_anti"), labels))))
    if more.count():
        links = links.unionAll(more)
        labels = cut(components(links))
    rest = cut(_left_over(search, stars, labels))
    if rest.count():
        labels = cut(components(links.unionAll(rest)))

    named = labels.toDF("rep", "_c").join(search.classes.select("rep", "first_id"), "rep")
    firsts = cut(named.groupBy("_c").agg(F.min("first_id").alias("component_id")))
    firsts = F.broadcast(firsts) if firsts.count() <= most_broadcast else firsts
    linked = labels.toDF("rep", "_c").join(firsts, "_c").select("rep", "component_id")
    of_class = search.classes.select("digest", "rep", "first_id").join(linked, "rep", "left").select("digest", F.coalesce("component_id", "first_id").alias("component_id"))
    found = search.signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, most_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component: its smallest doc_id.

    Of rows that repeat a doc_id the one with the largest hash of the text stays; rows without a doc_id and rows
    without words stay; an empty table gives no rows; columns of any name and ids of any type pass through.
    """
    named = docs.toDF(*(f"_in{i}" for i in range(len(docs.columns))))
    own_id, own_text = (F.col(f"_in{docs.columns.index(c)}") for c in (id_col, text_col))
    plain = named.select(own_id.alias("doc_id"), own_text.alias("text"))
    dropped = cut(near_duplicates(plain, width=width, percent=percent, most_broadcast=most_broadcast).filter("NOT kept").select(F.col("doc_id").alias("_dropped")).distinct())
    small = lambda df: F.broadcast(df) if df.count() <= most_broadcast else df
    kept = named.join(small(dropped), own_id == F.col("_dropped"), "left_anti")
    repeated = cut(plain.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_repeated")))
    if not repeated.isEmpty():
        again = kept.join(small(repeated), own_id == F.col("_repeated"), "left_semi")
        once = again.groupBy(own_id.alias("_id")).agg(F.max_by(F.struct(*named.columns), F.xxhash64(own_text)).alias("_row")).select("_row.*")
        kept = kept.join(small(repeated), own_id == F.col("_repeated"), "left_anti").unionAll(once)
    return kept.toDF(*docs.columns)


def shingle_links_sql(width: int, percent: int) -> str:
    """Components in DuckDB SQL over `documents`, from all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')) END) AS w FROM t WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.w = b.w AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= {percent} * (a.n + b.n - k)),
r AS (SELECT u AS node, u AS reach FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component, t.doc_id) AS component_id,
       t.doc_id = coalesce(c.component, t.doc_id) AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN c ON c.node = t.doc_id
"""
