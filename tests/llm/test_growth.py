"""What the corpus operators hold in one task, on hot keys, repeated rows and long texts."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import language_model, mixing, sharding, toxicity

from .test_operators import SF, plain_scores, table

duckdb = pytest.importorskip("duckdb")


def small(monkeypatch, batch=20_000, block=60_000):
    monkeypatch.setattr(language_model, "_BATCH", batch)
    monkeypatch.setattr(language_model, "_BLOCK", block)


def test_blocks_grow_with_their_entries(spark, monkeypatch):
    """Copies of the table under other words: entries of a block stay, so does what it sends, while batches multiply."""
    small(monkeypatch)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bytes_sent, most_docs = [], []
    for copies in (1, 2, 4):
        many = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        many = many.select((F.col("doc_id") * 10 + F.col("copy")).alias("doc_id"), F.regexp_replace("text", r"(\S)(\s|$)", F.concat(F.lit("$1x"), F.col("copy"), F.lit("$2"))).alias("text"))
        named = many.withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)).cast("int")).repartition(2)
        model = language_model._frequent(named, 40, 5)
        model.weights, model.c_pair = np.full((33, 3), 1 / 3), np.zeros((6, 5))
        n_blocks = model.n // 60_000
        rows = language_model._blocks(named, model, n_blocks, score=True).collect()
        assert len(rows) == len({(r.batch, r.block) for r in rows}) and sum(len(r.ids or []) for r in rows) == many.count()
        entries = [language_model._unpacked(bytes(r.entries), language_model._KINDS) for r in rows]
        sent = sum(len(e[f"{k}k"]) for e in entries for k in "htux")
        assert len(rows) <= sent
        bytes_sent.append(sum(len(r.entries) for r in rows) / sum(sum(map(len, (e["hk"], e["tk"], e["uk"], e["xk"]))) for e in entries))
        # Sums and ids of the batches are dealt over the blocks.
        own = Counter()
        for r in rows:
            own[r.block] += len(r.ids or [])
        most_docs.append(max(own.values()) / many.count())
        if n_blocks > 3:
            assert len([b for b in own if own[b]]) > 1
    assert max(bytes_sent) < 1.1 * min(bytes_sent)
    assert most_docs[-1] < most_docs[0]


def test_a_block_is_worked_on_in_small_parts(spark, monkeypatch):
    """What a task makes of a block's entries is bounded beside them, and a key's entries stay together."""
    monkeypatch.setattr(language_model, "_PART", 5_000, raising=False)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = docs.select("doc_id", "text", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)).cast("int").alias("fold")).repartition(3)
    model = language_model._frequent(named, 400, 5)
    model.weights, model.c_pair = np.full((33, 3), 1 / 3), np.zeros((6, 5))
    block = language_model._blocks(named, model, 1, score=True).select("batch", "entries").toArrow()
    whole = [language_model._unpacked(x, language_model._KINDS) for x in block.column("entries").to_pylist()]
    n, seen, sizes = sum(len(e[f"{k}k"]) for e in whole for k in "htux"), {k: [] for k in "htux"}, []
    tracemalloc.start()
    try:
        for g in language_model._gathered(block):
            counts = language_model._known_counts(model, g)
            sizes.append(len(counts["n"]))
            for k, keys in seen.items():
                keys.append(np.unique(g[f"{k}k"]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) == n > 50_000 and max(sizes) < 10_000
    assert all(len(np.unique(x := np.concatenate(keys))) == len(x) for keys in seen.values())
    assert peak < 3 * block.nbytes, peak / block.nbytes


def test_words_are_counted_in_few_copies():
    """A task's words are held some three times while they are counted, not eight times."""
    texts = pa.array([" ".join(f"w{(i * 7 + j) % 5_000}" for j in range(500)) for i in range(4_000)])
    found = []

    class Docs:  # takes the function that Spark would run
        select = groupBy = agg = lambda self, *a: self

        def mapInArrow(self, count, schema):
            batch = pa.RecordBatch.from_arrays([texts, pa.array([i % 10 for i in range(len(texts))], pa.int32())], names=["text", "fold"])
            tracemalloc.start()
            try:
                found.extend(count(iter([batch])))
                found.append(tracemalloc.get_traced_memory()[1])
            finally:
                tracemalloc.stop()
            return self

    language_model._count_words(Docs())
    *rows, peak = found
    assert sum(sum(r["c"].to_pylist()) for r in rows) == 501 * 3_600 and sum(sum(r["s"].to_pylist()) for r in rows) == 501 * 400
    assert len({w for r in rows for w in r["word"].to_pylist()}) == 5_001
    assert peak < 70_000_000, peak


@pytest.mark.parametrize("contexts", [40, 1 << 18])
def test_scores_over_many_batches_and_blocks(spark, monkeypatch, contexts):
    small(monkeypatch, 1_500, 2_500)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_scores([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.score for r in language_model.language_model_scores(docs, contexts=contexts, dense=5).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want)


def test_scores_of_named_and_nameless_rows(spark, monkeypatch):
    small(monkeypatch, 700, 900)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(None if i % 7 == 0 else f"name {i % 25}", None if i == 3 else "" if i == 4 else t) for i, t in enumerate(texts)]
    named = [("" if i is None else i, t) for i, t in rows]
    # One row for each row: a plain model wants distinct names, so those of one fold stand for each other.
    by_fold = {f: [f"{n}" for n in range(3_000) if zlib.crc32(str(n).encode()) % 10 == f] for f in range(10)}
    distinct = [(by_fold[zlib.crc32(i.encode()) % 10].pop(), t) for i, t in named]
    want = plain_scores(distinct)
    got = language_model.language_model_scores(spark.createDataFrame(rows, "doc_id string, text string"), contexts=40, dense=5).collect()
    assert sorted((r.doc_id or "", round(r.score, 5)) for r in got) == sorted((i, round(want[j], 5)) for (i, _), (j, _) in zip(named, distinct, strict=True))


def test_toxicity_learns_from_coordinates_in_shards_by_bytes(spark, monkeypatch):
    texts = [(i, ("vile " if i % 3 == 0 else "kind ") + " ".join(f"w{(i * j) % 97}" for j in range(400)), "a") for i in range(120)] + [(500, None, "a"), (501, "", "b")]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, *_ in texts] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    drawn = {r.doc_id: r for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit("order")).alias("o"), F.xxhash64("doc_id", F.lit("shard")).alias("s")).collect()}
    learned = sorted((r for r in texts if zlib.crc32(str(r[0]).encode()) % 5), key=lambda r: drawn[r[0]].o)
    found = {i: np.unique(next(toxicity.features(pa.array([t], pa.string())))) for i, t, _ in learned}
    n_bytes = sum(4 * len(f) for f in found.values())
    for most in (n_bytes, n_bytes // 3):
        monkeypatch.setattr(toxicity, "SHARD_BYTES", most)
        shards, want, want_bias = -(-n_bytes // most), np.zeros(1 << toxicity.BITS), 0.0
        for k in range(shards):
            own = [(found[i], int(i % 3 == 0)) for i, *_ in learned if drawn[i].s % shards == k]
            at, w, bias = toxicity.ftrl(own, 8, 2.5, 1.0, 0.1, 0.0)
            want[at] += w * len(own) / len(learned)
            want_bias += bias * len(own) / len(learned)
        at, w, bias = toxicity.train(docs, labels, l1=0.1)
        assert len(at) and np.array_equal(at, np.flatnonzero(want)) and np.allclose(w, want[at]) and math.isclose(bias, want_bias)


def test_repeated_rows_spread_over_cells(spark, monkeypatch):
    rows = [(7, "the same text", "a")] * 1_500 + [(i, f"text {i}", "a") for i in range(500)]
    seen = {}
    real = sharding.cut

    def watched(df):
        out = real(df)
        seen.setdefault("sized", out)
        return out

    monkeypatch.setattr(sharding, "cut", watched)
    got = sharding.shard_by_bytes(table(spark, rows).repartition(3), rows_per_cell=50).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(t) + 1) for i, t, _ in rows)
    for k in range(8):
        own = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own))) and abs(sum(r["size"] for r in own) - sum(r["size"] for r in got) / 8) < 40
    cells = seen["sized"].filter("doc_id = 7").groupBy(F.pmod(F.xxhash64("_id", "size", "_hash", "_row"), F.lit(30))).count().collect()
    assert len(cells) == 30 and max(r["count"] for r in cells) < 120


def test_mix_of_rows_without_ids_equals_sql_over_many_salts(spark):
    rows = [(None, " ".join(f"w{i * j % 13}" for j in range(1 + i % 5)), "ab"[i % 2]) for i in range(400)] + [(i, "one two three", None) for i in range(60)]
    docs = table(spark, rows)
    got = mixing.mix_sources(docs, rows_per_salt=8, keep=("text",))
    assert got.select(F.sum("taken")).first()[0] > 0
    salts = docs.select(F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(""), mixing._draw(F.col("text")).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(58)).alias("s")).distinct().count()
    assert salts > 10
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(mixing.MIX_SQL.replace("16384.0", "8.0")).fetchall()
    key = lambda r: tuple((x is None, x if x is None or isinstance(x, str) else round(float(x), 6)) for x in r)
    assert sorted(map(key, want)) == sorted(key(tuple(r)[:7]) for r in got.collect())
