"""Operators 11 to 13 against plain versions, and on awkward inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from strandline.llm import clustering, packing, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<double>, label int, cluster string, x int"


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:k]
    centroids = [x for _, x in start]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[nearest(x)[1]].append(x)
        for j, own in groups.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted((str(i), j, d) for i, x in kept for d, j in [nearest(x)]), centroids


def awkward_vectors(n, dims, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-1, 0, 1)) + rng.gauss(0, 0.02 if i % 3 else 0.5) for _ in range(dims)]) for i in range(n)]
    rows += [rows[0]] * 9 + [(None, rows[5][1]), (None, rows[6][1]), (n, None), (n + 1, [1.0] * (dims - 1)), (n + 2, []), (n + 3, [None] + [0.0] * (dims - 1)), (n + 4, [math.nan] + [0.0] * (dims - 1)), (n + 5, [math.inf] * dims)]
    return rows


@pytest.mark.parametrize("k,rounds,bits", [(5, 3, 2), (9, 2, 6), (400, 1, 4)])
def test_clusters_are_those_of_a_full_search(spark, k, rounds, bits):
    rows = awkward_vectors(150, 8, 1)
    want, centroids = plain_clusters(rows, k, rounds, 8)
    table = spark.createDataFrame([(i, v, None, "odd", 1) for i, v in rows], VECTORS).repartition(5)
    found, clusters = clustering.cluster_vectors(table, k=k, rounds=rounds, dims=8, bits=bits)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want
    assert clusters.centroids.tolist() == centroids
    report = clustering.clustering_report(table, k=k, rounds=rounds, dims=8, bits=bits).collect()
    by = Counter()
    for _, j, d in want:
        by[j] += d
    assert {(r.cluster, r.cluster_inertia, r.inertia) for r in report} == {(j, d, sum(by.values())) for j, d in by.items()}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest() for r in report)


def test_intervals_hold_and_leave_few_distances():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(0, 0.12, (4000, 64))).astype(np.int64)
    cells = clustering.Cells.fitted(len(x), x.min(0), x.max(0), x.sum(0), (x.astype(float) ** 2).sum(0), 6)
    clusters = clustering.Clusters(cells, x[:40])
    codes, tables = cells.codes(x), cells.tables(x[:40])
    exact = ((x[:, None] - x[None, :40]) ** 2).sum(2)
    found, computed = clusters.nearest(codes, x, tables)
    assert (found == exact.argmin(1)).all() and computed < 0.2 * exact.size
    own = ((x - cells.middle) ** 2).sum(1)
    bounds = sum(tables[i][codes[:, i]] for i in range(64)) + own[:, None]
    assert (bounds[:, :40] <= exact).all() and (exact <= bounds[:, 40:]).all()


def test_clusters_of_nothing_of_one_point_and_of_huge_numbers(spark):
    assert clustering.clustering_report(spark.createDataFrame([], VECTORS)).count() == 0
    same = spark.createDataFrame([(i, [0.5] * 64, 1, "", 0) for i in range(7)], VECTORS)
    assert {(r.cluster, r.distance) for r in clustering.clustering_report(same).collect()} == {(0, 0)}
    with pytest.raises(Exception, match="in size"):
        clustering.clustering_report(spark.createDataFrame([(1, [1e9] * 64, 1, "", 0)], VECTORS)).collect()


def plain_whitening(rows, components):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted(set(map(tuple, (x for _, x in kept))))
    n, s = len(fit), np.array(fit).sum(0)
    y = np.array(fit, dtype=np.longdouble) - s.astype(np.longdouble) / n
    values, axes = np.linalg.eigh((y.T @ y / n).astype(float))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviation = {i: sum((n * a - b) ** 2 for a, b in zip(x, s.tolist(), strict=True)) for i, x in kept}
    whitened = {i: ((np.array(x) - s / n) @ axes) / np.sqrt(values) for i, x in kept}
    return n, deviation, whitened, values / np.trace((y.T @ y / n).astype(float))


def test_whitening_equals_a_plain_one(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (300, 12)) @ rng.normal(0, 1, (12, 12)) + 50
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(40)]
    odd = [(2000, None), (2001, [1.0] * 11), (2002, [None] * 12), (2003, [math.nan] * 12)]
    table = spark.createDataFrame([(i, v, None, "odd", 1) for i, v in rows + odd], VECTORS).repartition(5)
    n, deviation, whitened, explained = plain_whitening(rows, 6)
    found = whitening.whitening_report(table, components=6).collect()
    assert len(found) == 6 * len(rows) and {r.n for r in found} == {n} and n == 300
    assert {r.vec_id: r.deviation for r in found} == deviation
    sign = {c: np.sign(next(r.whitened for r in found if r.vec_id == 7 and r.component == c) * whitened[7][c - 1]) for c in range(1, 7)}
    assert max(abs(r.whitened * sign[r.component] - whitened[r.vec_id][r.component - 1]) for r in found) < 1e-8
    assert max(abs(r.explained / explained[r.component - 1] - 1) for r in found) < 1e-9 and found[0].identity_error < 1e-9


@pytest.mark.parametrize("gaps", [[1e-3] * 20, [1e-9] * 20, [0.0] * 5 + [1.0] * 15, [1e-12] * 6 + [1e-6] * 7 + [1.0] * 7])
def test_refinement_of_clustered_eigenvalues(gaps):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(20, dtype=np.longdouble) - q.T @ q) / 2  # orthogonal in extended precision
    true = 1 + np.cumsum(np.array(gaps, dtype=np.longdouble))
    a = (q * true) @ q.T
    values, x = whitening.refine((a + a.T) / 2, np.linalg.eigh(a.astype(np.float32))[1])
    order = np.argsort(-true, kind="stable")
    assert np.abs(values - true[order]).max() < 1e-17 * float(np.abs(true).max()) * 40
    assert np.abs(x.T @ x - np.eye(20)).max() < 1e-17 * 40
    assert np.abs(a @ x - x * values).max() < 1e-17 * 400
    if min(gaps) >= 1e-9:  # single eigenvectors are defined
        q = q[:, order]
        assert np.abs(np.abs(np.einsum("ij,ij->j", q, x)) - 1).max() < 1e-15
        assert np.abs(q * np.sign(np.einsum("ij,ij->j", q, x)) - x).max() < 1e-16 / min(gaps)


def test_whitening_of_nothing_of_equal_and_of_flat_vectors(spark):
    of = lambda rows: spark.createDataFrame([(i, v, 1, "", 0) for i, v in rows], VECTORS)
    assert whitening.whitening_report(of([])).count() == 0
    assert whitening.whitening_report(of([(1, [0.5] * 4), (2, [0.5] * 4)])).count() == 0
    flat = whitening.whitening_report(of([(i, [float(i), 2.0 * i, 7.0]) for i in range(50)] + [(None, [1.0, 2.0, 7.0])])).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 51 and abs(flat[0].explained - 1) < 1e-12


def test_deviation_is_exact_or_null():
    model = whitening.Whitening(2, 1 << 40, np.array([5, 5]), [3, -7], np.ones(1), np.ones((2, 1)), np.ones(1))
    x = np.array([[5, 5], [6, 5], [5, 1 << 29]])
    assert model.deviations(x) == [3**2 + 7**2, None, None]
    small = whitening.Whitening(2, 10, np.array([5, 5]), [3, -7], np.ones(1), np.ones((2, 1)), np.ones(1))
    assert small.deviations(x[:2]) == [58, 7**2 + 7**2]


ODD = ["", " ", "  a", "a  b", "a \n b", "\n\n x\t y ", "don't 'tis  it's", "x" * 5000, "日本語 テキスト　全角 a", "a\x1cb \x85c   d", "tail   ", " 　 e", "é ​ z", "1 000 000", "<|endoftext|> a <|endoftext|>", "a" + " " * 9 + "b", "\r\n \r\n", "🙂 🙂🙂  x"]


def test_encoder_gives_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(packing, "_CHUNK", 64)
    file = path("byte_bpe_50k.json")
    tokenizer, encode, rng = Tokenizer.from_file(file), packing.encoder(file), random.Random(6)
    texts = ODD + ["^" * 300_000, " " * 200_000 + "a", "é" * 100_000, "日本" * 50_000, "\n" * 90_000, "a" * 400_000] + ["".join(rng.choice(ODD + [" ", "\n", "word", ".", "'s"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(0x20, 0x2FFF), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)))) for _ in range(rng.randrange(300))) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_are_the_binary_digits():
    for n in [*range(1, 70), 2047, 2048, 2049, 100_000]:
        own = packing.pieces_of(n, 64)
        assert sum(own) == n and own == sorted(own, reverse=True) and all(v & (v - 1) == 0 for v in own)
        assert all(c == 1 for v, c in Counter(own).items() if v < 64)


def test_other_tokenizers_take_the_plain_way():
    file = path("word_bpe_49k.json")
    tokenizer, encode = Tokenizer.from_file(file), packing.encoder(file)
    for text in ("Hello  world, it's  10", "", "a b"):
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_loses_nothing(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "a b"), (3, "copy"), (3, "copy"), (90, " ".join(f"word{i}" for i in range(20_000)))]
    docs = spark.createDataFrame([(i, t, "sequence_id", 7) for i, t in rows], "doc_id bigint, text string, length string, ids int").repartition(3)
    found = packing.pack(docs).collect()
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter((i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for i, t in rows)
    own = defaultdict(list)
    for r in found:
        assert len(r.ids) == 4 * r.length and r.offset == 0
        own[r.doc_id].append(r)
    whole = Counter()
    for i, parts in own.items():
        if sum(1 for j, _ in rows if j == i) == 1:
            parts.sort(key=lambda r: r.start)
            text = b"".join(r.ids for r in parts)
            assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))] and all(r.doc_tokens == len(text) // 4 for r in parts)
            whole[i, text] += 1
    assert all(whole[key] == n for key, n in want.items() if sum(1 for j, _ in rows if j == key[0]) == 1)
    assert sum(r.length for r in found) == sum(len(t) // 4 * n for (_, t), n in want.items())
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))
    order = sorted(found, key=lambda r: r.sequence_id)
    assert [r.length for r in order] == sorted((r.length for r in found), reverse=True)
    first = {}
    for r in order:
        first.setdefault(r.length, r.sequence_id)
        assert r.batch == (r.sequence_id - first[r.length]) // ((1 << 19) // r.length)


def test_packing_of_nothing_and_digests(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.cut_documents(empty, most=100)
    from strandline.llm import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer, total = Tokenizer.from_file(path("byte_bpe_50k.json")), 0
    for r in queries.op13_packing(spark, SF).collect():
        ids = np.array([*tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        total += r.length
    assert total == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in docs.values())
