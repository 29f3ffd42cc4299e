"""Whitening, clustering and neighbour search of embeddings against brute force."""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import blockjoin, centroids, queries, vectors, whitening
from tests.oracle import connection, difference

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, cluster string, score int, rank string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(k, v, "c", 1, None) for k, v in rows], schema)


def awkward(length: int, seed: int = 1) -> list[tuple]:
    """Copies, repeated rows, ties, scaled copies, other lengths, null ids, zeros, nulls and non-finite entries."""
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=length).tolist()) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(40)] + [(300 + k, [2.0 * c for c in rows[4][1]]) for k in range(3)]
    rows += [rows[0], rows[0], rows[50], (50, rows[7][1]), (None, rows[9][1]), (None, rows[9][1]), (400, [0.0] * length), (401, [-0.0] * length)]
    rows += [(500, None), (501, []), (502, [None] * length), (503, [math.nan] * length), (504, [math.inf] + [1.0] * (length - 1)), (505, [1.0] * (length - 1) + [None])]
    return rows + [(600 + k, rng.normal(size=length + 2).tolist()) for k in range(12)]


def usable(rows):
    return [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


# -- packed vectors --------------------------------------------------------------------------------


def test_packing_is_canonical_and_reversible():
    x = np.array([[0, 1], [-128, 127], [128, 0], [-129, 5], [2**31, 0], [-(2**31), 7], [2**62, -(2**62)], [0, 1]])
    order, packed = vectors.pack(x)
    whole = pa.concat_arrays(packed)
    back = np.empty_like(x)
    for at, rows in vectors.unpack(whole):
        back[order[at]] = rows
    assert (back == x).all()
    texts = whole.to_pylist()
    assert len(set(texts)) == 7 and texts[list(order).index(0)] == texts[list(order).index(7)]


# -- whitening -------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_eigen(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.diag(np.arange(n, dtype=float)), np.ones((n, n)), np.zeros((n, n)), 1e-9 * rng.normal(size=(n, n))):
        a = a + a.T
        values, axes = whitening.eigen(a)
        scale = max(np.abs(a).max(), 1e-300)
        assert np.allclose(values / scale, np.linalg.eigvalsh(a)[::-1] / scale, atol=1e-13)
        assert np.allclose(axes @ axes.T, np.eye(n), atol=1e-13)
        assert np.allclose(axes.T * values @ axes / scale, a / scale, atol=1e-13)


def exact_covariance(x: list[tuple[int, ...]]) -> np.ndarray:
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return np.array([[float(Fraction(sum(n * r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])


def test_moments_in_parts_equal_the_exact_covariance():
    x = np.random.default_rng(5).integers(-300, 300, (3000, 5)) + 10**7
    parts = [whitening.Runs(x[k]) for k in range(3)]
    for k in range(0, 3000, 170):
        rows = x[k : k + 170]
        parts[k % 3].add(rows)
    m = parts[0].all().merge(parts[1].all()).merge(parts[2].all())
    assert m.n == 3000 and m.total == x.sum(axis=0).tolist()
    assert np.allclose(m.covariance(), exact_covariance([tuple(r) for r in x.tolist()]), rtol=1e-13, atol=1e-10)


def check_whitening(got: list, rows: list[tuple]) -> None:
    by_length = defaultdict(list)
    for k, v in rows:
        by_length[len(v)].append((k, tuple(math.floor(256 * Fraction(c)) for c in v)))
    assert len(got) == sum(len(r) * min(4, d) for d, r in by_length.items())
    for d, kept in by_length.items():
        fit = sorted({x for _, x in kept})
        n, total = len(fit), [sum(x[i] for x in fit) for i in range(d)]
        covariance = exact_covariance(fit)
        values, axes = np.linalg.eigh(covariance)
        values, axes = values[::-1], axes[:, ::-1]
        want = defaultdict(list)
        for k, x in kept:
            away = [n * c - s for c, s in zip(x, total)]
            want[(k, n, str(sum(a * a for a in away)))].append(np.array(away, float) / n @ axes[:, :4] / np.sqrt(values[:4]))
        mine = [r for r in got if r.n == n]
        for c in range(1, min(4, d) + 1):
            of = [r for r in mine if r.component == c]
            assert len(of) == len(kept)
            theirs = sorted((k[0] is None, k[0] or 0, k[2], abs(round(w[c - 1], 7))) for k, ws in want.items() for w in ws)
            assert [x[:3] for x in theirs] == sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in of)
            assert np.allclose(sorted(x[3] for x in theirs), sorted(abs(r.whitened) for r in of), atol=1e-6)
            assert all(abs(r.explained * np.trace(covariance) / values[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in of)


def test_whitening_of_awkward_tables(spark):
    rows = awkward(6)
    df = table(spark, rows).repartition(5)
    check_whitening(whitening.whiten(df, whitening.fit(df)).collect(), usable(rows))


def test_registered_whitening(spark):
    rows = [(r.vec_id, r.embedding) for r in vectors.embeddings(spark, SF).collect()]
    got = queries.op11(spark, SF)
    assert got.schema["deviation"].dataType.simpleString() == "bigint"
    check_whitening(got.withColumn("deviation", got.deviation.cast("string")).collect(), usable(rows))


def test_whitening_without_variance_and_of_nothing(spark):
    one = table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    got = whitening.whiten(one, whitening.fit(one)).collect()
    assert len(got) == 4 and all(r.n == 1 and r.deviation == "0" and r.whitened is None and r.explained is None and r.identity_error is None for r in got)
    flat = table(spark, [(k, [float(k), 2.0, 2.0 * k]) for k in range(9)])
    got = whitening.whiten(flat, whitening.fit(flat)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and len(got) == 27 and got[0].identity_error < 1e-9
    none = table(spark, [])
    assert whitening.whiten(none, whitening.fit(none)).count() == 0


def test_deviation_beyond_a_long(spark):
    df = table(spark, [(1, [1e12, 0.0]), (2, [-1e12, 5.0]), (3, [1.0, 1.0]), (4, [1e300, 1.0])])
    got = {r.vec_id: r for r in whitening.whiten(df, whitening.fit(df)).collect() if r.component == 1}
    x = [(256 * 10**12, 0), (-256 * 10**12, 1280), (256, 256)]
    assert set(got) == {1, 2, 3} and int(got[1].deviation) == sum((3 * a - sum(r[i] for r in x)) ** 2 for i, a in enumerate(x[0]))


# -- clustering ------------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10, length=64):
    kept = [(i, [math.floor(1024 * Fraction(c)) for c in v]) for i, v in usable(rows) if len(v) == length]
    order = sorted((sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        to = [near(v)[1] for _, v in kept]
        for n in range(len(centres)):
            mine = [v for t, (_, v) in zip(to, kept) if t == n]
            if mine:
                centres[n] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [near(v) for _, v in kept]
    inertia = [sum(d for d, t in last if t == n) for n in range(len(centres))]
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    fit = lambda v: v if v < 2**63 else None
    return sorted(((i is None, i or 0), t, fit(d), fit(inertia[t]), fit(sum(inertia)), names[t]) for (i, _), (d, t) in zip(kept, last))


def clusters(df, **limits):
    length = {k: v for k, v in limits.items() if k == "length"}
    return sorted((((r.vec_id is None), r.vec_id or 0), *r[1:]) for r in centroids.assign(df, *centroids.fit(df, **limits), **length).collect())


@pytest.mark.parametrize("scale", [1.0, 3e9, 1e200])
def test_clusters_of_awkward_tables(spark, scale):
    rows = [(k, v and [c if c is None else c * scale for c in v]) for k, v in awkward(6, 3)]
    key = lambda r: str(r)
    assert sorted(clusters(table(spark, rows).repartition(5), length=6), key=key) == sorted(plain_clusters(rows, length=6), key=key)


def test_mixed_magnitudes_meet_exactly(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=3) * 10.0 ** rng.integers(-3, 15)).tolist()) for k in range(200)]
    assert clusters(table(spark, rows).repartition(3), length=3, k=5) == plain_clusters(rows, length=3, k=5)


def test_few_vectors_and_none(spark):
    rows = [(7, [0.5, 1.0]), (9, [0.5, 1.0]), (11, [-3.0, 2.0]), (None, [4.0, 4.0])]
    assert clusters(table(spark, rows), length=2) == plain_clusters(rows, length=2)
    assert clusters(table(spark, [])) == [] and clusters(table(spark, rows)) == []


def test_exact_types():
    rng = np.random.default_rng(0)
    for size in (10, 2**24, 2**29, 2**33, 2**60):
        x = rng.integers(-size, size, (50, 4))
        to, far = centroids.nearest(x, x[:3].tolist())
        want = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(x[:3].tolist())) for v in x.tolist()]
        assert [(int(f), int(t)) for f, t in zip(far, to)] == want
        assert centroids.grouped(x, to, 3).tolist() == [[sum(c) for c in zip(*([v for v, t in zip(x.tolist(), to) if t == n] or [[0] * 4]))] for n in range(3)]


def test_registered_clusters(spark):
    assert difference(queries.op12(spark, SF), connection(SF), queries.ORACLE_SQL["op12_centroids_gemm"]) == ""


# -- neighbours ------------------------------------------------------------------------------------


def plain_neighbours(rows, asked, k):
    """By query id: the lists of (vec_id, score) that each of its different vectors may give, as multisets of scores."""
    rows = sorted({(i, tuple(c + 0.0 for c in v)) for i, v in usable(rows) if any(v)}, key=str)
    out = []
    for i, v in sorted({(i, tuple(c + 0.0 for c in v)) for i, v in usable(asked) if i is not None and any(v)}):
        a = np.array(v)
        near = []
        for j, w in rows:
            if len(w) == len(v) and j != i:
                b = np.array(w)
                near.append((-round(float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum()))), 12), j is None, j or 0))
        out += [(i, r + 1, None if n else j, -s) for r, (s, n, j) in enumerate(sorted(near)[:k])]
    return sorted(out, key=str)


def neighbours(df, asked, k=5):
    return sorted(((r.query_id, r.rank, r.vec_id, round(r.score, 12) + 0.0) for r in blockjoin.search(df, asked, k).collect()), key=str)


@pytest.mark.parametrize("length", [1, 6, 64])
def test_neighbours_of_awkward_tables(spark, length, monkeypatch):
    rows = awkward(length, 4)
    rows = [r for r in rows if not (r[0] and 300 <= r[0] < 303)] if length > 1 else [r for r in rows if r[0] is None or r[0] < 150]  # ties but for rounding
    df = table(spark, rows).repartition(4)
    asked = df.where("vec_id % 10 = 0")
    want = plain_neighbours(rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0], 5)
    if length == 1:  # all cosines are 1 or -1: ranks by id
        assert [w[3] for w in want] == [g[3] for g in neighbours(df, asked)]
    assert neighbours(df, asked) == want


def test_neighbours_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(blockjoin, "GROUP_BYTES", 4000)
    rows = awkward(6, 6)
    df = table(spark, [r for r in rows if not (r[0] and 300 <= r[0] < 303)]).repartition(7)
    rows = [r for r in rows if not (r[0] and 300 <= r[0] < 303)]
    assert neighbours(df, df.where("vec_id IS NOT NULL"), 7) == plain_neighbours(rows, rows, 7)


def test_scaled_copies_and_extremes(spark):
    rows = [(k, [2.0 ** (20 * k), -(2.0 ** (20 * k))]) for k in range(-20, 20)] + [(100, [5e-324, 0.0]), (101, [1.7e308, 1.7e308])]
    got = neighbours(table(spark, rows), table(spark, [(0, [1.0, -1.0]), (101, [1.7e308, 1.7e308])]))
    assert [g[2] for g in got if g[0] == 0] == [-20, -19, -18, -17, -16] and {g[3] for g in got if g[0] == 0} == {1.0}
    assert [g[2:] for g in got if g[0] == 101][0] == (100, round(math.sqrt(0.5), 12))


def test_bounds_hold():
    rng = np.random.default_rng(8)
    for length in (2, 64, 300, 1100):
        a, b = (blockjoin.Coded(rng.normal(size=(200, length)) * 10.0 ** rng.integers(-5, 5, (200, 1))) for _ in range(2))
        near = (a.factors() @ b.factors().T) * a.scale[:, None] * b.scale[None, :]
        bound = a.kept[:, None] * b.lost[None, :] + a.lost[:, None] + blockjoin.SLACK
        exact = a.cosines(b, np.repeat(np.arange(200), 200), np.tile(np.arange(200), 200)).reshape(200, 200)
        assert (np.abs(near - exact) <= bound).all() and bound.max() < 0.2


def test_copies_make_no_survivors():
    rng = np.random.default_rng(9)
    rows = np.concatenate([np.tile(rng.normal(size=(1, 8)), (3000, 1)), rng.normal(size=(200, 8))])
    block = blockjoin.Block(np.arange(3200)[::-1].copy(), rows, 5)
    assert len(block.rows) == 201 and len(block.ids) == 206 and sorted(block.ids.tolist())[200:] == [200, 201, 202, 203, 204, 205]


def test_registered_neighbours(spark):
    assert difference(queries.op13(spark, SF), connection(SF), queries.ORACLE_SQL["op13_block_matrix_neighbours"]) == ""


def test_no_vectors(spark):
    none = table(spark, [])
    assert neighbours(none, none) == [] and neighbours(table(spark, [(0, [1.0])]), table(spark, [(0, [1.0])])) == []
