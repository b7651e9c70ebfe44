from __future__ import annotations

import numpy as np
import pytest

from siltstone.llm import neighbours as N


def brute(ids, m, k, least):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for i, a in enumerate(ids):
        s = np.round(m @ m[i], 6)
        order = sorted((j for j in range(len(ids)) if j != i and s[j] >= least), key=lambda j: (-s[j], ids[j]))[:k]
        out[a] = [(ids[j], s[j]) for j in order]
    return out


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 24))
    m = np.repeat(centres, 12, axis=0) + rng.normal(size=(720, 24)) * 0.35
    return list(range(1, 721)), m.astype(np.float32).astype(float)


def test_recall(spark, clusters):
    ids, m = clusters
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, m)], "id bigint, vector array<double>, cell string").repartition(5)
    got = N.neighbours(df, 24, N.Search(cell=60)).collect()
    wanted = {(a, b) for a, near in brute(ids, m, 10, 0.8).items() for b, _ in near}
    found = {(r.id, r.neighbour) for r in got}
    assert len(found & wanted) >= 0.95 * len(wanted) and len(found - wanted) <= 0.05 * len(found)
    assert all(r.similarity >= 0.8 and r.id != r.neighbour for r in got)
    ranks = {}
    for r in got:
        ranks.setdefault(r.id, []).append((r["rank"], -r.similarity, r.neighbour))
    for rows in ranks.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_exact_in_one_cell(clusters):
    ids, m = clusters
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = N.Search(collisions=1, radii=(90.0,))
    q, o, sims = N.nearest_in_cell(u, np.array(ids), s)
    got = {}
    for a, b, x in zip(q.tolist(), o.tolist(), sims.tolist()):
        got.setdefault(a, []).append((b, x))
    for a, near in brute(ids, m, 11, 0.8).items():
        assert [b for b, _ in sorted(got.get(a, []), key=lambda x: (-x[1], x[0]))] == [b for b, _ in near]


def test_windows_are_walked_not_compared_with_all():
    """Counts are those of the windows' members, from both sides at first, then of the newly opened ends only."""
    rng = np.random.default_rng(5)
    m = N._unit(np.repeat(rng.normal(size=(30, 24)), 8, axis=0) + rng.normal(size=(240, 24)) * 0.2)
    walked = []
    real = N._walk
    N._walk = lambda *a: walked.append(real(*a)) or walked[-1]
    try:
        q, o, sims = N.nearest_in_cell(m, np.arange(240), N.Search(k=6, least=0.5, radii=(0.3, 0.6)))
    finally:
        N._walk = real
    keys = np.concatenate(walked[:16])
    assert len(keys) < 0.25 * 16 * 240 * 240 / 2 and all(len(np.unique(w)) == len(w) for w in walked)
    opened = {(j % 16, tuple(divmod(int(k), 240))) for j, w in enumerate(walked[16:]) for k in w}
    assert len(walked) == 16 + 32 and len(opened) > 0
    s = m @ m.T
    np.fill_diagonal(s, -1)
    near = np.argsort(-s, axis=1)[:, :7]
    wanted = {(i, int(j)) for i in range(240) for j in near[i] if s[i, j] >= 0.5}
    assert len(wanted & set(zip(q.tolist(), o.tolist()))) >= 0.95 * len(wanted)


def test_pivots_are_found_over_heads():
    rng = np.random.default_rng(6)
    piv, m = N._unit(rng.normal(size=(400, 16))), N._unit(rng.normal(size=(300, 16)))
    homes = N.Pivots(piv, N.Search(homes=4, heads=20)).homes(m)
    exact = np.argsort(-(m.astype(np.float32) @ piv.astype(np.float32).T), axis=1)[:, :4]
    assert (homes == exact).all()  # all heads are asked
    some = N.Pivots(piv, N.Search(homes=4)).homes(m)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(some.tolist(), exact.tolist())]) > 3.2
    few = N.Pivots(piv[:2], N.Search(homes=4)).homes(m)
    assert (few[:, 2:] == -1).all() and (np.sort(few[:, :2], axis=1) == [0, 1]).all()


def test_copies_and_unusable_vectors(spark):
    copies = [(i, [1.0, 0.0, 0.0]) for i in range(1, 41)]
    other = [(50, [2.0, 0.0, 0.0]), (51, [0.0, 1.0, 0.0]), (52, [0.0, 0.0, 0.0]), (53, [1.0, 2.0]), (54, None), (55, [1.0, None, 1.0]), (None, [1.0, 0.0, 0.0]), (56, [float("nan"), 1.0, 1.0]), (1, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(copies + other, "id bigint, vector array<double>")
    got = {}
    for r in N.neighbours(df, 3, N.Search()).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbour, r.similarity)
    assert [got[1][k][0] for k in range(1, 11)] == list(range(2, 12))
    assert [got[40][k][0] for k in range(1, 11)] == list(range(1, 11)) == [got[50][k][0] for k in range(1, 11)]
    assert set(got) == {*range(1, 41), 50}
    assert N.neighbours(df.limit(0), 3).count() == 0


def test_large_cells_are_split(spark, clusters):
    ids, m = clusters
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m)], "id bigint, vector array<double>")
    small = N.neighbours(df, 24, N.Search(cell=10_000, block=100)).collect()
    whole = N.neighbours(df, 24, N.Search(cell=10_000)).collect()
    found, all_ = ({(r.id, r.neighbour) for r in x} for x in (small, whole))
    assert len(found & all_) >= 0.97 * len(found | all_)  # lines differ from meeting to meeting


def test_whole_lists_below_the_floor(spark, clusters):
    ids, m = clusters
    far = np.random.default_rng(3).normal(size=(40, 24)).astype(np.float32).astype(float)
    ids, m = ids + list(range(801, 841)) + [900], np.concatenate([m, far, far[:1]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m)], "id bigint, vector array<double>")
    for search in (N.Search(cell=60, whole=True), N.Search(cell=60, block=100, asked=150, whole=True)):
        got = {}
        for r in N.neighbours(df, 24, search).collect():
            got.setdefault(r.id, {})[r["rank"]] = r.neighbour
        wanted = brute(ids, m, 10, -1.0)
        assert all(sorted(got[i]) == list(range(1, 11)) for i in ids)
        assert all([got[i][k] for k in range(1, 11)] == [b for b, _ in wanted[i]] for i in [*range(801, 841), 900])
        assert sum(len(set(got[i].values()) & {b for b, _ in wanted[i]}) for i in ids) >= 0.95 * 10 * len(ids)


def test_whole_lists_of_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0])], "id bigint, vector array<double>")
    got = sorted((r.id, r["rank"], r.neighbour, r.similarity) for r in N.neighbours(df, 2, N.Search(whole=True)).collect())
    assert got == [(1, 1, 3, 1.0), (1, 2, 2, -1.0), (2, 1, 1, -1.0), (2, 2, 3, -1.0), (3, 1, 1, 1.0), (3, 2, 2, -1.0)]
    assert N.neighbours(df.limit(0), 2, N.Search(whole=True)).count() == 0
