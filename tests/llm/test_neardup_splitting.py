from __future__ import annotations

import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import neardup as D
from siltstone.llm import splitting as S

HOW = D.Likeness(size=3, least=5, threshold=0.6)


def features(text):
    import re

    w = re.findall(r"[A-Za-z0-9_]+", text)
    return set(zip(w, w[1:], w[2:]))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(25):
        base = [rng.choice(words) for _ in range(80)]
        for member in range(6):
            mine = [rng.choice(words) if rng.random() < 0.05 * member else w for w in base]
            rows.append(" ".join(mine))
    rows += rows[:7] + ["", "a b", None, "x y z", "q " * 3000]
    return list(enumerate(rows, 1))


@pytest.fixture(scope="module")
def found(spark, texts):
    df = spark.createDataFrame([(i, t, "z", "z") for i, t in texts], "id bigint, text string, rep string, digest string").repartition(3)
    members, reps = D.representatives(D.sketches(df, "id", "text", HOW))
    pairs = {(r.a, r.b) for r in D.row_pairs(members, D.similar_pairs(reps, df, "id", "text", HOW)).collect()}
    return df, pairs


def wanted(texts):
    f = {i: features(t) for i, t in texts if t is not None}
    f = {i: x for i, x in f.items() if len(x) >= HOW.least}
    return f, {(a, b) for a, b in combinations(sorted(f), 2) if len(f[a] & f[b]) / len(f[a] | f[b]) >= HOW.threshold}


def test_pairs(texts, found):
    assert found[1] == wanted(texts)[1]


def test_groups(spark, texts, found):
    f, pairs = wanted(texts)
    root = {i: i for i in f}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = {r.id: r.group for r in D.groups(found[0], "id", "text", HOW).collect()}
    assert got == {i: top(i) for i in f}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (161, 160)]
    got = {r.node: r.component for r in D.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 160)) and got[161] == 160 and 200 not in got


def test_hubs_are_resolved_apart(spark, monkeypatch):
    edges = [(1, i) for i in range(2, 40)] + [(50, i) for i in range(20, 30)] + [(60, 61)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    monkeypatch.setattr(D, "HUB", 5)
    got = {r.node: r.component for r in D.components(df).collect()}
    assert got == {i: 1 for i in [*range(1, 40), 50]} | {60: 60, 61: 60}


def test_rows_of_hot_representatives_meet_in_blocks(spark):
    members = spark.createDataFrame([(i, 1 if i < 30 else 30 if i < 45 else i) for i in range(1, 50)], "id bigint, rep bigint")
    links = spark.createDataFrame([(1, 30), (30, 46), (47, 48)], "a bigint, b bigint")
    wanted = D.row_pairs(members, links).collect()
    assert len(wanted) == len({tuple(r) for r in wanted}) == 29 * 28 // 2 + 15 * 14 // 2 + 29 * 15 + 15 + 1
    assert {tuple(r) for r in D.row_pairs(members, links, rows=4).collect()} == {tuple(r) for r in wanted}


def test_hot_buckets_meet_block_by_block(spark, texts):
    df = spark.createDataFrame(texts, "id bigint, text string")
    _, reps = D.representatives(D.sketches(df, "id", "text", HOW))
    assert {tuple(r) for r in D.candidates(reps, HOW, block=2).collect()} == {tuple(r) for r in D.candidates(reps, HOW).collect()}


def test_nothing(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    assert D.groups(df, "id", "text", HOW).count() == 0


LIMITS = S.Limits(10, 200, 2, 30)


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n\tü", max_size=1500))
def test_pieces_cover_and_fit(text):
    p = S.pieces(text, LIMITS)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    for a, b in p:
        assert b - a <= LIMITS.chars and text[a:b].count("\n") + 1 <= LIMITS.lines
    for (a, b), (c, d) in zip(p, p[1:]):
        assert a < c < b <= d and b < d
    assert (len(p) == 1) == (len(text) <= LIMITS.chars and text.count("\n") + 1 <= LIMITS.lines)


def test_cut_at_the_topic_change():
    text = "\n".join(["cat dog cat mouse"] * 7 + ["engine wheel brake"] * 7)
    a, b = S.pieces(text, S.Limits(10, 4000, 2, 30))
    assert text[: a[1]].count("mouse") == 7 and "engine" not in text[: a[1]]
    assert text[b[0] : a[1]].count("\n") == 2


def test_split(spark):
    long = "\n".join(f"line {i}" for i in range(25))
    rows = [(1, long, 100, "x"), (2, long, None, "x"), (2, long, -3, "x"), (3, None, 1, "x"), (4, "short", 1, "x"), (5, "", 1, "x"), (6, "é" * 900, 7, "x")]
    df = spark.createDataFrame(rows, "id bigint, content string, start_line int, piece string")
    got = S.split(df, "id", "content", "start_line", LIMITS).collect()
    assert {r.id for r in got} == {1, 2, 6}
    first = sorted((r for r in got if r.id == 1), key=lambda r: r.piece)
    assert first[0].start_line == 100 and first[-1].end_line == 124
    for r in first:
        assert r.content == "\n".join(f"line {i}" for i in range(r.start_line - 100, r.end_line - 99)) + ("\n" if r.piece < r.pieces - 1 else "")
    assert min(r.start_line for r in got if r.id == 2) == 1 and sum(r.id == 2 and r.piece == 0 for r in got) == 2
    assert all(r.start_line == r.end_line == 7 for r in got if r.id == 6)
    assert S.split(df.limit(0), "id", "content", "start_line", LIMITS).count() == 0


def test_depths_below_the_nearest_peaks():
    # Index 0 is unused; a low passage without a valley is not deep, a true valley is.
    depths = S._depths([1.0, 0.1, 0.1, 0.2, 0.1, 0.8, 0.5, 0.9, 0.3])
    assert [round(x, 6) for x in depths] == [0.0, 0.1, 0.1, 0.0, 0.8, 0.0, 0.7, 0.0, 0.6]
    assert S._depths([]) == [] and S._depths([1.0]) == [0.0]
