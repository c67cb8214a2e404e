"""Hard negatives against brute force; bounds and the order of visits."""

import itertools

import numpy as np
from check import compare, connect

from wayfold.llm import multi_index

SCHEMA = "vec_id long, label int, embedding array<float>, v string, a int, score double"


def brute(rows):
    taken = []
    for r in rows:
        e = r["embedding"]
        if r["vec_id"] is None or r["label"] is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        taken.append((r["vec_id"], label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in e)))
    out = []
    for q in sorted({t for t in taken if t[0] % 100 == 0}):
        scored = sorted(((-sum(x * y for x, y in itertools.zip_longest(q[2], t[2], fillvalue=0)), t[0], t[1]) for t in taken if t[0] != q[0]))
        for p in [s for s in scored if s[2] == q[1]][:5]:
            window = [s for s in scored if s[2] != q[1] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(q[0], p[1], i, s[1], -p[0], -s[0]) for i, s in enumerate(window, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)


def check(spark, rows):
    docs = frame(spark, rows)
    assert sorted(map(tuple, multi_index.hard_negatives(docs).collect())) == brute(docs.collect())


def test_against_brute_force_with_ties_copies_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(multi_index, "CELL_ROWS", 40)
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 16)
    monkeypatch.setattr(multi_index, "SAMPLE", 60)
    centre = rng.normal(size=(6, 9))
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in np.round(centre[i % 6] + rng.normal(size=9) * 0.3, 1)]) for i in range(0, 900, 3)]
    rows += [(i, i % 3, [1.0] * 9) for i in range(1000, 1200)]  # one vector in many rows, an anchor among them
    rows += [rows[0], rows[10], (300, 2, [0.5] * 9), (300, 2, [-0.5] * 9)]
    rows += [(400, None, [1.0] * 9), (500, 1, None), (None, 1, [1.0] * 9), (600, 1, [float("nan")] * 9), (700, 1, [1.0] * 8 + [None]), (800, 1, [float("inf")] * 9), (2000, 3, []), (2100, 1, [2.0]), (2200, 1, [-1.0] * 9)]
    check(spark, rows)


def test_clusters_apart_from_each_other_are_not_all_visited(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "CELL_ROWS", 10)
    rng = np.random.default_rng(5)
    centre = np.eye(8) * 10
    docs = frame(spark, [(i, int(rng.integers(0, 3)), [float(x) for x in centre[i % 8] + rng.normal(size=8) * 0.05]) for i in range(800)])
    index = multi_index.Index(multi_index.quantised(docs))
    q = np.floor(256 * centre[0]).astype(np.int64)
    certain = multi_index._certain(index, q, -1, 0, [None], 5)
    assert len(list(index.visits(q, certain))) < len(list(index.visits(q, -np.inf))) / 4
    check(spark, [tuple(r)[:3] for r in docs.collect()])


def test_cells_come_by_falling_bound_and_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    found = list(multi_index.multi_sequence(a, b))
    assert [round(x, 9) for x, _, _ in found] == sorted((round(x + y, 9) for x in a for y in b), reverse=True)
    assert len({(i, j) for _, i, j in found}) == 35
    points = rng.integers(-500, 500, size=(300, 6))
    centres = multi_index.codebook(points, 4)
    at, far = multi_index.nearest(points.astype(float), centres)
    radii = np.array([far[at == k].max(initial=0) for k in range(4)])
    q = rng.integers(-500, 500, size=6)
    assert (points @ q <= multi_index.half_bounds(q, centres, radii)[at]).all()


def test_large_components_stay_exact():
    left, right = np.array([[2**24, 2**24 - 1, -(2**24)]]), np.array([[2**24, 2**24 - 3, 2**24]])
    assert multi_index.scores(left, right).tolist() == [[sum(int(x) * int(y) for x, y in zip(left[0], right[0]))]]


def test_empty_tables_and_tables_without_anchors(spark):
    assert multi_index.hard_negatives(frame(spark, [])).count() == 0
    assert multi_index.hard_negatives(frame(spark, [(1, 1, [1.0]), (2, 2, [1.0])])).count() == 0


def test_sql_twin(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(multi_index.hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet")), connect(folder), multi_index.HARD_NEGATIVES_SQL) == ""
