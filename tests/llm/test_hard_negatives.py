from itertools import product

import duckdb
import numpy as np
import pytest

from pagefacts.llm import hard_negatives as H


def brute_force(rows):
    """rows: (vec_id, label, integer vector), ids unique."""
    width = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, y, [*v, *[0] * (width - len(v))]) for i, y, v in rows]
    out = []
    for i, y, v in rows:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            window = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(window, 1)]
    return sorted(out)


def kept(rows):
    """What the table holds after relabelling and scaling."""
    best = {}
    for i, x, y in rows:
        if i is None or y is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        r = ((y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * float(v))) for v in x])
        best[i] = min(best.get(i, r), r)
    return [(i, *r) for i, r in best.items()]


SCHEMA = "vec_id long, embedding array<double>, label int, score int, cell int"


def mined(spark, rows):
    return sorted(map(tuple, H.mined_negatives(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)).collect()))


@pytest.fixture
def small(monkeypatch):
    """Many cells, slabs, blocks and both visits on few rows."""
    for name, value in {"CODES": 6, "SLAB_ROWS": 40, "BLOCK_ROWS": 3, "FIRST_ROWS": 60}.items():
        monkeypatch.setattr(H, name, value)


def test_equals_brute_force(spark, small):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 9))
    rows = [(int(i) - 300, (centres[i % 12] + rng.normal(scale=0.3, size=9)).tolist(), int(i % 4)) for i in range(1200)]
    got = mined(spark, rows)
    assert got and got == brute_force(kept(rows))


def test_hot_vector_and_ties(spark, small):
    """A third of all rows are one vector; scores tie in bulk."""
    rng = np.random.default_rng(4)
    grid = [list(map(float, x)) for x in product((0, 0.5, 1), repeat=4)]
    rows = [(i, [1.0, 1.0, 1.0, 1.0] if i % 3 == 0 else grid[int(rng.integers(len(grid)))], i % 5) for i in range(900)]
    assert mined(spark, rows) == brute_force(kept(rows))


def test_odd_rows(spark, small):
    one = [1.0, 0.5]
    rows = [
        (0, one, 1), (100, one, None), (200, None, 1), (300, [1.0, None], 1), (400, [float("nan"), 1.0], 1), (500, [float("inf"), 1.0], 1), (None, one, 1),
        (1, one, 2), (2, one, 2), (3, [0.9, 0.5], 2), (3, [0.9, 0.5], 2), (4, [0.95], 2), (5, [0.9, 0.4], 1), (6, [1.0, 0.4], 2), (600, [-1.0, -1.0], 3), (8, [-1.0, 1.0], 3), (9, [], 3),
    ]
    got = mined(spark, rows)
    assert got and got == brute_force(kept(rows))
    assert mined(spark, []) == [] and mined(spark, rows[:1]) == [] and mined(spark, [(100, [], 1), (101, [], 1), (102, [], 2)]) == [(100, 101, 1, 102, 0, 0)]


def test_large_components(spark, small):
    rows = [(i, [float(300_000 + i), float(-i * 1000)], i % 2) for i in range(0, 40)] + [(100, [400_000.0, 1.0], 0)]
    assert mined(spark, rows) == brute_force(kept(rows))


def test_certified_visits_leave_cells_out():
    """Cells come in falling order of their bounds, bounds hold, and far cells are never visited."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(50, 8)) + 40 * np.eye(8)[k] for k in range(8)])
    books = (H._codebook(x[:, :4]), H._codebook(x[:, 4:]))
    (a, far_a), (b, far_b) = H._nearest(x[:, :4], books[0]), H._nearest(x[:, 4:], books[1])
    cell = a * len(books[1]) + b
    sizes = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    radii = tuple(np.array([far[code == k].max(initial=0) for k in range(len(book))]) for far, code, book in ((far_a, a, books[0]), (far_b, b, books[1])))
    index = H.Index(8, books, radii, sizes, *H._layout(sizes), 10)
    order = list(index.visits(x[0]))
    assert sorted(c for _, c in order) == np.flatnonzero(sizes).tolist() and all(p[0] >= q[0] for p, q in zip(order, order[1:], strict=False))
    assert all(bound >= (x[cell == c] @ x[0]).max() for bound, c in order)
    fifth = np.sort(x @ x[0])[-5]
    seen = {*index.chosen(x[0], fifth, False), *index.chosen(x[0], fifth, True)}
    assert {*cell[x @ x[0] >= fifth]} <= seen and sizes[list(seen)].sum() < 0.5 * len(x)


def test_query_equals_sql(spark, sf):
    embeddings = spark.read.parquet(f"{sf}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    out = H.mined_negatives(embeddings)
    want = db.sql(H.SQL)
    assert out.columns == want.columns and sorted(map(tuple, out.collect())) == sorted(want.fetchall())
