"""Hard negatives against plain comparison of all rows."""

import math
import random

import pytest

from recordprofile.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string"


def plain(rows):
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    kept = [r for r in kept if sum(x * x for x in r[1]) < 1 << 55]
    out = []
    for a in kept:
        if a[0] % 50:
            continue
        score = lambda r, a=a: sum(x * y for x, y in zip(a[1], r[1], strict=True))
        others = sorted(((-score(r), r[0], r[2]) for r in kept if r is not a and len(r[1]) == len(a[1])), key=lambda x: x[:2])
        for p, i, _ in [o for o in others if o[2] == a[2]][:5]:
            fit = [o for o in others if o[2] != a[2] and 50 * -p <= 100 * -o[0] <= 95 * -p]
            out += [(a[0], i, k + 1, o[1], -p, -o[0]) for k, o in enumerate(fit[:3])]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = hard_negatives(df, **options).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def vectors(n, seed, width=8):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    near = lambda c: [round(x + rng.gauss(0, 0.3), 2) for x in c]
    return [(k * 10, near(rng.choice(centers)), rng.randrange(3)) for k in range(n)]


@pytest.mark.parametrize(
    "options", [{}, {"per_cell": 4, "first_cells": 1, "vectors_block": 7, "anchors_block": 3}, {"per_cell": 1, "most_codes": 5, "first_cells": 2, "sample": 40}]
)
def test_equals_comparing_all_rows(spark, options):
    rows = vectors(300, len(options))
    want = plain(rows)
    assert mined(spark, rows, **options) == want and len(want) > 300


def test_bounds_stop_early(spark, monkeypatch):
    """Clusters far apart: anchors do not visit the cells of others."""
    from recordprofile.llm import hard_negatives as module

    visits = []
    settle = module.settle
    monkeypatch.setattr(module, "settle", lambda df: (found := settle(df), visits.append(found[0].count()))[0])
    rng = random.Random(3)
    rows = []
    for k in range(400):
        v = [0.0] * 8
        v[k % 8] = 4.0 + rng.random()
        rows.append((k * 10, v, k // 8 % 2))
    assert mined(spark, rows, per_cell=6, first_cells=1) == plain(rows)
    anchors = sum(r[0] % 50 == 0 for r in rows)
    # Two searches over 64 cells.
    assert 0 < sum(visits) < 2 * anchors * 40


def test_awkward_rows(spark):
    rows = vectors(60, 9) + [
        (50, [1.0] * 8, None), (100, None, 1), (150, [1.0, None] + [0.0] * 6, 1), (200, [float("nan")] * 8, 1), (250, [float("inf")] * 8, 0), (None, [1.0] * 8, 1),
        (300, [0.0] * 8, 1), (350, [], 1), (360, [], 2), (350, [], 1), (400, [1.0, 2.0], 0), (410, [1.0, 1.0], 1), (420, [1.0, 2.0], 0), (430, [1.0, 1.9], 1),
        (450, [1e30] * 8, 0), (500, [-1.0] * 8, 2), (-50, [0.5] * 8, 2), (0, vectors(1, 9)[0][1], 1),
    ]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == [] == mined(spark, [(50, None, None)])
    # Equal vectors, a third of all rows: ties go by id.
    same = vectors(60, 4) + [(1000 + k, [0.25] * 8, k % 2) for k in range(40)]
    assert mined(spark, same, vectors_block=8, anchors_block=2) == plain(same)


def test_whole_numbers_beyond_doubles(spark):
    rng = random.Random(8)
    rows = [(k * 25, [rng.choice([-1, 1]) * rng.uniform(1e5, 3e5) for _ in range(2)], k % 2) for k in range(60)]
    assert mined(spark, [(i, [float(x) for x in v], y) for i, v, y in rows]) == plain([(r["vec_id"], r["embedding"], r["label"]) for r in spark.createDataFrame([(*r, "") for r in rows], SCHEMA).collect()])
