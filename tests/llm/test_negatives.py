"""Hard negatives against all inner products."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import negatives as ng


def brute(rows, k=5):
    q = [(n, i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, i, lab, v in q:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, m, other) for m, j, other, w in q if m != n]
        for p, j, _, _ in sorted(x for x in scored if x[3] == lab)[:k]:
            found = sorted(x for x in scored if x[3] != lab and -80 * p <= -100 * x[0] <= -100 * p)[:k]
            out.update((i, j, r, x[1], -p, -x[0]) for r, x in enumerate(found, 1))
    return out


def vectors(n, seed, d=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(d)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.randrange(4)
        v = [x + rng.gauss(0, 0.1) for x in centres[c]]
        rows.append((i, v, c if rng.random() < 0.8 else rng.randrange(4)))
    common = rows[7][1]
    rows += [(n + i, common, rng.randrange(3)) for i in range(n // 2)]  # one vector that is everywhere, under several labels
    rows += [(2 * n, None, 1), (2 * n + 100, [0.1, None] + [0.0] * (d - 2), 1), (2 * n + 1, [float("nan")] * d, 1), (2 * n + 2, [float("inf")] * d, 2), (2 * n + 200, [0.5] * d, None), (None, [0.5] * d, 1)]
    rows += [(2 * n + 300, [0.0] * d, 1), (2 * n + 400, [], 2), (2 * n + 3, [0.9, 0.9], 0), rows[0], rows[0], (100, rows[3][1], 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("id", "row", "vector", "near", "windows", "score", "place", "block")})


@pytest.mark.parametrize("chunk,block,parts", [(1024, 64, 4), (16, 3, 5)])
def test_negatives_equal_all_products(spark, chunk, block, parts):
    rows = vectors(700, 5)
    got = Counter(map(tuple, ng.hard_negatives(frame(spark, rows).repartition(3), F.col("vec_id") % 100 == 0, chunk=chunk, block=block, parts=parts).collect()))
    want = brute(rows)
    assert got == want
    assert len(want) > 100


def test_negatives_without_partners(spark):
    assert ng.hard_negatives(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert ng.hard_negatives(frame(spark, [(0, [1.0], 1), (1, [1.0], 1)]), F.col("vec_id") % 100 == 0).count() == 0
    zeros = [(100 * i, [0.0, 0.0], i % 2) for i in range(6)]
    assert Counter(map(tuple, ng.hard_negatives(frame(spark, zeros), F.col("vec_id") % 100 == 0).collect())) == brute(zeros)


def test_intervals_hold_every_score():
    rng = np.random.default_rng(1)
    v = rng.integers(-300, 300, (400, 9)).astype("<i4")
    v[0], v[1] = 0, v[2]
    units = ng.directions(list(v[:50]))
    norms, angles = ng._measured(v, units)
    one = np.ones(len(v), dtype="<i8").tobytes()
    chunk = ng.Packed(one, one, one, v.tobytes(), angles.astype("<f8").tobytes(), norms.tobytes(), b"")
    cut = 0
    for i in range(40):
        low, high = ng.bounds(angles[i], norms[i], chunk)
        scores = v.astype(np.int64) @ v[i].astype(np.int64)
        assert ((low <= scores) & (scores <= high)).all()
        cut += int((high < 0.8 * norms[i] ** 2).sum())
    assert cut > 0


def test_large_values_are_exact():
    a = np.array([2**26 + 1, 3, 2**25 - 7], dtype="<i4")
    got = ng._scores(a, a[None, :], float(2**53))
    assert got.tolist() == [sum(int(x) * int(x) for x in a)]


def test_too_long_vectors_are_an_error(spark):
    with pytest.raises(Exception, match="fit a long"):
        ng.hard_negatives(frame(spark, [(0, [3.0e8], 1), (1, [1.0], 2)]), F.col("vec_id") % 100 == 0).collect()


def test_parts_do_not_grow_with_the_input():
    """A join holds one part at a time, so parts are more where there are more chunks."""
    for n in (0, 10, 1000, 20_000):
        assert n / ng.parts_of(n, 32) <= ng.HELD
    assert ng.parts_of(10, 32) == 32 and ng.parts_of(0, 1) == 16


def test_blocks_are_not_multiplied_on_the_driver(spark):
    """Blocks meet each part by a shuffle: no table that explode multiplies is broadcast."""
    plan = ng.hard_negatives(frame(spark, vectors(200, 3)), F.col("vec_id") % 100 == 0)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in plan]
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            assert not any("Generate" in x for x in plan[i:below])
    assert any("FlatMapCoGroupsInArrow" in line for line in plan)


def test_groups_of_blocks_give_the_same(spark, monkeypatch):
    rows = vectors(700, 6)
    monkeypatch.setattr(ng, "GROUP", 2)
    got = Counter(map(tuple, ng.hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0, chunk=16, block=3, parts=3).collect()))
    assert got == brute(rows)
