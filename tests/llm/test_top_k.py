"""Exact top-k search over many parts, against brute force."""

from __future__ import annotations

import random

import pytest

from closebooks.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute_force(rows, every, k):
    whole = [(i, [int(256 * x // 1) for x in v]) for i, v in rows]
    asked = {}
    for i, v in whole:
        if i % every == 0:
            asked[i] = max(asked.get(i, v), v)
    out = set()
    for q, a in asked.items():
        best = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in whole if i != q)[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return [tuple(r) for r in topk.top_k(df, **how).collect()]


@pytest.mark.parametrize("part_cells", [64, 400, 1 << 20])
def test_many_parts_and_a_third_of_equal_vectors(spark, part_cells):
    dice = random.Random(5)
    rows = [(i, [dice.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.5, 0.5, -1.0, 2.0, 0.25, 1.0]) for i in range(400, 600)]
    dice.shuffle(rows)
    got = found(spark, rows, every=10, k=5, part_cells=part_cells)
    assert len(got) == len(set(got)) == 60 * 5
    assert set(got) == brute_force(rows, 10, 5)


def test_fewer_rows_than_k_and_vectors_of_several_lengths(spark):
    rows = [(10, [1.0, 2.0]), (11, []), (12, [3.0]), (20, [-1.0, 0.0, 4.0])]
    assert set(found(spark, rows, every=10, k=5, part_cells=1)) == brute_force(rows, 10, 5)
    assert found(spark, [(10, [1.0])], every=10) == []
    assert found(spark, [(10, []), (11, [])], every=10) == [(10, 1, 11, 0)]


def test_scores_beyond_doubles_are_exact_and_beyond_long_an_error(spark):
    big = float(2**21)  # times 256, squared: 2^58
    rows = [(0, [big, 1.0]), (1, [big, 2.0]), (2, [big, 3.0])]
    assert found(spark, rows, k=2) == [(0, 1, 2, 2**58 + 3 * 2**16), (0, 2, 1, 2**58 + 2 * 2**16)]
    with pytest.raises(Exception, match="does not fit in long"):
        found(spark, [(0, [2.0**26]), (1, [2.0**26])])
