"""What the fourth review found."""

import numpy as np
import pytest

from lectern.llm import bit_sliced


def slow_top(rows, k):
    codes = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    out = set()
    for q in (i for i in codes if i % 100 == 0):
        found = sorted((-sum(a * b for a, b in zip(codes[q], c, strict=True)), i) for i, c in codes.items() if i != q and len(c) == len(codes[q]))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


def test_f1_queries_do_not_pass_through_the_driver(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 0.2, 4)]) for i in range(300)], "vec_id long, embedding array<float>")
    plan = bit_sliced.top_products(df, rows=10, queries=1)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan and "Join" not in plan


@pytest.mark.parametrize(("parts", "together"), [(1, 100), (2, 2), (3, 1)])
def test_f1_parts_of_several_blocks_meet_all_stripes(spark, monkeypatch, parts, together):
    monkeypatch.setattr(bit_sliced, "PARTS", parts)
    monkeypatch.setattr(bit_sliced, "TOGETHER", together)
    rng = np.random.default_rng(parts)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 5)]) for i in range(0, 1300, 5)]
    # other lengths, codes beyond 16 and 32 bits, copies, which tie
    rows += [(2000, []), (2001, []), (2100, [0.5] * 3), (2101, [-40.0] * 3), (2102, [0.5] * 3), (2200, [2.2e6, -1.0]), (2201, [2.2e6, 1.0]), (2300, [1.0])]
    rows += [(3000 + i, rows[20][1]) for i in range(15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = bit_sliced.top_products(df, rows=20, queries=2).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == slow_top(rows, 10)


@pytest.mark.parametrize(("high", "width"), [(600, 2), (-(2**15), 2), (2**15, 4), (-(2**31) - 1, 8), (2**62, 8)])
def test_f1_codes_are_packed_without_loss(high, width):
    codes = np.array([[0, 1, -1], [high, 5, 7]], np.int64)
    packed = bit_sliced.packed_codes(codes)
    assert len(packed) == width * 6 and np.array_equal(bit_sliced.unpacked_codes(packed, 2, 3), codes)
