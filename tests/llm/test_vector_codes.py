"""Integer vector codes against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import vector_codes as vc


def slow(rows, parts=8, entries=16, rounds=6):
    cut = lambda x: max(-(2**62), min(2**62, x))
    use = [(i, lab, [cut(int(np.floor(4096 * float(x)))) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    longest = max((len(v) for *_, v in use), default=0)
    width = -(-longest // parts) * parts
    use = [(i, lab, v + [0] * (width - len(v))) for i, lab, v in use]
    n = width // parts
    piece = lambda v, p: v[p * n : (p + 1) * n]
    first = sorted(use, key=lambda r: (r[0] is None, r[0] or 0, b"".join(x.to_bytes(8, "little", signed=True) for x in r[2])))[:entries]
    books = [[piece(v, p) for *_, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda a, own: min((far(a, e), k) for k, e in enumerate(own))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for *_, v in use:
                held[near(piece(v, p), books[p])[1]].append(piece(v, p))
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for own in books for e in own for x in e).encode()).hexdigest()
    coded, total = [], Counter()
    for i, lab, v in use:
        found = [near(piece(v, p), books[p]) for p in range(parts)]
        coded.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        total[lab] += coded[-1][3]
    most = 2**63 - 1
    return Counter((i, lab, code, min(e, most), min(total[lab], most), sha) for i, lab, code, e in coded)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)


def rows_of(length, n, spread, seed):
    rng = random.Random(seed)
    made = [(i, [rng.gauss(0, spread) for _ in range(length)], rng.choice([None, 1, 2])) for i in range(n)]
    copies = [(n + i, made[3][1], 1) for i in range(40)]
    return made + copies + [(5, made[5][1], 2), (None, made[6][1], None), (900, None, 1), (901, [1.0, None] + [0.0] * (length - 2), 1), (902, [float("nan")] * length, 1), (903, [float("inf")] * length, 1)]


@pytest.mark.parametrize("length,spread", [(64, 0.2), (24, 0.001), (13, 1.0), (16, 1e9)])
def test_codes_against_plain_python(spark, length, spread):
    rows = rows_of(length, 150, spread, length)
    if length == 13:
        rows += [(700, [], 1), (701, [0.5] * 4, 1)]
    got = vc.compressed(vectors(spark, rows))
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == slow(rows)


def test_few_and_no_rows(spark):
    few = [(3, [0.25] * 8, None), (1, [1.0] * 8, 2), (1, [1.0] * 8, 2)]
    assert Counter(map(tuple, vc.compressed(vectors(spark, few)).collect())) == slow(few)
    assert vc.compressed(vectors(spark, few).where("false")).count() == 0
    hollow = [(1, [], 1), (2, [], None)]
    assert {(r.code, r.error) for r in vc.compressed(vectors(spark, hollow)).collect()} == {("00" * 8, 0)}
    huge = [(1, [1e300] * 8, 1), (2, [-1e300] * 8, 1), (3, [0.0] * 8, 1)]
    assert Counter(map(tuple, vc.compressed(vectors(spark, huge)).collect())) == slow(huge)


def test_transform_keeps_distances_and_orders_by_sign_changes():
    for n in (1, 2, 8, 32):
        waves = vc.transformed(np.eye(n, dtype=np.int64)).T
        assert [int((np.diff(w) != 0).sum()) for w in waves] == list(range(n))
    rng = np.random.default_rng(1)
    a, b = rng.integers(-1000, 1000, (50, 6)), rng.integers(-1000, 1000, (16, 6))
    entry, far = vc.nearest(vc.transformed(a), vc.transformed(b))
    want = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (entry == want.argmin(axis=1)).all() and (far == want.min(axis=1)).all()
