"""Hard negatives against plain Python, and exact products against Python's integers."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runledger.llm import residuegemm

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, n_positives=5, n_negatives=3):
    usable = [
        (i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label, *_ in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, a in usable:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, other) for j, other, b in usable)
        for s, j, other in [t for t in scored if t[2] == label and t[1] != i][:n_positives]:
            fit = [t for t in scored if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s][:n_negatives]
            out += [(i, j, k + 1, t[1], -s, -t[0]) for k, t in enumerate(fit)]
    return Counter(out)


def table(seed):
    rng = random.Random(seed)
    v = lambda n=20: [rng.gauss(0.1, 0.3) for _ in range(n)]
    rows = [(i, v(), rng.randint(0, 3)) for i in range(400)]
    same = v()
    rows += [(1000 + i, same, 1 + i % 2) for i in range(200)]  # a third of the rows has one vector: ties
    rows += [(2000, None, 1), (2001, v(), None), (None, v(), 1), (2050, [float("nan")] * 20, 1), (2100, [float("inf")] * 20, 0)]
    rows += [(2150, [None] * 20, 0), (2200, [], 0), (2250, v(3), 2), (2300, v(90), 2), (2350, [1e30] * 20, 2), (50, v(), 2), (50, v(), 2), (7, same, 1), (7, same, 1)]
    rows += [(-50, v(), 1), (-3, v(), -1), (3000, v(), 77)]
    return rows


@pytest.mark.parametrize("block", [64, 4096])
def test_against_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(residuegemm, "ROWS", block)
    monkeypatch.setattr(residuegemm, "ANCHORS", max(4, block // 16))
    rows = table(block)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("uid", "v", "_i", "_all", "nth", "my col")})
    got = Counter(tuple(r) for r in residuegemm.hard_negatives(docs, F.col("vec_id") % 50 == 0).collect())
    # A component of 1e30 leaves 64 bits; such a row takes no part.
    assert got == brute([r for r in rows if r[0] != 2350])


def test_no_rows(spark):
    assert residuegemm.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).isEmpty()
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [], 2)], SCHEMA)
    assert residuegemm.hard_negatives(alone, F.col("vec_id") % 50 == 0).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 150), st.integers(0, 29), st.integers(0, 2**32))
def test_products_are_exact(width, bits, seed):
    rng = np.random.default_rng(seed)
    most = min(1 << bits, int(2**29 / math.sqrt(width)))
    a, b = (rng.integers(-most, most + 1, (n, width)) for n in (5, 9))
    a[0], b[0] = most, -most
    want = a.astype(object) @ b.astype(object).T
    assert (residuegemm.products(a, b) == want).all()


def test_primes_keep_sums_exact():
    assert all(residuegemm.CHUNK * ((p + 1) // 2) ** 2 <= 1 << 24 for p in residuegemm.PRIMES[:1])
    assert math.prod(residuegemm.PRIMES) > 4 << 62
    for i, p in enumerate(residuegemm.PRIMES):
        assert all(p % q for q in range(2, 40)) and p not in residuegemm.PRIMES[:i]
    with pytest.raises(OverflowError):
        residuegemm.primes_for(2.0**69)


def test_best_takes_the_leftmost_of_equal_scores():
    none = np.iinfo(np.int64).min
    at, value = residuegemm.best(np.array([[3, 9, 9, 1], [none, 4, none, none]]), 3)
    assert at[0].tolist() == [1, 2, 0] and value[0].tolist() == [9, 9, 3] and value[1].tolist() == [4, none, none] and at[1][0] == 1
