"""Whitening against whole-number brute force."""

from collections import Counter

import numpy as np
import pytest

from gleanery.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, x int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, -1, "c", 9) for i, v in rows], SCHEMA)


def plain(rows):
    """Fit list, sums, covariance and the kept rows, by Python integers."""
    kept = [(i, [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, width = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(width)]
    apart = [[n * x[d] - sums[d] for d in range(width)] for x in fit]
    cov = [[sum(a[i] * a[j] for a in apart) / n**3 for j in range(width)] for i in range(width)]
    return kept, n, sums, np.array(cov)


def vectors(seed, rows, width=6):
    rng = np.random.default_rng(seed)
    spread = np.array([3.0, 2.0, 1.2, 0.7, 0.4, 0.2])[:width]
    return [(i, [float(c) for c in rng.normal(size=width) * spread]) for i in range(rows)]


def awkward_rows():
    rows = vectors(1, 300)
    copies = [(1000 + i, rows[0][1]) for i in range(150)]
    near = [(2000, [c + 1e-6 for c in rows[1][1]])]
    same = [rows[2], rows[2], (None, rows[3][1]), (5000, [0.0, -0.0] * 3)]
    return rows + copies + near + same


def test_whitened_rows_are_those_of_whole_number_brute_force(spark):
    good = awkward_rows()
    bad = [(6000, None), (6001, []), (6002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (6003, [float("nan")] * 6)]
    bad += [(6004, [float("inf")] + [0.0] * 5), (6005, [1.0, 2.0])]
    got = whitening.whiten(table(spark, good + bad), block=64).collect()
    kept, n, sums, cov = plain(good)
    assert {r.n for r in got} == {n}
    want = Counter((i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in kept)
    for k in range(1, 5):
        assert Counter((r.vec_id, r.deviation) for r in got if r.component == k) == want
    values, axes = np.linalg.eigh(cov)
    top = np.argsort(-values)[:4]
    by_id = {}
    for i, x in kept:
        by_id[i] = (np.array(x) - np.array(sums) / n) @ axes[:, top] / np.sqrt(values[top])
    signs = {}
    for r in got:
        expected = by_id[r.vec_id][r.component - 1]
        sign = signs.setdefault(r.component, 1 if r.whitened * expected >= 0 else -1)
        assert abs(r.whitened * sign - expected) < 1e-9
        assert abs(r.explained - values[top[r.component - 1]] / np.trace(cov)) < 1e-9
        assert 0 <= r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


@pytest.mark.parametrize("scale", [3, 300, 10**18])
def test_scatter_is_exact(scale):
    rng = np.random.default_rng(scale % 97)
    x = rng.integers(-scale, scale, size=(200, 5))
    sums, cross = whitening.scatter(x)
    whole = [[int(c) for c in row] for row in x]
    assert sums == [sum(row[i] for row in whole) for i in range(5)]
    assert cross == [[sum(row[i] * row[j] for row in whole) for j in range(i, 5)] for i in range(5)]


def test_limbs_add_up():
    for value in (0, 1, -1, 2**31, -(2**200) - 7):
        assert sum(p << (31 * k) for k, p in enumerate(whitening._limbs(value))) == value


def test_flat_and_empty_tables(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {
        (i, k, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for k in (1, 2)
    }
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i]) for i in range(10)])).collect()
    first = [r for r in line if r.component == 1]
    assert all(abs(r.explained - 1) < 1e-12 for r in first)
    assert all(r.whitened == 0 and r.explained == 0 for r in line if r.component == 2)
    assert all(r.identity_error < 1e-9 for r in line)


def test_entries_beyond_long_are_the_nearest(spark):
    got = whitening.whiten(table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])])).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id != 3)
