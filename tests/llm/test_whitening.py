"""Whitening against a dense eigensolver and exact integers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from presence.llm import whitening

TABLE = "vec_id long, embedding array<float>, label int, n string, component int"


def made(seed, n, d):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, d)) @ np.diag(np.linspace(0.05, 0.4, d))).astype(np.float32).astype(float).tolist()


def run(spark, rows):
    table = spark.createDataFrame([(i, v, 0, "x", 9) for i, v in rows], TABLE).repartition(3)
    return whitening.whiten(table).collect()


def brute(rows, size):
    good = [(i, v) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    xs = [(i, tuple(math.floor(64 * x) + 1000000 for x in v)) for i, v in good]
    fit = sorted({x for _, x in xs})
    n, s = len(fit), [sum(x[k] for x in fit) for k in range(size)]
    v = np.array([[float(sum((Fraction(x[a]) - Fraction(s[a], n)) * (Fraction(x[b]) - Fraction(s[b], n)) for x in fit) / n) for b in range(size)] for a in range(size)])
    return xs, n, s, v


@pytest.mark.parametrize("d", [1, 6, 20])
def test_against_a_dense_solver(spark, d):
    rows = list(enumerate(made(d, 60, d)))
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # copies do not weigh
    rows += [(None, rows[1][1]), (7, rows[2][1]), (200, None), (201, [None] * d), (202, [math.nan] * d), (203, [math.inf] * d), (204, []), (205, [0.5] * (d + 1))]
    xs, n, s, v = brute(rows, d)
    got = run(spark, rows)
    m = min(16, d)
    assert len(got) == m * len(xs)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:m], vectors[:, ::-1].T[:m]
    by_row = {}
    for x in got:
        by_row.setdefault((x.vec_id, x.deviation), {}).setdefault(x.component, set()).add(x.whitened)
        assert x.n == n and abs(x.explained / (values[x.component - 1] / np.trace(v)) - 1) < 1e-10
        assert x.identity_error < 1e-9
    sign = {}
    for i, x in xs:
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        centred = np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(x, s, strict=True)])
        want = vectors @ centred / np.sqrt(values)
        for k in range(m):
            (value,) = by_row[i, deviation][k + 1]
            if abs(want[k]) > 1e-6:
                assert sign.setdefault(k, np.sign(value * want[k])) * value == pytest.approx(want[k], rel=1e-7, abs=1e-9)
            else:
                assert abs(value) < 1e-5


def test_tables_without_variance_give_no_rows(spark):
    assert run(spark, []) == run(spark, [(1, None)]) == run(spark, [(1, [0.5, 1.0])]) == run(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])]) == []
    flat = run(spark, [(i, [0.25 * i, 1.0, 0.25 * i]) for i in range(9)])  # one direction varies
    assert {x.component for x in flat} == {1} and all(x.explained == pytest.approx(1) for x in flat)


def test_equal_values_of_several_components(spark):
    corners = [[a / 4, b / 4, c / 4] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    got = run(spark, list(enumerate(corners)))
    w = np.array([[x.whitened for x in sorted(got, key=lambda x: x.component) if x.vec_id == i] for i in range(8)])
    assert np.abs(w.T @ w / 8 - np.eye(3)).max() < 1e-12 and all(x.explained == pytest.approx(1 / 3) for x in got)


def test_large_entries_stay_exact(spark):
    r = random.Random(2)
    rows = [(i, [r.choice((1, -1)) * 2.0 ** r.randint(0, 30) for _ in range(3)]) for i in range(12)] + [(99, [2.0**60, 0.0, 0.0])]
    xs, n, s, v = brute(rows[:-1], 3)
    got = {(x.vec_id, x.component): x for x in run(spark, rows)}
    assert len(got) == 36
    for i, x in xs:
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        assert got[i, 1].deviation == (deviation if deviation < 1 << 63 else None)
    assert got[0, 1].explained == pytest.approx(np.linalg.eigvalsh(v)[-1] / np.trace(v), rel=1e-9)


def test_counts_of_shifted_matrices():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = r.integers(-3, 4, (7, 7)).astype(float)
        a = a + a.T
        shift = r.uniform(-9, 9)
        assert whitening.below(a, shift) == (np.linalg.eigvalsh(a) < shift).sum()
    q, _ = np.linalg.qr(r.standard_normal((20, 20)))
    for values in ([5.0] * 3 + [4.0] * 4 + [3.0] * 13, list(1 + 1e-9 * np.arange(20)), list(10.0 ** -np.arange(20)), [1.0, 1.0] + [0.0] * 18):
        v = (q * np.array(values)) @ q.T
        v = (v + v.T) / 2
        e, x = whitening.leading(v)
        assert np.allclose(e, np.sort(values)[::-1][: len(e)], rtol=0, atol=1e-13)
        assert np.abs(x @ x.T - np.eye(len(e))).max() < 1e-12 and np.abs(v @ x.T - x.T * e).max() < 1e-13


def test_products_beyond_doubles():
    z = np.random.default_rng(3).integers(-(2**44), 2**44, (50, 3))
    assert (whitening._gram(z) == (z.astype(object).T @ z.astype(object))[np.triu_indices(3)]).all()
