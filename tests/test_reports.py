"""Exact ranks, classes without values, and pooled error rates."""

import random

import pytest

from presence.operators import reports


def test_order_statistics_are_exact(spark):
    r = random.Random(4)
    lists = {
        "wide": [r.choice((-1, 1)) * r.random() * 10.0 ** r.randint(-300, 300) for _ in range(700)],
        "tied": [r.choice((0.0, 0.1, 0.1 + 1e-17, 0.2)) for _ in range(500)],
        "one": [3.25],
        "near": [1.0 + k * 2.0**-52 for k in range(300)],
        None: [5.0, -5.0, 0.0, -0.0],
    }
    rows = [(k, v, 1) for k, vs in lists.items() for v in vs]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, v double, n long").repartition(5)
    wanted = {"low": lambda n: n * 0, "mid": lambda n: (n - n % 2) / 2, "top": lambda n: n - 1}
    got = {x.k: x for x in reports.order_statistics(table, ["k"], "v", wanted).collect()}
    assert len(got) == len(lists)
    for k, vs in lists.items():
        s = sorted(vs)
        assert (got[k].low, got[k].mid, got[k].top) == (s[0], s[len(s) // 2], s[-1]), k


def test_weights_and_missing_signals(spark):
    rows = [(True, 0.1, None, 3), (True, 0.4, None, 1), (False, 0.9, 0.2, 2), (False, None, 0.3, 5)]
    table = spark.createDataFrame(rows, "bona_fide boolean, a double, b double, w long")
    got = {(x.bona_fide, x.signal): x for x in reports.signal_distribution(table, ["a", "b"], weight="w").collect()}
    assert (got[True, "a"].n, got[True, "a"].median, got[True, "a"].mean) == (4, 0.1, pytest.approx(0.175))
    assert (got[True, "b"].n, got[True, "b"].median) == (0, None)
    assert (got[False, "b"].n, got[False, "b"].median) == (7, 0.3) and got[False, "a"].max == 0.9


def test_rows_without_species_are_no_total(spark):
    rows = [("print", False, "live"), ("print", False, "spoof"), (None, False, "live"), (None, True, "spoof"), ("replay", True, "live")]
    table = spark.createDataFrame(rows, "species string, bona_fide boolean, verdict string")
    got = {(x.species, x.overall): x for x in reports.apcer_bpcer(table).collect()}
    assert set(got) == {("print", False), (None, False), ("replay", False), (None, True)}
    assert got[None, False].apcer == 1.0 and got["print", False].apcer == 0.5
    total = got[None, True]
    assert (total.attacks, total.accepted, total.apcer_max, total.worst_species) == (3, 2, 1.0, None)
    assert (total.bona_fide, total.bpcer) == (2, 0.5) and got["replay", False].apcer is None
