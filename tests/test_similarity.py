import re

import numpy as np

from presence.operators import reports


def test_blocks_do_not_grow_with_the_rows(spark):
    """A vector is copied once per block: 200 rows in blocks of one row were
    200 copies of each."""
    df = spark.createDataFrame([(i, i % 3, [float(i % 7) - 3, 1.0]) for i in range(200)], "id long, c int, v array<double>")
    out = reports.cross_file_similarity(df, "id", "c", "v", 1)
    cells = reports.MOST_BLOCKS * (reports.MOST_BLOCKS + 1) // 2
    assert re.search(rf"hashpartitioning\(p#\d+L?, q#\d+L?, {cells}\)", out._jdf.queryExecution().toString())


def test_cell_extremes_equal_brute(monkeypatch):
    """Tiles that cut runs, runs that cut tiles, and a masked cell."""
    monkeypatch.setattr(reports, "TILE", (5, 4))
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(23, 6)), rng.normal(size=(17, 6))
    ra, rb = np.array([0, 1, 2, 9, 20]), np.array([0, 11, 13])
    ids = rng.permutation(40)[:23], rng.permutation(40)[:17]
    for mask in (None, lambda r, c: ids[0][r][:, None] < ids[1][c][None, :]):
        wanted = np.ones((23, 17), bool) if mask is None else mask(slice(0, 23), slice(0, 17))
        n, low, total, high = reports.cell_extremes(a, b, ra, rb, mask)
        for i, x in enumerate(np.split(np.arange(23), ra[1:])):
            for j, y in enumerate(np.split(np.arange(17), rb[1:])):
                sims = (a @ b.T)[np.ix_(x, y)][wanted[np.ix_(x, y)]]
                assert n[i, j] == len(sims)
                if len(sims):
                    assert np.allclose([low[i, j], total[i, j], high[i, j]], [sims.min(), sims.sum(), sims.max()])
