"""The gravity layout at any number of blocks."""

import numpy as np
import pytest

from folioplan.operators import layout


def one_pass(x, y, vx, vy, radius, cooling, cell, padding):
    """All pairs of a cell and its neighbours at once, summed in their order."""
    grid = {}
    for k, c in enumerate(zip(np.floor(x / cell).astype(int).tolist(), np.floor(y / cell).astype(int).tolist())):
        grid.setdefault(c, []).append(k)
    for (a, b), members in grid.items():
        for da, db in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1)):
            pairs = [(i, j) for i in members for j in grid.get((a + da, b + db), ()) if (da, db) != (0, 0) or i < j]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            dx, dy = x[j] - x[i], y[j] - y[i]
            square = dx * dx + dy * dy
            same = square < 1
            dx, dy, square = np.where(same, np.where((i + j) % 2, 1.0, -1.0), dx), np.where(same, 1.0, dy), np.where(same, 2.0, square)
            d = np.sqrt(square)
            push = np.where(square > cell * cell, 0.0, np.where(d < radius[i] + radius[j] + padding, 2.2, 120 / square)) * cooling
            for v, step in ((vx, dx / d * push), (vy, dy / d * push)):
                np.subtract.at(v, i, step)
                np.add.at(v, j, step)


@pytest.mark.parametrize("most", [1, 50, 1 << 16])
def test_blocks_of_pairs_change_no_digit(monkeypatch, most):
    monkeypatch.setattr(layout, "PAIRS", most)
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 1400, 150), rng.uniform(0, 900, 150)
    x[:9], y[:9] = 100.0, 100.0
    radius, v = rng.uniform(110, 116, 150), rng.normal(size=(2, 150))
    a, b = v.copy(), v.copy()
    layout.repel(x, y, a[0], a[1], radius, 0.7, 320, 34)
    one_pass(x, y, b[0], b[1], radius, 0.7, 320, 34)
    assert (a == b).all()


def test_more_blocks_than_five_thousand_are_laid_out(spark, monkeypatch):
    monkeypatch.setattr(layout, "gravity_budget", lambda n: 1)
    blocks = spark.range(5200).selectExpr("concat('t', id) AS id", "id % 9 AS n_papers")
    links = spark.range(5200).selectExpr("concat('t', id) AS source", "concat('t', (id * 7) % 5200) AS target", "id % 3 AS weight")
    got = layout.gravity(blocks, links).collect()
    assert len({r.id for r in got}) == len(got) == 5200 and all(np.isfinite([r.x, r.y]).all() for r in got)
