"""Steps on wide maps: tasks hand on no more than their places, and the grid's potentials are the sums over all nodes."""

import numpy as np
import pytest

from rankforge.operators import manifold as M


def test_no_more_than_the_places_is_handed_on():
    y = np.random.default_rng(5).uniform(-200, 200, (3000, 2))
    grid = M.Grid(np.array([-210.0, -210.0]), np.array([210.0, 210.0]))
    few = list(M._charged(grid)([(0, (M.OWN, 0.5, y[:2000])), (1, (M.OWN, 0.25, y[2000:]))]))
    assert len(few) == 1 and few[0][2] == 0.75 and few[0][3].nbytes <= y.nbytes
    crowded = M.Grid(np.array([-1.0, -1.0]), np.array([1.0, 1.0]))
    many = np.random.default_rng(6).uniform(-1, 1, (20_000, 2))
    charges = list(M._charged(crowded)([(0, (M.OWN, 0.0, many))]))[0][3]
    assert charges.shape == (3, crowded.n, crowded.n) and charges[0].sum() == pytest.approx(20_000)


def test_potentials_are_sums_over_all_nodes():
    grid = M.Grid(np.array([-3.0, -2.0]), np.array([4.0, 2.0]))
    charges = np.random.default_rng(7).standard_normal((3, grid.n, grid.n))
    grid.solve(charges)
    at = np.stack(np.meshgrid(np.arange(grid.n), np.arange(grid.n), indexing="ij"), -1).reshape(-1, 2) * grid.step
    w = 1 / (1 + ((at[:, None] - at[None]) ** 2).sum(-1))
    want = [w @ charges[0].ravel(), *(w**2 @ c.ravel() for c in charges)]
    assert np.abs(grid.potential.reshape(4, -1) - want).max() < 1e-9
