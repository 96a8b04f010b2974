"""Best candidates by groups with bounds: all of what every product finds, from few of them."""

import numpy as np
import pytest

from strandgraph.operators import scoring


class Counted(np.ndarray):
    """Queries that count the products made with them."""

    made = 0

    def __matmul__(self, other):
        Counted.made += self.shape[0] * other.shape[1]
        return np.asarray(self) @ other


def found(ask, offer, idx, k, row=(), but=(), products=scoring.PRODUCTS):
    near, by, first = scoring._grouped(offer, idx)
    return scoring._met(ask, near, idx[by], first, k, products, np.array(row, np.int64), np.array(but, np.int64))


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("products", [500, 1 << 20])
def test_few_products_find_the_best(k, products):
    """Candidates around some places, half of them copies of others: queries meet the groups that may hold their best."""
    rng = np.random.default_rng(3)
    offer = rng.normal(size=(40, 8))[rng.integers(0, 40, 5000)] + 0.05 * rng.normal(size=(5000, 8))
    offer[2500:] = offer[:2500]
    offer /= np.sqrt((offer**2).sum(1, keepdims=True))
    idx, ask = rng.permutation(9000)[:5000], rng.normal(size=(400, 8))
    Counted.made = 0
    got, d = found(ask.view(Counted), offer, idx, k, products=products)
    by = np.argsort(idx)
    every = np.round(ask @ offer[by].T, 12)
    want = np.argsort(-every, axis=1, kind="stable")[:, :k]
    assert np.array_equal(got, idx[by][want]) and np.allclose(d, np.take_along_axis(every, want, 1), atol=1e-12)
    assert 0 < Counted.made < every.size / 4


def test_left_out_and_odd_candidates():
    """Pairs that don't count (unknown ones among them), candidates of one idx, vectors that aren't numbers, fewer candidates than asked for."""
    offer = np.array([[1.0, 0], [1, 0], [0, 1], [np.nan, 1], [2, 0]])
    got, d = found(np.array([[1.0, 0], [0, 1], [np.nan, 0]]), offer, np.array([4, 2, 7, 1, 4]), 4, [0, 1, -1, 2], [4, 9, 2, 2])
    assert [got[i][d[i] > -np.inf].tolist() for i in range(3)] == [[2, 7], [7, 2, 4, 4], []]
