"""The k best of a block pair (K5): what the groups' best leave out is never among them."""

import numpy as np
import pytest

from medlattice.operators import knowledge as K


@pytest.mark.parametrize("m,k,zeros", [(3, 5, 1), (40, 5, 0), (700, 5, 40), (3000, 3, 2980), (2000, 70, 0)])
def test_best_of_a_block(m, k, zeros):
    rng = np.random.default_rng(m)
    q, v = rng.normal(size=(60, 6)), rng.normal(size=(m, 6))
    v[:zeros], v[m // 2:m // 2 + 9] = 0, v[m // 2]                  # undefined cosines, and ties
    q, v, ids = K._unit(q), K._unit(v), rng.permutation(m).astype(np.int64)
    got = K._best(np.arange(60), q, ids, v, k)
    cosine = np.round(q @ v.T, 6)
    for i, rows in got.groupby("qid"):
        want = sorted((-np.nan_to_num(c, nan=-np.inf), x) for c, x in zip(cosine[i], ids.tolist()))[:k]
        assert [(-np.nan_to_num(c, nan=-np.inf), x) for c, x in zip(rows["cosine"], rows["vid"])] == want
    assert len(got) == 60 * min(k, m)


def test_best_ranks_few_of_the_pairs(monkeypatch):
    """Only what may be among the k best is rounded and ranked, not every pair."""
    rng, seen, sort = np.random.default_rng(1), [], np.lexsort
    monkeypatch.setattr(K.np, "lexsort", lambda keys: (seen.append(len(keys[0])), sort(keys))[1])
    q, v = K._unit(rng.normal(size=(200, 8))), K._unit(rng.normal(size=(4096, 8)))
    K._best(np.arange(200), q, np.arange(4096), v, 5)
    assert 200 * 5 <= sum(seen) < 200 * 4096 // 100
