import tracemalloc

import numpy as np
import pytest

from assaysift.functions.setindex import SetIndex


@pytest.mark.parametrize("elements", [12, 100_000])
def test_similarities_of_few_and_many_elements(elements):
    """Matrix products serve sets over few elements, postings those over many; both equal plain counting."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, elements, rng.integers(0, 9))) for _ in range(70)]
    batch = [*sets[:30], np.array([1, elements + 7]), np.array([], dtype=np.int64)]
    index = SetIndex(sets)
    assert (index.matrix is not None) == (elements == 12)
    found = np.concatenate([s for _, s in index.tanimoto(batch)])
    for i, a in enumerate(batch):
        for j, b in enumerate(sets):
            union = len(np.union1d(a, b))
            assert found[i, j] == (len(np.intersect1d(a, b)) / union if union else 1.0)


def test_nothing_indexed():
    assert [s.shape for _, s in SetIndex([]).tanimoto([np.array([1])])] == [(1, 0)]


@pytest.mark.parametrize("elements", [64, 50_000])
def test_memory_of_a_block(elements):
    """A block of 4,096 sets against another takes some tens of MB; it took 130 to 260."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, elements, 32)) for _ in range(4_096)]
    index = SetIndex(sets)
    tracemalloc.start()
    for _ in index.tanimoto(sets[:1_500]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
