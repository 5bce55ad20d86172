"""Damages of many masks at once against those of one mask, and draws against numpy's."""

import numpy as np
import pytest

from vellum.operators import augmentation as A
from vellum.operators import images as I

SEEDS = [0, 1, 2**32 - 1, 2**32, 2**64 - 1, *(int(x) for x in np.random.default_rng(1).integers(0, 2**63, 40))]


def test_draws_are_those_of_numpy():
    many, each, at = A.Streams(SEEDS), [np.random.Generator(np.random.PCG64(s)) for s in SEEDS], np.arange(len(SEEDS))
    for low, high in ((0, 2), (0, 1), (-35, 36), (3, 9), (0, 3 * 10**9)):
        for _ in range(5):
            assert (many.integers(at, low, high) == [g.integers(low, high) for g in each]).all()
            assert (many.uniform(at, 0.65, 0.9) == [g.uniform(0.65, 0.9) for g in each]).all()
    assert (many.grids(at, (3, 5)) == np.stack([g.random((3, 5)) for g in each])).all()
    some = at[::3]  # the others stand still
    assert (many.integers(some, 0, 14) == [each[k].integers(0, 14) for k in some]).all()
    assert (many.integers(at, 0, 14) == [g.integers(0, 14) for g in each]).all()


@pytest.mark.parametrize("recipe", I.DAMAGES)
@pytest.mark.parametrize("shape", [(14, 14), (9, 20), (24, 7), (1, 1)])
def test_many_masks_are_damaged_as_one(recipe, shape):
    rng = np.random.default_rng(sum(shape))
    masks = np.stack([rng.random(shape) < share for share in (0, 0.1, 0.3, 0.5, 0.9, 1) for _ in range(6)])
    masks = np.concatenate([masks, masks[::5]])  # equal ones under other seeds
    seeds = [I.seed_of(str(k), recipe, 1, 0)[1] for k in range(len(masks))]
    before = masks.copy()
    assert (A.damaged_all(masks, recipe, seeds) == np.stack([I.damaged(m, recipe, s) for m, s in zip(masks, seeds, strict=True)])).all()
    assert (masks == before).all() and A.damaged_all(masks[:0], recipe, []).shape == (0, *shape)


def test_unknown_damage():
    with pytest.raises(ValueError):
        A.damaged_all(np.ones((2, 3, 3), bool), "other", [1, 2])
