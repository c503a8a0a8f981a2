"""Sorting and packing of whole numbers, as op10 and its exchanges do it."""

import numpy as np
import pytest

from pagequarry.llm import langmodel, packed


@pytest.mark.parametrize("top", [1, 7, 1 << 40, (1 << 63) - 1])
def test_orders(top):
    values = np.random.default_rng(top).integers(0, top, 3000)
    by = langmodel.order_of(values)
    assert sorted(by.tolist()) == list(range(3000)) and (np.diff(values[by]) >= 0).all()
    rank, distinct = langmodel.distinct_numbers(values)
    want, places = np.unique(values, return_inverse=True)
    assert distinct.tolist() == want.tolist() and rank.tolist() == places.tolist()
    assert langmodel.order_of(values[:0]).tolist() == [] and langmodel.distinct_numbers(values[:0])[1].tolist() == []


def test_lanes_decide_together():
    first = np.array([5, 2, 5, 2, 5], dtype=np.uint64)
    second = np.array([1, 9, 0, 9, 1], dtype=np.uint64)
    assert langmodel.by_lanes(first, second).tolist() in ([1, 3, 2, 0, 4], [3, 1, 2, 4, 0], [1, 3, 2, 4, 0], [3, 1, 2, 0, 4])


def test_planes():
    arrays = [np.array(x, dtype=np.uint64) for x in ([], [0, 0], [1, 255, 256, 2**63 + 5], range(70000))]
    assert [a.tolist() for a in packed.expand(packed.squeeze(*arrays))] == [a.tolist() for a in arrays]
