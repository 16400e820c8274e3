"""Anchors are minima over all places of a window, also in blocks of little text."""

from __future__ import annotations

import numpy as np
import pytest

from nightledger.llm import anchors


@pytest.mark.parametrize(("window", "gram"), [(50, 27), (13, 6)])
def test_anchors_of_small_blocks(window, gram):
    shape, width = anchors.Shape(window, gram, None), window - gram + 1
    for size in range(window, window + 2 * width):
        for seed in range(20):
            grams = np.random.default_rng(seed).integers(0, 1 << 63, size - gram + 1).astype(np.uint64)
            symbols = anchors.Symbols(np.zeros(size, np.uint64), np.array([0, size]), np.zeros(0, np.uint8), np.zeros(0, np.int64), 0)
            found = anchors.Segments(shape, symbols, grams)
            got = np.repeat(found.key, found.windows).tolist()
            assert got == [int(grams[i : i + width].min()) for i in range(size - window + 1)], size


def test_refined_pointers_of_wanted_positions():
    rng = np.random.default_rng(3)
    for size in (1, 5, 60, 900):
        data = rng.integers(0, 2, size).astype(np.uint64)
        padded = np.concatenate([data, np.zeros(8, np.uint64)])
        keys = sum(padded[j : j + size] << np.uint64(7 - j) for j in range(8))
        wanted = (rng.random(size) < 0.4) & (np.arange(size) + 19 <= size)
        pointer, _ = anchors.refined(keys, 8, 19, wanted)
        at = np.flatnonzero(wanted).tolist()
        strings = {i: data[i : i + 19].tobytes() for i in at}
        assert all((pointer[i] == pointer[j]) == (strings[i] == strings[j]) for i in at for j in at)
