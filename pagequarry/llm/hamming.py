"""Groups of bit strings by Hamming distance, in bounded memory."""

from __future__ import annotations

import numpy as np

#: Rows whose distances to each other are held at once; of more, each group is grown by comparing its members with all rows not yet reached.
TILE = 4096


def near_any(sigs: np.ndarray, some: np.ndarray, rest: np.ndarray, limit: int) -> np.ndarray:
    """Which of ``rest`` are within ``limit`` bits of any of ``some``; every one is compared, a bounded number at once."""
    found = np.zeros(len(rest), dtype=bool)
    for at in range(0, len(some), 64):
        left = np.flatnonzero(~found)
        for lo in range(0, len(left), TILE):
            part = left[lo : lo + TILE]
            differing = np.zeros((len(some[at : at + 64]), len(part)), dtype=np.uint16)
            for w in range(sigs.shape[1]):
                differing += np.bitwise_count(sigs[some[at : at + 64], w][:, None] ^ sigs[rest[part], w][None, :])
            found[part] = (differing <= limit).any(axis=0)
    return found


def groups(sigs: np.ndarray, limit: int) -> np.ndarray:
    """For each signature the first one that links of at most ``limit`` bits lead to."""
    n = len(sigs)
    label = np.arange(n)
    if n > TILE:
        rest = label.copy()
        while len(rest):
            head, rest = rest[0], rest[1:]
            reached = [np.array([head])]
            while reached and len(rest):
                found = near_any(sigs, reached.pop(), rest, limit)
                if found.any():
                    label[rest[found]] = head
                    reached.append(rest[found])
                    rest = rest[~found]
        return label
    pairs = []
    for lo in range(0, n, 256):
        near = np.zeros((min(256, n - lo), n), dtype=np.uint16)
        for w in range(sigs.shape[1]):
            near += np.bitwise_count(sigs[lo : lo + 256, w][:, None] ^ sigs[:, w][None, :])
        a, b = np.nonzero(near <= limit)
        pairs.append((a[b < a + lo] + lo, b[b < a + lo]))
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new
