"""An open-addressed numpy table from 64-bit hashes to 64-bit numbers."""

from __future__ import annotations

import numpy as np


class HashTable:
    """Bounded: the caller clears it before ``held`` comes near ``slots``."""

    def __init__(self, slots: int):
        self.slots = slots  # a power of two
        self.clear()

    def clear(self):
        self.keys = np.zeros(self.slots, np.uint64)
        self.values = np.zeros(self.slots, np.int64)
        self.held = 0

    def find(self, hashes: np.ndarray, missing: int = -1) -> np.ndarray:
        """The value of each hash."""
        mask = np.uint64(self.slots - 1)
        places = hashes & mask
        keys = self.keys[places]
        found = np.where(keys == hashes, self.values[places], missing)
        rest = np.flatnonzero((keys != hashes) & (keys != 0))
        while len(rest):
            places[rest] = (places[rest] + np.uint64(1)) & mask
            keys = self.keys[places[rest]]
            hit = keys == hashes[rest]
            found[rest[hit]] = self.values[places[rest[hit]]]
            rest = rest[~hit & (keys != 0)]
        return found

    def put(self, hashes: np.ndarray, values: np.ndarray):
        """Add distinct hashes that are not held."""
        mask = np.uint64(self.slots - 1)
        places = hashes & mask
        self.held += len(hashes)
        rest = np.arange(len(hashes))
        while len(rest):
            free = rest[self.keys[places[rest]] == 0]
            _, first = np.unique(places[free], return_index=True)
            placed = free[first]
            self.keys[places[placed]] = hashes[placed]
            self.values[places[placed]] = values[placed]
            rest = rest[self.keys[places[rest]] != hashes[rest]]
            places[rest] = (places[rest] + np.uint64(1)) & mask
