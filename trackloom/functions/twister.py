"""A seeded stream of random numbers whose state can be taken and put back (Mersenne Twister 19937)."""

from __future__ import annotations

import numpy as np

#: Fixed value: the seed of the published generator's default initialisation.
DEFAULT_SEED = 5489


class Twister:
    """53-bit numbers in [0, 1), for driver-side draws; plans use seeded hashes."""

    def __init__(self, seed: int | list[int] = DEFAULT_SEED) -> None:
        self.seed(seed)

    def seed(self, seed: int | list[int]) -> None:
        self._draws = np.random.RandomState(seed)

    def rand(self, *shape: int) -> np.ndarray | float:
        return self._draws.random_sample(shape or None)

    @property
    def state(self) -> tuple[np.ndarray, int]:
        """The 624 words, and the place of the next."""
        _, words, at, *_ = self._draws.get_state()
        return words.copy(), int(at)

    @state.setter
    def state(self, value: tuple[np.ndarray, int]) -> None:
        self._draws.set_state(("MT19937", *value))
