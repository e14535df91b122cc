"""The first places of a seeded shuffle, as the standard library's generator would make it, without a list of all places.

A shuffle of n places swaps them from the last to the second, each with one that the generator draws. The drawn numbers are
made in blocks by the same generator in numpy. To tell what the first k places hold in the end, the swaps are followed
back from the second to the last: blocks are made again from saved states of the generator, and only swaps that touch a
followed place count. Memory grows with k and the root of n; the time, about ten nanoseconds a draw, with n.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from math import isqrt

import numpy as np

#: Draws of a block, at most.
BLOCK = 1 << 16

State = tuple[bytes, int]


def seeded(seed: int) -> State:
    """The generator's state after seeding."""
    words = random.Random(seed).getstate()[1]
    return np.array(words[:-1], "<u4").tobytes(), words[-1]


def _generator(state: State) -> np.random.MT19937:
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": np.frombuffer(state[0], "<u4").copy(), "pos": state[1]}}
    return out


def _state(generator: np.random.MT19937) -> State:
    at = generator.state["state"]
    return np.asarray(at["key"], "<u4").tobytes(), int(at["pos"])


def _block(generator: np.random.MT19937, i: int) -> np.ndarray:
    """What the places from i downwards are swapped with, for as many as one block of the generator's words gives.

    A draw below i + 1 takes as many bits as i + 1 has and is made again while it is too large; a block doesn't go on to
    places for which that number of bits is another.
    """
    bits = (i + 1).bit_length()
    size = min(BLOCK, i + 2 - (1 << (bits - 1)))
    if bits <= 32:
        drawn = (generator.random_raw(size) >> np.uint64(32 - bits)).astype(np.int64)
    else:
        words = generator.random_raw(2 * size).reshape(-1, 2)
        drawn = (words[:, 0] | words[:, 1] >> np.uint64(64 - bits) << np.uint64(32)).astype(np.int64)
    taken = drawn <= i - size  # whatever was taken before; above that, up to i, it depends on it
    unsure = np.flatnonzero(~taken & (drawn <= i))
    if len(unsure):
        before = np.cumsum(taken)[unsure].tolist()
        more = 0
        for at, known, x in zip(unsure.tolist(), before, drawn[unsure].tolist()):
            if x <= i - known - more:
                taken[at] = True
                more += 1
    return drawn[taken]


def passed(state: State, n: int) -> State:
    """The state after a shuffle of n places."""
    generator, i = _generator(state), n - 1
    while i > 0:
        i -= len(_block(generator, i))
    return _state(generator)


def _backwards(state: State, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The blocks of a shuffle from the last to the first, each with the place that it begins with."""
    every = isqrt(n // BLOCK) + 16
    generator, i, k, saved = _generator(state), n - 1, 0, []
    while i > 0:
        if k % every == 0:
            saved.append((_state(generator), i))
        i -= len(_block(generator, i))
        k += 1
    end = 0
    for begin, first in reversed(saved):
        generator, i, here = _generator(begin), first, []
        while i > end:
            here.append((_state(generator), i))
            i -= len(_block(generator, i))
        for state, at in reversed(here):
            yield at, _block(_generator(state), at)
        end = first


def first_places(state: State, n: int, k: int, low_end: int = 0) -> list[int]:
    """The first k of range(n) after a shuffle from a state, from low_end on."""
    k = min(k, n)
    where = {p: p for p in range(low_end, k)}  # place now -> place in the end
    for i, drawn in _backwards(state, n):
        low = i - len(drawn) + 1
        held = np.fromiter(where, np.int64, len(where))
        # Places of the block itself can only be followed once they are swapped in, so draws of them are looked at too.
        hits = np.flatnonzero((drawn >= low) | np.isin(drawn, held))
        if low < k:  # both ends of swaps below k may be followed, and what such a swap moves down may be drawn again
            hits = np.union1d(hits, np.flatnonzero((drawn < k) | (np.arange(i, i - len(drawn), -1) < k)))
        for at in hits[::-1].tolist():
            a, b = i - at, int(drawn[at])
            x, y = where.pop(a, None), where.pop(b, None) if a != b else None
            if x is not None:
                where[b] = x
            if y is not None:
                where[a] = y
    out = [0] * max(0, k - low_end)
    for now, end in where.items():
        out[end - low_end] = now
    return out
