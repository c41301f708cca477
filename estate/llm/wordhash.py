"""Words of many texts as 64-bit integers, found and hashed in whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE, _TWO = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Texts are taken together up to about so many bytes.
CHUNK_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit in reaches every bit out."""
    x = (x ^ (x >> np.uint64(30))) * _ONE
    x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of ordered pairs of names."""
    return mix(left * _STEP + mix(right + _STEP))


def chunks(texts: pa.Array, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, number of rows, hashes of all words, and where each row's words begin.

    ``lower`` turns A to Z into small letters and leaves all else as it is.
    """
    held, size, first = [], 0, 0
    for row, value in enumerate(texts):
        text = (value.as_py() or "").encode("utf-8")
        held.append(text.lower() if lower else text)
        size += len(text)
        if size >= CHUNK_BYTES or row == len(texts) - 1:
            words, starts = _words(held)
            yield first, len(held), words, starts
            held, size, first = [], 0, row + 1


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    space = _SPACES[data]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    # A word is the sum of one random number per byte and place in the word.
    place = np.arange(len(data), dtype=np.uint64)
    place[starts[0] :] -= np.repeat(starts.astype(np.uint64), np.diff(np.append(starts, len(data))))
    letters = mix((place * np.uint64(256) + data) * _STEP + _ONE)
    letters[space] = 0
    return mix(np.add.reduceat(letters, starts)), np.searchsorted(starts, begin)
