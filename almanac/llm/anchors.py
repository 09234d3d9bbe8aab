"""Anchors of a text: places chosen by content alone, so that equal stretches have equal anchors."""

from __future__ import annotations

import numpy as np

K = 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_PLACE = 24
_STRETCH = 1 << 22


def hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``K`` bytes from each place on."""
    two = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << 8)
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << 16)
    eight = four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << 32)
    n = len(data) - K + 1
    total = eight[:n] * _ODD[0]
    for i in range(1, 4):
        total ^= total >> np.uint64(29)
        total += eight[8 * i : 8 * i + n]
        total *= _ODD[i]
    return total ^ (total >> np.uint64(32))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values in a row, from those of half as many."""
    n, held, least = len(values) - width + 1, 1, values
    while 2 * held <= width:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    return least[:n] if held == width else np.minimum(least[:n], least[width - held : width - held + n])


def anchors(data: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, first and last window of each anchor. A window is ``least`` bytes from a start on.

    Every window has one anchor: the place of the smallest hash in it, the first
    of equal ones. Consecutive windows with the same anchor are one row.
    """
    out: list[tuple] = []
    whole = np.frombuffer(data, np.uint8)
    for origin in range(0, len(data) - least + 1, _STRETCH):
        part = whole[origin : origin + _STRETCH + least - 1]
        found = hashes(part)
        ordered = (found & ~np.uint64((1 << _PLACE) - 1)) | np.arange(len(found), dtype=np.uint64)
        best = sliding_minimum(ordered, least - K + 1)
        first = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
        place = (best[first] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        last = np.append(first[1:], len(best)) - 1
        out.append((found[place].view(np.int64), place + origin, first + origin, last + origin))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))
