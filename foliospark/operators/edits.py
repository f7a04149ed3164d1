"""Hashes by which strings within a few edits of each other meet.

Strings of one length are hashed together by sums over their letters, so what is left of a string without some
letters is a sum of a few differences and is never spelled out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np

#: Words with more letters are met by pieces, for what deletions leave of a string grows with a power of its length.
LONGEST = 32
#: Hashes that are made at once.
AT_ONCE = 1 << 20

_RING = 1 << 64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, _RING)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(codes: np.ndarray, less: int = 0) -> np.ndarray:
    """Sums of the letters before each place, every letter weighted as if it stood ``less`` places further left."""
    n, length = codes.shape
    weights = np.full(length, _BASE, np.uint64)
    weights[:1] = pow(_BACK, less, _RING)
    weights = np.cumprod(weights)
    out = np.zeros((n, length + 1), np.uint64)
    np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(_BASE)) * weights, axis=1, out=out[:, 1:])
    return out


def _deleted(codes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A row for each string: what is left of it without up to ``most`` letters."""
    length = codes.shape[1]
    sums = [_sums(codes, k) for k in range(min(most, length) + 1)]
    for n in range(len(sums)):
        out = np.array(list(combinations(range(length), n)), np.int64)
        out = out.reshape(len(out), n)
        edges = [np.full(len(out), -1), *out.T, np.full(len(out), length)]
        yield _mixed(sum((sums[k][:, edges[k + 1]] - sums[k][:, edges[k] + 1] for k in range(n + 1)), np.uint64(0)))


def _pieces(sums: np.ndarray, length: int, most: int, shift: int) -> Iterator[np.ndarray]:
    """A row for each string: its parts that may be one of the ``most + 1`` pieces of a word of ``length``, up to ``shift`` places away."""
    cuts = [length * k // (most + 1) for k in range(most + 2)]
    found = []
    for k, (start, stop) in enumerate(zip(cuts, cuts[1:])):
        which = np.uint64((length * (most + 1) + k) * _BACK % _RING)
        for at in range(max(0, start - shift), min(start + shift, sums.shape[1] - 1 - stop + start) + 1):
            part = (sums[:, at + stop - start] - sums[:, at]) * np.uint64(pow(_BACK, at, _RING))
            found.append(_mixed(part + which))
    if found:
        yield np.stack(found, 1)


def keys(strings: list[str], most: int, listed: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``strings`` and hashes, of ``listed`` words or of strings that look for them.

    A string within ``most`` edits of a listed word has a hash with it in common: both come to one string by at most
    ``most`` deletions each, or, where the word is long, one of its pieces stands in the string as it is."""
    off = 0 if listed else most
    by_length: dict[int, list[int]] = {}
    for k, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(k)
    for length, places in by_length.items():
        step = max(1, AT_ONCE // (min(length, LONGEST + most) + 1) ** most)
        for at in range(0, len(places), step):
            some = np.array(places[at : at + step])
            codes = np.frombuffer("".join(strings[k] for k in some).encode("utf-32-le"), "<u4").reshape(len(some), length)
            if length <= LONGEST + off:
                for hashes in _deleted(codes, most):
                    yield np.repeat(some, hashes.shape[1]), hashes.ravel()
            sums = _sums(codes) if length + off > LONGEST else None
            for wanted in range(max(LONGEST + 1, length - off), length + off + 1):
                for hashes in _pieces(sums, wanted, most, off):
                    yield np.repeat(some, hashes.shape[1]), hashes.ravel()
