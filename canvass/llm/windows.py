"""Names (64-bit ranks) of windows of token sequences, by prefix doubling, and their thinning.

A sequence is an array of numbers, one per token (bytes, or hashes of words).  The name of the
``n`` tokens from a position stands for their content: equal tokens have equal names, and two
different contents share a name with a chance of about 2**-64 per pair.  Names of length
``2n`` come from the pairs of names at offset ``n``, and any length in between from two names
that overlap, which is the step of prefix doubling.

Sorting a pair for every position costs many times the input.  ``segments`` therefore thins
the positions without losing a match: each window of ``width`` tokens elects the smallest name
among its pieces of ``piece`` tokens (leftmost on ties), a choice that depends on the window's
content alone, and neighbouring windows that elect the same position form one segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
# Odd constants of the mixing steps; any odd numbers with mixed bits would do.
LEFT, RIGHT, LAST = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
POSITION_BITS = 24
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * LAST
    return x ^ (x >> U(29))


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * LEFT + (right ^ (right >> U(31))) * RIGHT)


def names(tokens: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """For each of the lengths, ascending, the names of that many tokens from each position."""
    found, size, now = [], 1, mix(tokens.astype(U) * LEFT + RIGHT)
    for length in lengths:
        while size * 2 <= length:
            now = paired(now[:len(now) - size], now[size:]) if len(now) > size else now[:0]
            size *= 2
        if size == length:
            found.append(now)
        else:
            step = length - size
            found.append(paired(now[:len(now) - step], now[step:]) if len(now) > step else now[:0])
    return found


def window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    size, now = 1, keys
    while size * 2 <= width:
        now = np.minimum(now[:len(now) - size], now[size:])
        size *= 2
    step = width - size
    return np.minimum(now[:len(now) - step], now[step:]) if step else now


@dataclass
class Segments:
    """Runs of windows that elect the same piece; ``first`` and ``last`` are window starts."""

    owner: np.ndarray      # index of the sequence
    first: np.ndarray      # start of the first window, within the sequence
    last: np.ndarray       # start of the last window
    place: np.ndarray      # start of the elected piece, within the sequence
    anchor: np.ndarray     # name of the elected piece
    content: np.ndarray    # name of everything that the windows of the run cover
    prints: np.ndarray     # 8 bits of what stands left of the piece, 8 bits of what stands right


def pieces_of(lengths: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut long sequences so that each window lies whole in one cut: owner, start, length."""
    many = np.maximum(1, -(-(lengths - width + 1) // most))
    owner = np.repeat(np.arange(len(lengths)), many)
    order = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    start = order * most
    return owner, start, np.minimum(lengths[owner] - start, most + width - 1)


def segments(tokens: np.ndarray, lengths: np.ndarray, width: int, piece: int) -> Segments:
    """Segments of concatenated sequences of the given lengths; windows never cross sequences."""
    lengths = np.asarray(lengths, dtype=np.int64)
    begin = np.cumsum(lengths) - lengths
    long = np.flatnonzero(lengths >= width)
    owner, start, size = pieces_of(lengths[long], width, CHUNK)
    owner = long[owner]
    out, i = [], 0
    while i < len(owner):
        j, total = i, 0
        while j < len(owner) and (j == i or total + size[j] <= CHUNK):
            total += size[j]
            j += 1
        out.append(_chunk(tokens, begin, owner[i:j], start[i:j], size[i:j], width, piece))
        i = j
    if not out:
        empty = np.zeros(0, np.int64)
        return Segments(empty, empty, empty, empty, *np.zeros((3, 0), U))
    return Segments(*(np.concatenate([x[k] for x in out]) for k in range(7)))


def _chunk(tokens, begin, owner, start, size, width, piece):
    text = np.concatenate([tokens[b:b + n] for b, n in zip(begin[owner] + start, size, strict=True)])
    at = np.cumsum(size) - size
    half = (width - piece + 1) // 2
    short, side, full = names(text, [piece, piece + half, width])
    keys = (short >> U(POSITION_BITS) << U(POSITION_BITS)) | np.arange(len(short), dtype=U)
    elected = (window_minimum(keys, width - piece + 1) & U((1 << POSITION_BITS) - 1)).astype(np.int64)
    valid = np.zeros(len(text) + 1, np.int8)
    np.add.at(valid, at, 1)
    np.add.at(valid, at + size - width + 1, -1)
    valid = np.cumsum(valid[:len(full)]).astype(bool)
    opens = valid.copy()
    opens[1:] &= (elected[1:] != elected[:-1]) | ~valid[:-1]
    opens[at] = True
    closes = valid.copy()
    closes[:-1] &= opens[1:] | ~valid[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    which = np.searchsorted(at, first, side="right") - 1
    content = paired(full[first], full[last]) + (last - first).astype(U) * LEFT
    shift, chosen = start[which] - at[which], elected[first]
    # two segments that share a window share its left or its right half around the piece
    left = side[np.maximum(chosen - half, 0)] % U(255) + U(1)
    left[chosen - first < half] = 0
    right = side[np.minimum(chosen, len(side) - 1)] % U(255) + U(1)
    right[last + width - piece - chosen < half] = 0
    return owner[which], first + shift, last + shift, chosen + shift, short[chosen], mix(content), left << U(8) | right
