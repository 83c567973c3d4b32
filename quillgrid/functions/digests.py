"""Digests of many short messages at once, by numpy."""

from __future__ import annotations

import math

import numpy as np

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [np.uint32(int(abs(math.sin(k + 1)) * 2**32)) for k in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_TENS = 10 ** np.arange(1, 19)
#: Messages at a time, so that what a round touches stays near the processor.
_SOME = 1 << 13


def _first_word(words: list[np.ndarray | None]) -> np.ndarray:
    """The first 32 bits of the md5 (RFC 1321) of messages of one block, given as its 16 words; None are zeros."""
    a, b, c, d = (np.full(len(words[0]), x, np.uint32) for x in _START)
    for k in range(64):
        if k < 16:
            mixed, own = d ^ (b & (c ^ d)), k
        elif k < 32:
            mixed, own = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif k < 48:
            mixed, own = b ^ c ^ d, (3 * k + 5) % 16
        else:
            mixed, own = c ^ (b | ~d), 7 * k % 16
        mixed += a
        mixed += _SINES[k]
        if words[own] is not None:
            mixed += words[own]
        shift = np.uint32(_TURNS[k // 16][k % 4])
        a, d, c, b = d, c, b, b + ((mixed << shift) | (mixed >> (np.uint32(32) - shift)))
    return (a + np.uint32(_START[0])).byteswap()


def _digits(message: np.ndarray, at: int, numbers: np.ndarray, size: int) -> int:
    """Write numbers of ``size`` digits into the rows of ``message`` from ``at`` on; the row after them."""
    for row in range(at + size - 1, at - 1, -1):
        rest = numbers // 10
        message[row] = numbers - rest * 10 + 48
        numbers = rest
    return at + size


def md5_numbers(prefix: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of ``prefix:first:second`` of each pair of numbers from zero, as ``hashlib`` has them."""
    out = np.empty(len(first), np.int64)
    head = np.frombuffer(f"{prefix}:".encode(), np.uint8)
    for start in range(0, len(first), _SOME):
        x, y = first[start : start + _SOME], second[start : start + _SOME]
        sizes = np.searchsorted(_TENS, x, side="right") * 32 + np.searchsorted(_TENS, y, side="right")
        for kind in np.unique(sizes):
            own = np.flatnonzero(sizes == kind)
            message = np.zeros((64, len(own)), np.uint8)
            message[: len(head)] = head[:, None]
            end = _digits(message, len(head), x[own], int(kind) // 32 + 1)
            message[end] = ord(":")
            end = _digits(message, end + 1, y[own], int(kind) % 32 + 1)
            message[end], message[56] = 128, 8 * end & 255
            message[57] = 8 * end >> 8
            wide = [message[4 * k : 4 * k + 4].astype(np.uint32) for k in range(16) if k <= end // 4 or k == 14]
            joined = [w[0] | w[1] << np.uint32(8) | w[2] << np.uint32(16) | w[3] << np.uint32(24) for w in wide]
            out[start + own] = _first_word([*joined[:-1], *[None] * (14 - end // 4 - 1), joined[-1], None])
    return out
