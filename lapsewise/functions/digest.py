"""MD5 of many short pieces of one text at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np

TOGETHER = 1 << 15     # messages whose rounds run side by side
SLOTS = 19             # binary digits of the number of pieces that are remembered
LONGEST = 55           # bytes of a message that is a single block

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_PLACE = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]


def _rounds(message: dict[int, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """First two words of the digests of ``n`` blocks; words that ``message`` does not name are zero."""
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in _START)
    f, t = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, np.uint32(_SINES[i]), out=f)
        if _PLACE[i] in message:
            np.add(f, message[_PLACE[i]], out=f)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=t)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def _packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.byteswap().astype(np.int64) << 1 | (b >> np.uint32(4) & np.uint32(1))


class Digests:
    """``2 * place + sign`` of pieces of a text: place is the number that the first 8 hex digits of the MD5 make, sign the lowest bit of the ninth.

    Pieces of up to 7 bytes are remembered in a table of fixed size, where a new piece takes the slot of an old one.
    """

    def __init__(self, slots: int = SLOTS):
        self.shift = np.uint64(64 - slots)
        self.keys, self.values = np.zeros(1 << slots, dtype=np.uint64), np.zeros(1 << slots, dtype=np.int64)

    def of(self, text: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For the pieces of ``text`` that begin at ``start`` and have ``size`` bytes."""
        padded = np.frombuffer(text + bytes(8), dtype=np.uint8)
        eight = np.zeros(len(text) + 1, dtype=np.uint64)  # the 8 bytes from each place on
        for k in range(8):
            eight |= padded[k:k + len(eight)].astype(np.uint64) << np.uint64(8 * k)
        out = np.empty(len(start), dtype=np.int64)
        for lo in range(0, len(start), 4 * TOGETHER):
            at, n = start[lo:lo + 4 * TOGETHER], size[lo:lo + 4 * TOGETHER]
            found, brief = out[lo:lo + 4 * TOGETHER], n <= 7
            if brief.all():
                found[:] = self._brief(eight[at], n)
                continue
            found[brief] = self._brief(eight[at[brief]], n[brief])
            for least, most in ((8, 23), (24, LONGEST)):
                some = np.flatnonzero((n >= least) & (n <= most))
                for k in range(0, len(some), TOGETHER):
                    part = some[k:k + TOGETHER]
                    found[part] = self._block(eight, at[part], n[part], most // 4 + 1)
            for i in np.flatnonzero(n > LONGEST):
                h = hashlib.md5(text[at[i]:at[i] + n[i]]).digest()
                found[i] = int.from_bytes(h[:4]) << 1 | h[4] >> 4 & 1
        return out

    def _brief(self, eight: np.ndarray, size: np.ndarray) -> np.ndarray:
        bits = size.astype(np.uint64) << np.uint64(3)
        end = np.uint64(1) << bits
        keys = eight & (end - np.uint64(1)) | end << np.uint64(7)  # the padded message itself
        slot = keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift
        values = self.values[slot]
        new = np.flatnonzero(self.keys[slot] != keys)
        for k in range(0, len(new), TOGETHER):
            part = new[k:k + TOGETHER]
            own = keys[part]
            message = {0: (own & np.uint64(0xFFFFFFFF)).astype(np.uint32), 1: (own >> np.uint64(32)).astype(np.uint32), 14: bits[part].astype(np.uint32)}
            values[part] = _packed(*_rounds(message, len(part)))
            # of two that take one slot the last stays, in both
            self.keys[slot[part]], self.values[slot[part]] = own, values[part]
        return values

    def _block(self, eight: np.ndarray, start: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
        message = {14: (size << 3).astype(np.uint32)}
        for w in range(words):
            left = np.clip(size - 4 * w, 0, 4).astype(np.uint64) << np.uint64(3)
            word = eight[np.minimum(start + 4 * w, len(eight) - 1)] & ((np.uint64(1) << left) - np.uint64(1))
            ends = (size >= 4 * w) & (size < 4 * w + 4)
            message[w] = (word | np.where(ends, np.uint64(0x80) << np.minimum(left, np.uint64(24)), np.uint64(0))).astype(np.uint32)
        return _packed(*_rounds(message, len(start)))
