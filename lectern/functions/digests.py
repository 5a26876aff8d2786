"""MD5 of every beginning with every end, computed on whole arrays: a hash costs a few hundred operations of numpy's, not a call."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: What one block of MD5 holds beside its own nine bytes.
BLOCK = 55
#: Hashes that are computed at once: few enough that the arrays stay in a core's cache.
AT_ONCE = 65536


class Ends:
    """The ends of texts, as words of four bytes for each place in a word at which they can begin."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.sizes = texts, np.array([len(t) for t in texts], np.uint32)
        self._words: dict[int, np.ndarray] = {}

    def words(self, shift: int) -> np.ndarray:
        if shift not in self._words:
            width = (shift + int(self.sizes.max()) + 4) // 4 * 4
            padded = np.array([bytes(shift) + t + b"\x80" for t in self.texts], f"S{width}")
            self._words[shift] = np.ascontiguousarray(padded.view("<u4").reshape(len(self.texts), -1).T)
        return self._words[shift]


def first_words(begins: list[bytes], ends: Ends, room: np.ndarray) -> np.ndarray:
    """The first 32 bits of md5(begin + end), a row for each begin (all of one length), a column for each end; they order as the digests do.
    room: seven arrays of as many numbers at least, of which the result is one."""
    p, n = len(begins[0]), len(ends.texts)
    if p + int(ends.sizes.max()) > BLOCK:
        return np.array([[int.from_bytes(hashlib.md5(b + e).digest()[:4], "big") for e in ends.texts] for b in begins], np.uint32).reshape(len(begins), n)
    at, shift = divmod(p, 4)
    own = np.array([b + bytes(-p % 4) for b in begins], f"S{max(p + -p % 4, 4)}").view("<u4").reshape(len(begins), -1).T[:, :, None]
    tail = ends.words(shift)[:, None, :]
    # each word of the message: a number, a column, a row, or a column and a row that share no byte
    message: list[list] = [[] for _ in range(16)]
    for j in range(at + (shift > 0)):
        message[j].append(own[j])
    for j in range(len(tail)):
        message[at + j].append(tail[j])
    message[14].append((ends.sizes + np.uint32(p))[None, :] << np.uint32(3))

    shape = (len(begins), n)
    a, b, c, d = (np.full((1, 1), v, np.uint32) for v in _START)
    t, u, *free = (x[: len(begins) * n].reshape(shape) for x in room)
    for i in range(61):  # the last three steps do not change the first word
        turn, k = divmod(i, 16)
        if turn == 0:
            f, g = np.bitwise_xor(c, d, out=t), i
            f &= b
            f ^= d
        elif turn == 1:
            f, g = np.bitwise_xor(b, c, out=t), (5 * i + 1) % 16
            f &= d
            f ^= c
        elif turn == 2:
            f, g = np.bitwise_xor(b, c, out=t), (3 * i + 5) % 16
            f ^= d
        else:
            f, g = np.bitwise_not(d, out=t), 7 * i % 16
            f |= b
            f ^= c
        f += a
        sine = np.uint32(_SINES[i])
        if message[g]:
            f += message[g][0] + sine
            for m in message[g][1:]:
                f += m
        else:
            f += sine
        s = _TURNS[turn][k % 4]
        np.left_shift(f, np.uint32(s), out=u)
        f >>= np.uint32(32 - s)
        f |= u
        out = free.pop()
        np.add(f, b, out=out)
        if i > 3:  # before, it is a number that all begin with
            free.append(a)
        a, d, c, b = d, c, b, out
    # in the three steps left out b becomes the first word
    b += np.uint32(_START[0])
    return b.byteswap(inplace=True)


def smallest(begins: list[bytes], ends: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number of a begin, number of an end) that can be among the most ends of smallest md5(begin + end) of their begin:
    these, and any that has the last one's first 32 bits as well."""
    if not begins or not ends or most < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n, tails = len(ends), Ends(ends)
    most = min(most, n)
    bound = min((most + 3 * math.sqrt(most) + 3) / n, 1.0) * 2**32
    rows, columns, step = [], [], max(1, AT_ONCE // n)
    room = np.empty((7, min(step, len(begins)) * n), np.uint32)
    sizes = np.array([len(b) for b in begins])
    for size in np.unique(sizes):
        group = np.flatnonzero(sizes == size)
        for lo in range(0, len(group), step):
            part = group[lo : lo + step]
            hashes = first_words([begins[k] for k in part], tails, room)
            under = hashes <= np.uint32(min(bound, 2**32 - 1))
            few = np.flatnonzero(under.sum(1) < most)
            if len(few):
                under[few] = hashes[few] <= np.partition(hashes[few], most - 1, axis=1)[:, most - 1 : most]
            i, j = np.nonzero(under)
            order = np.lexsort((hashes[i, j], i))
            i, j = i[order], j[order]
            value, first = hashes[i, j], np.searchsorted(i, np.arange(len(part)))
            keep = value <= value[first + most - 1][i]
            rows.append(part[i[keep]])
            columns.append(j[keep])
    return np.concatenate(rows), np.concatenate(columns)
