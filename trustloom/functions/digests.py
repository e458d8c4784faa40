"""The numbers of ``scalar.hash_draw`` for many short texts at a time, inside tasks: a step of MD5 is taken for all of them
at once, and no text is written."""

from __future__ import annotations

import hashlib

import numpy as np

# Steps of MD5: turns, addends, start and which word of the block is added.
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_ADDENDS = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_WORD = [(f * i + s) % 16 for f, s in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_BAR, _END = np.uint64(ord("|")), np.uint64(0x80)
# Texts that fit one block have at most so many bytes before the numbers, which have at most 7 digits.
LONGEST_HEAD, NUMBERS = 40, 10_000_000
# Numbers whose digits are held.
_HELD = 1 << 16


def _md5(words: list[np.ndarray | None]) -> list[np.ndarray]:
    """The four words of the digests of one block each, given as its 16 words; None is zero."""
    n = len(words[14])
    a, b, c, d = (np.full(n, x) for x in _START)
    f, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        a += f
        a += _ADDENDS[i]
        if words[_WORD[i]] is not None:
            a += words[_WORD[i]]
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(a, np.uint32(32 - turn), turned)
        np.left_shift(a, np.uint32(turn), a)
        a |= turned
        a += b
        a, b, c, d = d, a, b, c
    return [x + s for x, s in zip((a, b, c, d), _START)]


def _digits(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal texts of numbers below ``NUMBERS``, their first digit in the lowest byte, and how long they are."""
    left = numbers.astype(np.uint64)
    text, length = np.zeros(len(left), np.uint64), np.zeros(len(left), np.int64)
    while not length.all() or left.any():
        rest = left // 10
        more = (left > 0) | (length == 0)
        text = np.where(more, text << 8 | (left - rest * 10 + 48), text)
        length += more
        left = rest
    return text, length


def _placed(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What of an 8-byte text stands in an 8-byte word if it begins ``at`` bytes after the word's begin."""
    right = (np.maximum(-at, 0) * 8).astype(np.uint64)
    return (text << (np.maximum(at, 0) * 8).astype(np.uint64)) >> right


class Heads:
    """Beginnings of texts ``seed|id|``, to which two numbers are added with a bar between them."""

    _held: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, heads: list[str]):
        self.texts = [h.encode() for h in heads]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.words = np.array([t[:56] for t in self.texts], "S56").view("<u8").reshape(-1, 7)

    @classmethod
    def _written(cls, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if numbers.max() >= _HELD:
            return _digits(numbers)
        if cls._held is None:
            cls._held = _digits(np.arange(_HELD))
        return cls._held[0][numbers], cls._held[1][numbers]

    def draws(self, of: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both 60-bit numbers of the digest of ``heads[of]first|second``, for numbers not below 0."""
        short = (self.size[of] <= LONGEST_HEAD) & (first < NUMBERS) & (second < NUMBERS)
        if short.all():
            return self._of_short(of, first, second)
        found = np.empty((2, len(of)), np.uint64)
        if short.any():
            found[:, short] = self._of_short(of[short], first[short], second[short])
        for i in np.flatnonzero(~short):
            digest = hashlib.md5(b"%b%d|%d" % (self.texts[of[i]], first[i], second[i])).hexdigest()
            found[:, i] = int(digest[:15], 16), int(digest[15:30], 16)
        return found[0], found[1]

    def _of_short(self, of: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (a, a_size), (b, b_size) = self._written(first), self._written(second)
        a, b = a | _BAR << (a_size * 8).astype(np.uint64), b | _END << (b_size * 8).astype(np.uint64)
        a_at = self.size[of]
        b_at = a_at + a_size + 1
        size = b_at + b_size
        words: list[np.ndarray | None] = [None] * 16
        begins, ends = (a_at.min(), b_at.min()), (b_at.max(), size.max() + 1)
        for k in range(int(size.max()) // 8 + 1):
            word = self.words[of, k]
            for text, at, begin, end in zip((a, b), (a_at, b_at), begins, ends):
                if begin < 8 * k + 8 and end > 8 * k:
                    word |= _placed(text, at - 8 * k)
            words[2 * k], words[2 * k + 1] = word.astype(np.uint32), (word >> 32).astype(np.uint32)
        words[14] = (size * 8).astype(np.uint32)
        w, x, y, z = (part.byteswap().astype(np.uint64) for part in _md5(words))
        left, right = w << 32 | x, y << 32 | z
        return left >> 4, (left & 15) << 56 | right >> 8
