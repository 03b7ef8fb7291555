"""Names of substrings by polynomials modulo a prime, many at once, and of the words of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from leafmill.llm.common import ASCII_SPACE

PRIME = (1 << 31) - 1
_P = np.uint64(PRIME)
_31, _32 = np.uint64(31), np.uint64(32)
#: Two bases, each with a value of every byte.
BASES = (1_000_003, 998_244_353)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64 bits: xors of shifts and odd products."""
    x = x ^ (x >> _32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> _32
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> _32
    return x


#: Bytes of text whose words are found at once.
SLICE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True
_LOWER = bytes(range(256)).lower()
_VALUES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) % (_P - np.uint64(1)) + np.uint64(1) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, up to 2 ** 32: twice the high bits added to the low ones, in place."""
    high = x >> _31
    x &= _P
    x += high
    return x


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By base its powers and those of its inverse, modulo the prime."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(17, (n - 1).bit_length())
        _POWERS.clear()
        for base in BASES:
            both = []
            for b in (base, pow(base, -1, PRIME)):
                out = np.ones(size, np.uint32)
                done = 1
                while done < size:
                    out[done : 2 * done] = out[:done].astype(np.uint64) * np.uint64(pow(b, done, PRIME)) % _P
                    done *= 2
                both.append(out)
            _POWERS.append((both[0], both[1]))
    return _POWERS


class Names:
    """Names of all substrings of one piece of text (below 2 ** 30 bytes), each in constant time.

    A name depends on the bytes and their number only: 62 bits of two polynomials modulo a prime, mixed, so that
    no two strings of at most n bytes share one with a chance of over n ** 2 / 2 ** 61.
    """

    def __init__(self, data: np.ndarray):
        self.parts = []
        for values, (up, down) in zip(_VALUES, _powers(len(data) + 1), strict=True):
            sums = np.zeros(len(data) + 1, np.uint64)
            terms = values[data]
            terms *= up[: len(data)]
            np.cumsum(folded(terms), out=sums[1:])
            self.parts.append((sums, down))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = None
        for sums, down in self.parts:
            x = sums[ends]
            x -= sums[starts]
            x = folded(folded(x))
            x *= down[starts]
            x = folded(folded(x))
            x[x >= _P] -= _P
            out = x if out is None else (out << _31) | x
        out ^= mix((ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return mix(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of all texts, A-Z lower-cased, and each text's number of words.

    Polynomials modulo a prime, from prefix sums, so all words are hashed at once.
    """
    data = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER), np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    blank = _SPACE[data]
    edge = np.diff(blank.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = Names(data).of(starts, ends)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return hashes, np.diff(bounds)


def text_words(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Word hashes of each text, of about SLICE bytes at once; a longer text is cut at white space."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > SLICE:
            parts, text, done = [], texts[at], 0
            while done < len(text):
                upto = done + SLICE
                while upto < len(text) and text[upto] not in ASCII_SPACE:
                    upto += 1
                parts.append(word_hashes([text[done:upto]])[0])
                done = upto
            yield np.concatenate(parts)
            at += 1
            continue
        size, upto = 0, at
        while upto < len(texts) and len(texts[upto]) <= SLICE and (size == 0 or size + len(texts[upto]) <= SLICE):
            size, upto = size + len(texts[upto]) + 1, upto + 1
        hashes, counts = word_hashes(texts[at:upto])
        yield from np.split(hashes, np.cumsum(counts)[:-1])
        at = upto
