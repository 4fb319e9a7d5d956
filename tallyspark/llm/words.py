"""Words and their hashes: words are what white space separates, as bytes; hashes are 64-bit and the same in every task."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n neighbours in h; none where h is shorter than n."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out = (out ^ (out >> np.uint64(29))) * _A + h[i : len(h) - n + 1 + i] * _B
        out ^= out >> np.uint64(32)
        out *= _C
        out ^= out >> np.uint64(29)
    return out


#: Longest stretch of bytes hashed at once; of a longer word only so many bytes count.
STRETCH = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_TO_SPACE = bytes(32 if s else i for i, s in enumerate(_IS_SPACE.tolist()))
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (int(_A), pow(int(_A), -1, 2**64)):
            x = np.full(STRETCH + 1, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x))
    return _POWERS


def measured(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words joined by one space, and where each begins and ends in those bytes."""
    raw = (text or "").encode()
    inside = np.zeros(len(raw) + 2, bool)
    np.logical_not(_IS_SPACE[np.frombuffer(raw, np.uint8)], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[0::2], edges[1::2]
    if not len(begin):
        return b"", begin, end
    if begin[0] == 0 and end[-1] == len(raw) and bool((begin[1:] - end[:-1] == 1).all()):
        return raw.translate(_TO_SPACE), begin, end
    size = end - begin
    end = np.cumsum(size + 1) - 1
    return b" ".join(raw.split()), end - size, end


def ordering_hashes(whole: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each word, by sums over all bytes at once. Good for order and buckets, not for telling words apart."""
    up, down = _powers()
    b = np.frombuffer(whole, np.uint8)
    out = np.empty(len(begin), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(begin):
            a = int(begin[i])
            j = max(i + 1, int(np.searchsorted(end, a + STRETCH, "right")))
            n = min(int(end[j - 1]) - a, STRETCH)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((b[a : a + n] + np.uint64(1)) * up[:n], out=sums[1:])
            s, e = begin[i:j] - a, np.minimum(end[i:j] - a, n)
            out[i:j] = (sums[e] - sums[s]) * down[s]
            i = j
        out ^= out >> np.uint64(32)
        out *= _C
    return out
