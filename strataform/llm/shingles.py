"""Word hashing over batches of texts: every text is hashed whole, in a few array passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0xD1342543DE82EF95)
_P_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: White space of `[\\x20\\x09-\\x0D]`.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 21)
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def pieces(texts: list[str | None], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `limit` characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range of `data`."""
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, A-Z lower-cased, and where each text's words begin.

    The second array has one more entry than there are texts.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    gap = _SPACE[data]
    start = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    end = np.flatnonzero(gap & np.r_[False, ~gap[:-1]])
    size = np.array([len(r) + 1 for r in raw], np.int64)
    bounds = np.searchsorted(start, np.r_[0, np.cumsum(size)])
    return span_hashes(data, start, end), bounds


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles of `width` words as sorted 64-bit hashes.

    A text of fewer words, but at least one, has its whole sequence as one shingle; a text
    without words has none.
    """
    h, bounds = word_hashes(texts)
    n = len(h) - width + 1
    if n > 0:
        joined = h[:n].copy()
        for k in range(1, width):
            joined = joined * _P + h[k : k + n]
        joined = mix(joined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(joined[a : b - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                with np.errstate(over="ignore"):
                    one = one * _STEP + x
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers: equal sets, equal signatures."""
    if not len(s):
        return 0, 0
    both = np.array([mix(s + _STEP).sum(), np.bitwise_xor.reduce(mix(s ^ _P)) + np.uint64(len(s))], np.uint64)
    return tuple(mix(both).view(np.int64).tolist())
