"""Words of many texts at once, as 64-bit hashes, in numpy.

The bytes of a slice of texts lie in one array; a word's hash is the difference of two prefix
sums of a polynomial (modulo 2**64) over the bytes, so no Python object per word is made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MULT = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: ASCII white space: the words are runs of anything else.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: Everything in ASCII but letters and digits, for operators that drop punctuation.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
                done += step
        have = _powers[base] = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Ranges:
    """Hashes of ranges [a, b) of a sequence of 64-bit values, equal for equal content."""

    def __init__(self, values: np.ndarray, base: int = _MULT):
        self.inverse = _power(pow(base, -1, 2**64), len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * _power(base, len(values) + 1)[: len(values)], out=self.sums[1:])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of a slice. `bounds[d]:bounds[d + 1]` are the words of text d."""

    data: np.ndarray  #: bytes of all texts, one separator after each
    text_start: np.ndarray  #: where each text starts in data; one more for the end
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    ranges: Ranges

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte flag over each text."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.text_start[1:]] - total[self.text_start[:-1]]

    def per_word_sum(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each text."""
        total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the k-word windows inside one text, and the windows' hashes."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        doc = self.doc
        at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        return at, Ranges(self.hashes).hash(at, at + k)


def words(texts: list[str], separators: np.ndarray = SPACE) -> Words:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    text_start = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=text_start[1:])
    if len(data) == 0:
        data = np.frombuffer(b"\n", dtype=np.uint8)
    gap = np.ones(len(data) + 1, dtype=np.int8)
    gap[1:] = separators[data]
    edge = np.diff(gap)
    start = np.flatnonzero(edge == -1)
    end = np.flatnonzero(edge == 1)
    bounds = np.searchsorted(start, text_start)
    ranges = Ranges(_BYTE[data])
    return Words(data, text_start, start, end, bounds, ranges.hash(start, end), ranges)
