"""Vectorised text scanning: words, shingle and window hashes over whole batches of texts.

A batch of texts becomes one UTF-8 buffer; words are maximal runs of bytes other than
space and 0x09-0x0D.  Hashes are 64-bit: each word is a polynomial over mixed byte values,
finalised, and sequences of words are polynomials over the finalised word hashes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_C = 0xD6E8FEB86659FD93 | 1
_M64 = (1 << 64) - 1
_B_INV = pow(_B, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), element by element."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xA24BAED4963EE407))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[U(1)], np.full(n, base, dtype=np.uint64)]))


_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _POW.get(base)
    if have is None or len(have) <= n:
        have = _POW[base] = _powers(base, max(n, 1024))
    return have[: n + 1]


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A hash of values[start:end], or of what a table has for them, for each of many ascending, disjoint segments."""

    def of(lo: int, hi: int) -> np.ndarray:
        return values[lo:hi] if table is None else table[values[lo:hi]]

    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        # Cut where a segment ends, so that the tables of powers stay small.
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        n = hi - lo
        if n > 4 * _CHUNK:  # one giant segment: fold it piece by piece
            acc = 0
            for p in range(lo, hi, _CHUNK):
                v = of(p, min(hi, p + _CHUNK))
                acc = (acc * pow(_B, len(v), 1 << 64) + int((v * powers(_B, len(v))[: len(v)]).sum(dtype=np.uint64))) & _M64
            out[i:j] = U(acc)
            lens = np.array([n], dtype=np.uint64)
        else:
            total = np.empty(n + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(of(lo, hi) * powers(_B, n)[:n], out=total[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (total[e] - total[s]) * powers(_B_INV, n)[s]
            lens = (e - s).astype(np.uint64)
        out[i:j] = mix(out[i:j] + lens * U(0x8CB92BA72F3D8DD7))
        i = j
    return out


def buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts with a space after each, and the place where each begins (and the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    return data, np.concatenate([[0], np.cumsum(lens)])


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that ends with a space."""
    gap = np.concatenate([[True], _SPACE[data]])
    change = np.flatnonzero(gap[1:] != gap[:-1])
    return change[0::2], change[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return segment_hash(data, starts, ends, _VALUE)


def sequence_hashes(hashes: np.ndarray, n: int, mask: tuple[int, ...] | None = None, salt: int = 0) -> np.ndarray:
    """A hash for every n consecutive word hashes; a mask names the places that count."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.full(m, (salt * 0x9FB21C651E98DF25 + 1) & _M64, dtype=np.uint64)
    for k in range(n) if mask is None else mask:
        acc *= U(_C)
        acc += hashes[k : k + m]
    return mix(acc)


def doc_of(starts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each word, the number of the text that holds it."""
    return np.searchsorted(begins, starts, side="right") - 1


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8, a null as an empty text."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
