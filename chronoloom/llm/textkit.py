"""Vectorised word and shingle hashing over UTF-8 bytes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer document is one chunk.
CHUNK = 1 << 19
_U = np.uint64
_BASE, _MUL, _MIX, _LEN = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


class _State(dict):
    """A cache that doesn't travel: pickled, it is empty again."""

    def __reduce__(self):
        return _State, ()


_STATE = _State()


def _tables(n: int):
    """Random 64-bit values of the bytes, and powers of the base and of its inverse modulo 2**64 (at least n)."""
    if "byte" not in _STATE:
        _STATE["byte"] = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
        _STATE["space"] = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
        _STATE["inverse"] = _U(pow(int(_BASE), -1, 1 << 64))
    if len(_STATE.get("pow", ())) < n:
        size = max(n, CHUNK + 65536)
        with np.errstate(over="ignore"):
            _STATE["pow"] = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _BASE, _U)]), dtype=_U)
            _STATE["inv"] = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _STATE["inverse"], _U)]), dtype=_U)
    return _STATE["byte"], _STATE["space"], _STATE["pow"], _STATE["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _MIX
    h = (h ^ (h >> _U(27))) * _LEN
    return h ^ (h >> _U(31))


def chunks(texts: list[bytes], size: int = CHUNK):
    """Ranges (lo, hi) of texts with about size bytes each."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of texts: hash of each, first byte and end in the joined bytes, the texts' word offsets (one more than texts), and the joined bytes."""
    arr = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    byte, space, power, inverse = _tables(len(arr) + 1)
    inside = np.zeros(len(arr) + 1, np.int8)
    inside[1:] = ~space[arr]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    total = np.zeros(len(arr) + 1, _U)
    np.cumsum(byte[arr] * power[: len(arr)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    h = mix(h + (ends - starts).astype(_U) * _LEN)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return h, starts, ends, np.searchsorted(starts, bounds), arr


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows that begin at each word but the last k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _MUL + h[j : n + j]
    return mix(out)


def shingle_sets(texts: list[bytes], k: int = 5):
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; without words, none."""
    for lo, hi in chunks(texts):
        h, _, _, at, _ = words(texts[lo:hi])
        w = windows(h, k)
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            if b - a >= k:
                yield np.unique(w[a : b - k + 1])
            elif b > a:
                s = int(b - a)
                for x in h[a:b].tolist():
                    s = (s * int(_MUL) + x) % (1 << 64)
                yield mix(np.array([s], _U))
            else:
                yield np.zeros(0, _U)


def release() -> None:
    """Gives memory that the last batch no longer needs back to the system; a worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass
