"""Words and word hashes of whole Arrow text columns, without a Python object per word.

Null texts count as empty. A text is read as UTF-8 bytes; words are runs of bytes outside
the six ASCII spaces (0x09-0x0D and 0x20).
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of bytes: 0 parts words. Here all but the six ASCII spaces belong to words.
WORDS = np.ones(256, np.uint8)
WORDS[[9, 10, 11, 12, 13, 32]] = 0
#: Letters, digits and bytes of other scripts (1) against signs (2) and spaces.
SIGNS = WORDS * 2
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Letters, digits and bytes of other scripts alone.
LETTERS = (SIGNS == 1).astype(np.uint8)
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that one vector step works on, unless a single text is longer.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def of_worker(key: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps for its later tasks.

    Functions travel by value, so the globals of a task are its own, and large arrays there would
    stay until the worker happens to collect cycles.
    """
    kept = sys.modules.setdefault("segue_llm_of_worker", types.ModuleType("segue_llm_of_worker"))
    if not hasattr(kept, key):
        setattr(kept, key, make())
    return getattr(kept, key)


def _power(sign: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of the hash base (sign 1) or of its inverse (sign -1), modulo 2**64."""
    kept: dict[int, np.ndarray] = of_worker("powers", dict)
    if sign not in kept or len(kept[sign]) < n:
        base = _BASE if sign > 0 else pow(_BASE, -1, 1 << 64)
        p = np.full(max(n, CHUNK + 4096), base, np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if n > CHUNK + 4096:  # a single long word: not worth keeping
            return p[:n]
        kept[sign] = p
    return kept[sign][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and n + 1 offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if not len(column):
        return whole[:0], np.zeros(1, np.int64)
    return whole[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most ``limit`` bytes together; a longer text is a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, off: np.ndarray, kind: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words before it (n + 1 values).

    A word is a run of bytes of one nonzero ``kind`` inside a text.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    k = kind[data]
    edge = np.ones(len(data) + 1, bool)
    np.not_equal(k[1:], k[:-1], out=edge[1:-1])
    edge[off] = True
    word = k != 0
    starts = np.flatnonzero(edge[:-1] & word)
    return starts, np.flatnonzero(edge[1:] & word) + 1, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of the bytes of each span; spans are in order and don't overlap."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        a, b = starts[i], ends[j - 1]
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + _U(1)) * _power(1, b - a), out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * _power(-1, b - a)[s])
        i = j
    return out


def pair_hash(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    return mix(left * _U(0x9FB21C651E98DF25) + right * _U(0xD6E8FEB86659FD93) + _U(salt))


def run_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values of ``h``, by doubling; none if there are fewer."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    out, done, part, size = None, 0, h, 1
    while True:
        power = _U(pow(_BASE, size, 1 << 64))  # moves a hash past a run of this size
        if width & size:
            n = len(h) - done - size + 1
            out = part if out is None else out[:n] * power + part[done : done + n]
            done += size
        size *= 2
        if size > width:
            return mix(out)
        n = len(part) - size // 2
        part = part[:n] * power + part[size // 2 :]
