"""Word shingles of whole texts as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Bytes of text hashed at once (a longer text makes a run of its own).
RUN_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random word for each byte; A-Z as a-z.
_BYTE = mix(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64) + np.uint64(1))
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, RUN_BYTES + (RUN_BYTES >> 2))
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            full = np.full(size, base, dtype=np.uint64)
            full[0] = 1
            _POWERS[name] = np.multiply.accumulate(full)
    return _POWERS["up"], _POWERS["down"]


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > RUN_BYTES:
            yield first, i
            first, held = i, 0
        held += int(n) + 1
    if first < len(sizes):
        yield first, len(sizes)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text (null: empty) the sorted distinct hashes of its shingles.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    for first, last in _runs(texts):
        part = texts.slice(first, last - first)
        yield from _of_run([x.encode() if x else b"" for x in part.to_pylist()], words)


def _of_run(raws: list[bytes], words: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(raws) + b" ", dtype=np.uint8)
    up, down = _powers(len(data))
    breaks = _BREAK[data]
    edge = np.flatnonzero(breaks[1:] != breaks[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    sizes = np.array([len(r) for r in raws], dtype=np.int64) + 1
    begins = np.cumsum(sizes) - sizes + 1
    at = np.searchsorted(starts, np.concatenate((begins, [begins[-1] + sizes[-1]])))
    joined = None
    if len(hashes) >= words:
        m = len(hashes) - words + 1
        joined = np.full(m, words, dtype=np.uint64)
        for i in range(words):
            joined = mix(joined * _ODD + hashes[i : i + m])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            yield np.unique(joined[a : b - words + 1])
        elif b > a:
            h = np.full(1, b - a, dtype=np.uint64)
            for i in range(a, b):
                h = mix(h * _ODD + hashes[i : i + 1])
            yield h
        else:
            yield np.zeros(0, dtype=np.uint64)
