"""Hashes of all windows of a sequence, and sliding minima, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from granary.llm._words import LOWER, mix

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_TABLE = np.random.default_rng(6).integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PIECE = 1 << 20
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    while len(_POWERS[0]) < n:
        k = len(_POWERS[0])
        for i, base in enumerate((_BASE, _INVERSE)):
            _POWERS[i] = np.concatenate([_POWERS[i], _POWERS[i] * np.uint64(pow(base, k, 2**64))])
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes' random values times powers of the base, from nothing up to all."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(len(data))[0], out=out[1:])
    return out


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` bytes; equal windows have equal hashes."""
    n = len(sums) - width
    return mix((sums[width:] - sums[:-width]) * _powers(n)[1]) if n > 0 else np.zeros(0, np.uint64)


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, also: np.ndarray | int = 0) -> np.ndarray:
    """Hash of each span of bytes with its length and ``also``."""
    down = _powers(len(sums))[1]
    content = mix((sums[end] - sums[start]) * down[start])
    return mix(content + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + also * np.uint64(0xA0761D6478BD642F))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values, by minima from both ends of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of each text's words in order: A-Z lower-cased, parted by the bytes 09-0D and 20.

    All bytes are hashed at once, in pieces of about _PIECE that end between words.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw).translate(LOWER), np.uint8)
    begin = np.cumsum([0] + [len(b) + 1 for b in raw])
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        while end < len(data) and not _SPACE[data[end - 1]]:
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            # The last gap of the piece, or a longer piece where one word fills it.
            end = at + int(gaps[-1]) + 1 if len(gaps) else min(end + _PIECE, len(data))
        part = data[at:end]
        edge = np.diff(np.r_[True, _SPACE[part], True].astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        hashes.append(span_hash(prefix(part), first, last))
        starts.append(first + at)
        at = end
    found = np.concatenate(hashes)
    cut = np.searchsorted(np.concatenate(starts), begin)
    return [found[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def chunks(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of rows with about ``most`` in all, or one row of more."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))
