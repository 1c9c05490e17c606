"""Texts as NumPy arrays: code points, token hashes, rolling hashes and winnowing.

All functions work on whole chunks of texts at once, so that the cost per character
is a few array passes and not a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters handled in one array pass; a longer text makes a chunk of its own.
CHUNK = 400_000
#: Grams of a periodic run that keep their hash, one in so many.
STRIDE = 120
#: Stands between texts; no character has this code.
GAP = 0x110000
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def chunks(texts: list, limit: int = CHUNK) -> Iterator[list[int]]:
    """Indices of the non-empty strings, in groups of about ``limit`` characters."""
    group, total = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        if group and total + len(t) > limit:
            yield group
            group, total = [], 0
        group.append(i)
        total += len(t)
    if group:
        yield group


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a GAP after each, and the place where each starts."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    flat = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    flat[starts + lengths] = GAP
    return flat, starts


@lru_cache(1)
def word_table() -> np.ndarray:
    """Whether a code is a letter or digit."""
    table = np.zeros(GAP + 1, bool)
    table[:GAP] = np.fromiter((chr(i).isalnum() for i in range(GAP)), bool, GAP)
    return table


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 4096)
        row = np.full(size, base, np.uint64)
        row[0] = 1
        have = np.multiply.accumulate(row)
        if size <= 8 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running polynomial hash modulo 2**64, one longer than ``codes``."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes), _BASE), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end], the same wherever those codes stand."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix), _INV)[start]
    return mix(raw ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def tokens(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word token (maximal run of letters and digits)."""
    word = word_table()[codes]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, span_hash(prefix_hash(codes), start, end)


def gram_hash(codes: np.ndarray, k: int, period: int = 0) -> np.ndarray:
    """Hash of the k codes from each position; the highest value where they would cross a GAP.

    Inside a run that repeats itself every ``period`` codes or fewer only every STRIDE-th
    gram from its start and from its end keeps its hash, with the next ones up to its own
    period, else such runs would be nothing but anchors.  Runs of different length thus
    keep the same grams before what follows both and behind what precedes both.
    """
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    prefix = prefix_hash(codes)
    h = mix((prefix[k:] - prefix[:-k]) * powers(n, _INV))
    out = h.copy()
    if period and n > 1:
        again = np.zeros(n, np.int64)  # the shortest period
        for p in range(min(period, n - 1), 0, -1):
            again[p:][h[p:] == h[:-p]] = p
        place = np.arange(n)
        begin = np.maximum.accumulate(np.where(again > 0, 0, place))
        finish = np.minimum.accumulate(np.where(again > 0, n, place)[::-1])[::-1] - 1
        kept = ((place - begin) % STRIDE < again) | ((finish - place) % STRIDE < again)
        out[(again > 0) & ~kept] = np.uint64(0xFFFFFFFFFFFFFFFF)
    gaps = np.concatenate(([0], np.cumsum(codes == GAP)))
    out[gaps[k:] != gaps[:-k]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return out


def _slide(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over every window of w values (block-wise accumulation from both sides)."""
    n = len(x)
    padded = np.full(-(-n // w) * w + w, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - w + 1], ahead[w - 1 : n])


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the minimum of some window of ``w`` values (all ties).

    Depends on the content of the window only, so equal stretches of w values in two
    texts always have a position in common.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    if len(h) < w:
        return np.flatnonzero((h == h.min()) & (h != top)) if len(h) else np.empty(0, np.int64)
    low = _slide(h, w, np.minimum, top)
    # p is chosen if the largest of the minima of the windows around p is its own hash
    around = np.zeros(len(low) + 2 * (w - 1), np.uint64)
    around[w - 1 : w - 1 + len(low)] = low
    return np.flatnonzero((_slide(around, w, np.maximum, np.uint64(0)) == h) & (h != top))
