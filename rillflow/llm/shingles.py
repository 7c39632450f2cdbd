"""Sets of word shingles and their signatures, in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from rillflow.llm.common import U, mixed, slices, window_hashes, word_spans


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles of ``width`` words.

    Words stand between ASCII white space, A-Z in lower case. A text of fewer words is one shingle; a text
    without words has none.
    """
    for a, b in slices(np.array([len(t) for t in texts], np.int64)):
        joined = b"\n".join(texts[a:b])
        starts, _, words = word_spans(np.frombuffer(joined, np.uint8))
        sizes = np.array([len(t) + 1 for t in texts[a:b]], np.int64)
        cut = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])).tolist()
        windows = window_hashes(words, width)
        for i, j in zip(cut, cut[1:]):
            if j - i >= width:
                yield np.unique(windows[i : j - width + 1])
            elif j > i:
                yield window_hashes(words[i:j], j - i) ^ U(j - i)
            else:
                yield np.empty(0, np.uint64)


def families(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of ``n`` universal hash functions ``a * x + b`` modulo 2^32."""
    draw = np.random.default_rng(seed)
    factors = draw.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)
    return factors[:, None], draw.integers(0, 1 << 32, n, np.uint32)[:, None]


def signature(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    x = (hashes >> U(32)).astype(np.uint32)
    out = None
    for i in range(0, len(x), 1024):
        least = (factors * x[None, i : i + 1024] + offsets).min(axis=1)
        out = least if out is None else np.minimum(out, least)
    return out


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, whatever their order."""
    other = mixed(hashes ^ U(0x5851F42D4C957F2D))
    total = int(hashes.sum(dtype=np.uint64)) ^ len(hashes), int(np.bitwise_xor.reduce(other)) if len(other) else 0
    return tuple(int(np.int64(np.uint64(v & 0xFFFFFFFFFFFFFFFF).view(np.int64))) for v in total)


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of ``rows`` minima of each signature."""
    n, width = signatures.shape
    parts = signatures.reshape(n, width // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(width // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        key *= U(0x9E3779B97F4A7C15)
        key ^= key >> U(31)
        key += parts[:, :, i]
    return mixed(key).view(np.int64)
