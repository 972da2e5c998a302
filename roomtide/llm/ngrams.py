"""Hashed character n-grams of texts, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = 32
_PIECE = 1 << 18
_ASCII = np.array(
    [c if chr(c).isalpha() else _SPACE for c in range(128)] + [0], np.uint32
)


def letter_codes(text: str) -> np.ndarray:
    """Code points in lower case; ASCII that is no letter becomes a space, and runs of spaces one.
    A space stands at either end."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(raw < 128, _ASCII[np.minimum(raw, 128)], raw)
    codes = np.concatenate(([_SPACE], codes, [_SPACE])).astype(np.uint32)
    return codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))]


def hashed(
    codes: np.ndarray, sizes: tuple[int, ...], dims: int, starts: int | None = None
) -> np.ndarray:
    """The buckets (below `dims`, a power of two) of all n-grams of the given sizes that fit, or of
    those that begin at the first `starts` codes."""
    found, rolling = [], codes
    for size in range(1, max(sizes) + 1):
        if size > 1:
            rolling = rolling[:-1] * np.uint32(0x01000193) + codes[size - 1 :]
        if size in sizes:
            mixed = rolling[:starts] * np.uint32(0x9E3779B1) + np.uint32(size)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            mixed ^= mixed >> np.uint32(13)
            found.append(mixed & np.uint32(dims - 1))
    return np.concatenate(found)


def pieces(text: str, sizes: tuple[int, ...], dims: int) -> Iterator[np.ndarray]:
    """The buckets of a whole text's n-grams, each n-gram once, in parts of bounded size."""
    codes = letter_codes(text)
    for at in range(0, len(codes), _PIECE):
        yield hashed(codes[at : at + _PIECE + max(sizes) - 1], sizes, dims, _PIECE)


def bucket_counts(text: str, sizes: tuple[int, ...], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets a text has n-grams in, ascending, and how many."""
    counts = np.zeros(dims, np.int64)
    for buckets in pieces(text, sizes, dims):
        counts += np.bincount(buckets, minlength=dims)
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]
