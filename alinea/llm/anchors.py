"""Where a text may repeat: every string of `length` bytes belongs to the anchor that its content alone chooses.

The anchor is the place of the smallest hash among the `gram`-byte strings inside it (the leftmost of equals), so equal strings
have equal anchors at equal distances. Neighbouring strings mostly share one: a stretch is a run of them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64."""
    inverse = np.uint64(pow(int(PRIME), -1, 1 << 64))
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, PRIME)])), np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, inverse)]))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def stretches(data: bytes, length: int, gram: int, block: int = 1 << 22) -> np.ndarray:
    """Columns: anchor's hash, content's hash (twice), first start, last start, anchor's place from the first start; in order.

    Strings from the first to the last start have the anchor; the content is all their bytes, data[first : last + length].
    A text of more than `block` starts is taken a block after the other; a stretch across their border comes in two parts.
    """
    n = len(data) - length + 1
    if n > block:
        parts = []
        for at in range(0, n, block):
            part = stretches(data[at : at + block + length - 1], length, gram, block)
            part[:, 3:5] += np.uint64(at)
            parts.append(part)
        return np.concatenate(parts)
    if n <= 0:
        return np.zeros((0, 6), "uint64")
    codes = np.frombuffer(data, "uint8").astype("uint64") + np.uint64(1)
    up, down = powers(1 << max(16, len(data).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[: len(data)])])
    hashes = mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    packed = (hashes >> np.uint64(26) << np.uint64(26)) | np.arange(len(hashes), dtype="uint64")
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        packed = np.minimum(packed[:-have], packed[have:])
        have *= 2
    if have < width:
        packed = np.minimum(packed[: n], packed[width - have : width - have + n])
    anchors = (packed & np.uint64((1 << 26) - 1)).astype(int)
    first = np.flatnonzero(np.diff(anchors, prepend=-1))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    ends = last + length
    content = (sums[ends] - sums[first]) * down[first]
    shape = (anchors[first] - first).astype("uint64") * np.uint64(1 << 32) + (last - first).astype("uint64")
    offsets = (anchors[first] - first).astype("uint64")
    return np.stack([hashes[anchors[first]], mixed(content + shape * PRIME), mixed(content ^ shape), first.astype("uint64"), last.astype("uint64"), offsets], axis=1)
