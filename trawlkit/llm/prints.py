"""Hashes of words and shingles, and the majority bits over them, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import xxhash

from trawlkit.llm.common import ASCII_LOWER

SEED = 42
#: Hashes whose bits are summed at a time.
RUN_HASHES = 1 << 19


def text_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []


def mixed(z: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words over all places."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bit_sums(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[text, bit]: how many of a text's hashes have the bit set; ``hashes`` lie text after text.

    Blocks of 64 words are transposed as bit matrices, so that each sum is a
    count of the bits of a few words.
    """
    blocks = -(-counts // 64)
    first = np.concatenate(([0], np.cumsum(blocks)))
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    grid = np.zeros(int(first[-1]) * 64, dtype=np.uint64)
    grid[np.repeat(first[:-1] * 64, counts) + place] = hashes
    grid = grid.reshape(-1, 64)
    half, mask = 32, np.uint64(0xFFFFFFFF)
    while half:
        pairs = grid.reshape(len(grid), 32 // half, 2, half)
        low, high = pairs[:, :, 0, :], pairs[:, :, 1, :]
        moved = ((low >> np.uint64(half)) ^ high) & mask
        high ^= moved
        low ^= moved << np.uint64(half)
        half >>= 1
        if half:
            mask ^= mask << np.uint64(half)
    sums = np.zeros((len(counts), 64), dtype=np.int64)
    live = np.flatnonzero(counts)
    if len(live):
        sums[live] = np.add.reduceat(np.bitwise_count(grid), first[:-1][live], axis=0, dtype=np.int64)
    return sums


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the bits set in over half of its hashes; 0 for a text without any."""
    sums = np.zeros((len(counts), 64), dtype=np.int64)
    ends = np.cumsum(counts)
    at = 0
    while at < len(hashes):
        upto = min(len(hashes), at + RUN_HASHES)
        a, b = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, upto, side="left") + 1
        own = np.minimum(ends[a:b], upto) - np.maximum(ends[a:b] - counts[a:b], at)
        sums[a:b] += bit_sums(hashes[at:upto], np.maximum(own, 0))
        at = upto
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def joined_hashes(texts: list[list[bytes]], shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many are each text's): XXH64 of every shingle, its words joined by a space; a shorter text is one shingle."""

    def each() -> Iterator[bytes]:
        for w in texts:
            if len(w) >= shingle:
                yield from map(b" ".join, zip(*(w[k:] for k in range(shingle))))
            elif w:
                yield b" ".join(w)

    counts = np.array([max(1, len(w) - shingle + 1) if w else 0 for w in texts], dtype=np.int64)
    return np.fromiter(map(xxhash.xxh64_intdigest, each(), repeat(seed)), dtype=np.uint64, count=int(counts.sum())), counts


def shingle_sets(texts: list[list[bytes]], shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many are each text's): the distinct shingles of each text, in order, as mixes of their words' XXH64; a shorter text is one shingle."""
    n = np.array([len(w) for w in texts], dtype=np.int64)
    total = int(n.sum())
    word = np.fromiter(map(xxhash.xxh64_intdigest, (x for w in texts for x in w), repeat(seed)), dtype=np.uint64, count=total)
    starts = np.cumsum(n) - n
    ends = starts + n
    held, whole = word, word.copy()
    full = np.ones(total, dtype=bool)
    for k in range(1, shingle):
        ending = starts[n == k]
        whole[ending] = held[ending] + np.uint64(k)
        if total > k:
            held = np.concatenate((mixed(held[: total - k]) + word[k:], held[total - k :]))
        full[ends[n >= k] - k] = False
    few = (n > 0) & (n < shingle)
    held = held.copy()
    held[starts[few]] = whole[starts[few]]
    full[starts[few]] = True
    held = mixed(held[full])
    counts = np.where(few, 1, np.maximum(n - shingle + 1, 0))
    at = 0
    for c in counts.tolist():
        held[at : at + c].sort()
        at += c
    fresh = np.ones(len(held), dtype=bool)
    fresh[1:] = held[1:] != held[:-1]
    fresh[(np.cumsum(counts) - counts)[counts > 0]] = True
    sizes = np.zeros(len(n), dtype=np.int64)
    live = np.flatnonzero(counts)
    if len(live):
        sizes[live] = np.add.reduceat(fresh, (np.cumsum(counts) - counts)[live], dtype=np.int64)
    return held[fresh], sizes


def sketches(hashes: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """[text, word]: SimHashes of ``words`` 64-bit words over the texts' hashes."""
    out = np.zeros((len(counts), words), dtype=np.uint64)
    for j in range(words):
        out[:, j] = majority(hashes, counts)
        hashes = mixed(hashes + np.uint64(0x9E3779B97F4A7C15))
    return out
