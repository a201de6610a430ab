"""Hashed word shingles and one-permutation signatures of Arrow batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is a block of its own.
BLOCK = 1 << 18
#: Bytes of a block that are hashed at a time; a word that goes on is carried over, so memory does not grow by the byte.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits (the splitmix64 finaliser)."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _byte_values() -> np.ndarray:
    """Value of each byte with A-Z as a-z; 0 marks the white space 0x20 and 0x09-0x0D."""
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    out = mix(low, 7)
    out[[0x20, *range(0x09, 0x0E)]] = 0
    return out


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts that lie one after another in data, and how many words each text has."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    up, down = _powers(SLICE)
    begins = starts[starts < len(data)]
    sums: list[np.ndarray] = []
    places: list[np.ndarray] = []
    going = 0  # bytes so far of a word that touches the slice's begin
    for base in range(0, len(data), SLICE):
        value = _byte_values()[data[base : base + SLICE]]
        inside = value != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        here = begins[np.searchsorted(begins, base) : np.searchsorted(begins, base + len(value))] - base
        if going and not (len(here) and here[0] == 0):
            first[0] = False
        first[here] = inside[here]
        at = np.flatnonzero(first)
        value *= up[: len(value)]
        if going and not first[0]:
            # Of what stands before the slice's first new word, only bytes of the word that goes on count.
            sums[-1][-1:] += value[: at[0] if len(at) else None].sum(dtype=np.uint64, keepdims=True) * np.uint64(pow(_BASE, going, 1 << 64))
        if len(at):
            sums.append(np.add.reduceat(value, at) * down[at])
            places.append(at + base)
            going = len(value) - int(at[-1]) if inside[-1] else 0
        else:
            going = going + len(value) if inside[-1] else 0
    at = np.concatenate(places) if places else np.empty(0, np.int64)
    count = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    return (mix(np.concatenate(sums)) if sums else np.empty(0, np.uint64)), count


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: every `width` words in a row, or all words if there are fewer."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        words, count = word_hashes(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
        ends = np.cumsum(count)
        folded = words.copy()
        if len(words) >= width:
            rolled = words[: len(words) - width + 1]
            for k in range(1, width):
                rolled = mix(rolled * np.uint64(_BASE) + words[k : len(words) - width + 1 + k], 1)
            folded[: len(rolled)] = rolled
        for begin, end in zip(ends - count, ends, strict=True):
            if end - begin >= width:
                found = folded[begin : end - width + 1]
                found.sort()
                yield found[np.append(True, found[1:] != found[:-1])]
            elif end > begin:
                one = words[begin : begin + 1]
                for k in range(begin + 1, end):
                    one = mix(one * np.uint64(_BASE) + words[k : k + 1], 1)
                yield mix(one, 2 + int(end - begin))
            else:
                yield words[:0]
        i = j


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits of a set, from sums of independently mixed hashes."""
    return mix(hashes, 11).sum(dtype=np.uint64).tobytes() + mix(hashes, 13).sum(dtype=np.uint64).tobytes()


@cache
def _donors(bins: int, attempts: int) -> np.ndarray:
    """For each bin the bins that it asks in turn, from a hash of (bin, attempt) that all documents share."""
    key = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(attempts) + np.arange(attempts, dtype=np.uint64)[None, :]
    return (mix(key, 17) >> np.uint64(33)).astype(np.int64) % bins


def one_permutation(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signature: the least hash in each bin; an empty bin copies the first full bin that its own
    hash sequence names (optimal densification), so that equal sets agree everywhere and two sets agree in a bin with
    the probability of their Jaccard similarity."""
    spread = mix(hashes, 19)
    least = np.full(bins, _MASK, np.uint64)
    np.minimum.at(least, ((spread >> np.uint64(40)) % np.uint64(bins)).astype(np.int64), spread)
    full = least != np.uint64(_MASK)
    if full.all():
        return least
    empty = np.flatnonzero(~full)
    donor = np.full(bins, np.flatnonzero(full)[0])
    asked, left, begin, end = _donors(bins, 16 * bins), empty, 0, 4
    while len(left) and begin < asked.shape[1]:
        few = asked[left, begin:end]
        hit = full[few]
        found = hit.any(1)
        donor[left[found]] = few[found, hit[found].argmax(1)]
        left, begin, end = left[~found], end, 4 * end
    least[empty] = mix(least[donor[empty]], 0)
    return least


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One key for each `rows` bins; the band's number is part of it."""
    grid = signature.reshape(-1, rows)
    key = mix(np.arange(len(grid), dtype=np.uint64), 23)
    for k in range(rows):
        key = mix(key * np.uint64(_BASE) + grid[:, k], 29)
    return key.astype(np.int64)
