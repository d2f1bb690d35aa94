"""Word shingles of texts as 64-bit hashes."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .arrow import words

WORDS = 5
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Stands for the missing words of a text with fewer than five.
PAD = np.uint64(0x27D4EB2F165667C5)


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One hash from several, in order."""
    acc = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        acc = (acc ^ part) * PRIME
        acc ^= acc >> np.uint64(29)
    return acc


def shingle_sets(strings: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A-Z are lower-cased, words are runs without ASCII white space. A text with fewer words than ``size`` has its whole
    sequence as one shingle, a text without words has none.
    """
    flat, count = words(pc.ascii_lower(strings))
    coded = flat.dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = np.concatenate([own[coded.indices.to_numpy()], np.full(size, PAD)]) if len(flat) else np.full(size, PAD)
    whole = mixed(*[hashes[k:k + len(flat)] for k in range(size)]) if len(flat) else hashes[:0]
    upto = np.concatenate([[0], np.cumsum(count)])
    sets = []
    for a, n in zip(upto[:-1].tolist(), count.tolist()):
        if n >= size:
            sets.append(np.unique(whole[a:a + n - size + 1]))
        elif n:
            sets.append(mixed(*[hashes[a + k:a + k + 1] if k < n else np.array([PAD]) for k in range(size)]))
        else:
            sets.append(hashes[:0])
    return sets
