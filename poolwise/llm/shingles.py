"""Word shingles of whole texts as 64-bit hashes, in numpy.

A word is a run of letters, digits or underscores, lower-cased.  A text of five words or more has one
shingle for each five consecutive words; a shorter one has a single shingle of all its words; one without
words has none.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash

WIDTH = 5
_WORD = re.compile(r"\w+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """The eight bytes of each word's hash; emptied when it holds too many words."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 150_000:
            self.clear()
        out = self[word] = xxhash.xxh64_digest(word)
        return out


_WORDS = _WordHashes()


def forget() -> None:
    """Give back the memory of word hashes; for the end of a task, as workers live on."""
    _WORDS.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose result bits look random (the splitmix64 finaliser)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    return np.frombuffer(b"".join(map(_WORDS.__getitem__, _WORD.findall(text.lower()))), dtype="<u8")


def shingles(words: Sequence[np.ndarray], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(document index, shingle hash) of all shingles of texts given as word hashes, in order."""
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    flat = np.concatenate([*words, np.zeros(width, np.uint64)])
    starts = np.cumsum(lengths) - lengths
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(words)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[doc]
    left = (starts + lengths)[doc] - at
    out = np.zeros(len(doc), np.uint64)
    for k in range(width):
        # words beyond the end of a short text count as zero
        out = mix(out ^ np.where(left > k, flat[at + k], np.uint64(0)))
    return doc, out


def counted(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with their multiplicity, by document."""
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    return doc[first], shingle[first], np.diff(np.append(first, len(doc)))


def units(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of (shingle, which occurrence): as sets these overlap as the multisets do."""
    _, found = shingles([word_hashes(text)], width)
    found = np.sort(found)
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    first = np.flatnonzero(new)
    nth = np.arange(len(found)) - np.repeat(first, np.diff(np.append(first, len(found))))
    return np.sort(mix(found + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
