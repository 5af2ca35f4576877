"""BagMinHash signatures of multisets.

Weights are multiplicities.  The weight axis of a shingle is cut into octaves (0,1], (1,2], (2,4], ...;
each has its own Poisson process, seeded by shingle and octave, with a rate of the octave's width.  A point
of a process has a time, a place on the weight axis found by halving the octave down to one unit, and a
register; it counts if its place lies within the multiplicity.  A register keeps its earliest point, so two
multisets agree on it with the probability of their weighted Jaccard similarity.  Octaves below the
multiplicity count whole; only in the topmost are points thinned, at most half of the work.  Points are
generated in order of time up to a horizon at which registers are expected to be full; a document with an
empty register is done again with twice the horizon, so early stopping changes nothing in the result.
"""

from __future__ import annotations

import numpy as np

from poolwise.llm.shingles import mix

_STEP = 0xA0761D6478BD642F
_OCTAVE = 0xE7037ED1A0B428DB
_OTHER = np.uint64(0x8EBC6AF09C88C6E3)
_WORD = (1 << 64) - 1


def _processes(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, seed, rate, base place and multiplicity of each octave that a multiplicity reaches."""
    parts, k = [(doc, mix(shingle), np.ones(len(doc)), np.zeros(len(doc), np.int64), count)], 1
    while len(at := np.flatnonzero(count > (1 << (k - 1)))):
        low, salt = 1 << (k - 1), np.uint64(k * _OCTAVE & _WORD)
        parts.append((doc[at], mix(shingle[at] ^ salt), np.full(len(at), float(low)), np.full(len(at), low), count[at]))
        k += 1
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """(n_docs, registers) of uint32; rows of documents without shingles are zero."""
    out = np.zeros(n_docs * registers, np.uint32)
    weight = np.bincount(doc, weights=count, minlength=n_docs)
    horizon = registers * (np.log(registers) + 3) / np.maximum(weight, 1)
    todo = weight > 0
    owner, seed, rate, base, mult = _processes(doc, shingle, count)
    while todo.any():
        alive = np.flatnonzero(todo[owner]) if not todo.all() else np.arange(len(owner))
        own = owner[alive]
        # no point of a process lies before the horizon if its first one does not: no logarithm for these
        point = mix(seed[alive])
        near = (point >> np.uint64(32)).astype(np.float64) <= -np.expm1(-horizon[own] * rate[alive]) * 2.0**32
        alive, own, point = alive[near], own[near], point[near]
        first = np.full(n_docs * registers, np.iinfo(np.int64).max)
        time, found, j = np.zeros(len(alive)), [], 0
        while len(alive):
            high = point >> np.uint64(32)
            time = time - np.log1p(high.astype(np.float64) * -(2.0**-32)) / rate[alive]
            near = time <= horizon[own]
            alive, own, time, point, high = alive[near], own[near], time[near], point[near], high[near]
            low = point & np.uint64(0xFFFFFFFF)
            key = own * registers + ((low * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
            counts = np.flatnonzero(mult[alive] > 1)
            kept = slice(None)
            if len(counts):
                at = alive[counts]
                part = (mix(point[counts] ^ _OTHER) >> np.uint64(32)).astype(np.float64) * 2.0**-32
                kept = np.ones(len(alive), bool)
                kept[counts] = base[at] + (part * rate[at]).astype(np.int64) < mult[at]
            bits = time.view(np.int64)[kept]  # times are positive, so their bits are in their order
            np.minimum.at(first, key[kept], bits)
            found.append((key[kept], bits, high[kept].astype(np.uint32)))
            j += 1
            point = mix(seed[alive] + np.uint64(j * _STEP & _WORD))
        for key, bits, mark in found:
            best = bits == first[key]
            out[key[best]] = mark[best]
        todo &= (first.reshape(n_docs, registers) == np.iinfo(np.int64).max).any(1)
        horizon = horizon * 2
    return out.reshape(n_docs, registers)
