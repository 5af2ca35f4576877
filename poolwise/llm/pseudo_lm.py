"""Documents scored by masked pseudo-likelihood.

Tokens are words (runs of characters other than white space).  The ``FREQUENT`` commonest words of the
corpus are classes of their own; others are classed by length, case and last character, and each such class
is divided by hash into members, the more the more distinct words there are.  A token's conditional
log-probability is that of its class, of its member in the class, and of the word in the member: its own count
by that of the member.  Each of the three is a distribution, so no token has more than probability 1.  The first
two depend on the words on either side; the sum over the document, every token predicted from both sides, is
its score.

A window network predicts the class: embeddings of the inner neighbours (by group of class) and of the outer
ones (coarser) and of the four neighbouring words themselves add up to a hidden layer, a softmax follows.  A
word's embedding is a hashed row for each place beside the token; rows grow with the distinct words.  The
member follows from the hidden layer of the groups and from random vectors of the inner neighbouring words, by
the Gaussian discriminant of its means.

One pass over the texts hashes their words into a staged table and counts them.  Three passes over that table
follow, none of which samples.  One counts windows of groups: their counts are a table of bounded size, on
which the network of groups is trained in numpy with full batches, which is the same as training on every
window in every step.  One sums the gradient of every window by rows of words, and the means of members: the
embeddings are a damped Newton step from the network of groups.  The last evaluates the network for every
token.  The two that sum run in few long tasks, since each task ends in a table of bounded size.  Counts of the
``TABLE`` commonest words are sent to the last pass; those of all others are joined.  Sums are of whole
numbers, and the last pass works with weights and hidden values on a grid that leaves nothing to round, so
results do not depend on the order of rows.

Defined cases: null, empty and blank texts have no tokens and the score 0 (per token: null); beyond the ends
of a text stands a class of its own; repeated rows get equal scores; an empty corpus gives an empty result;
equal counts are ordered by hash, so results do not depend on partitioning.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwise.llm.shingles import mix
from poolwise.llm.staging import ship, stage

FREQUENT, SHAPES = 63, 32
#: Class 0 stands beyond the ends of a text.
CLASSES = 1 + FREQUENT + SHAPES
#: Groups of classes by which an inner and an outer neighbour are told apart.
INNER, OUTER = 32, 4
SIDE = INNER * OUTER
#: Most words whose counts are sent to the last pass, rows of a place's embeddings, and members of a class; rows of random vectors, and their length.
TABLE, ROWS, MEMBERS, RANDOM, WIDE = 1 << 18, 1 << 15, 64, 1 << 14, 8
#: Windows that the prior of an embedding or mean is worth; units of one in sums of whole numbers, and steps of one of a hidden value.
PRIOR, UNIT, STEPS = 20.0, 256, 64
HIDDEN, EPOCHS, RATE, SEED = 16, 60, 0.03, 5
FEATURES = HIDDEN + 2 * WIDE
#: Places beside the token; an odd factor hashes a word for each, and two more for the random vectors.
_NEAR = (-1, 1, -2, 2)
_FACTORS = np.random.RandomState(3).randint(1 << 62, size=6, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK, _ROWS_AT_ONCE = 2048, 512
_BATCH_CHARS = 1 << 18
_BATCH_TOKENS = 1 << 17
#: Words of a piece of a long text.
_PIECE = 20_000


def _flags() -> np.ndarray:
    """Of each byte: 1 lower case or beyond ASCII, 2 capital, 4 digit, 8 other; 0 for white space."""
    out = np.full(256, 8, np.uint8)
    out[[*range(9, 14), *range(28, 33)]] = 0
    out[[*range(97, 123), *range(128, 256)]], out[65:91], out[48:58] = 1, 2, 4
    return out


_FLAGS = _flags()
_VALUES = np.where(_FLAGS > 0, np.arange(1, 257), 0).astype(np.uint64)
#: Bytes that white space beyond ASCII has (and other characters, too).
_ODD_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_BASE = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base = np.full(size, _BASE, np.uint64)
    inverse = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word of a text, and its hash, the lowest five bits of which are its shape."""
    data = np.frombuffer(raw, np.uint8)
    flags = _FLAGS[data]
    word = flags > 0
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    ends = np.flatnonzero(word & ~np.concatenate([word[1:], [False]]))
    power, inverse = _powers(1 << max(len(raw), _BATCH_CHARS * 2).bit_length())
    found = mix(np.add.reduceat(_VALUES[data] * power[: len(data)], starts) * inverse[starts])
    kinds = np.bitwise_or.reduceat(flags, starts)
    kind = np.where(kinds == 1, 0, np.where(kinds < 4, 1, np.where(flags[starts] < 4, 2, 3)))
    length = np.minimum(np.frexp((ends - starts + 1).astype(np.float32))[1], 4) - 1
    shape = length << 3 | kind << 1 | (flags[ends] == 8)
    return starts, found & np.uint64(~(SHAPES - 1) & 0xFFFFFFFFFFFFFFFF) | shape.astype(np.uint64)


def tokenize(texts: list[str]) -> list[np.ndarray]:
    """Hash of each token of each text.  A token is what ``str.split`` gives."""
    parts, of = [], []  # pieces of bounded size, and the text of each
    for k, text in enumerate(texts):
        raw = text.encode()
        if len(raw) > _BATCH_CHARS or any(x in raw for x in _ODD_SPACE):
            words = text.split()
            raw = [" ".join(words[i : i + _PIECE]).encode() for i in range(0, len(words), _PIECE)]
        else:
            raw = [raw]
        parts += raw
        of += [k] * len(raw)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    at = 0
    while at < len(parts):
        first, size = at, 0
        while at < len(parts) and (at == first or size + len(parts[at]) < 2 * _BATCH_CHARS):
            size += len(parts[at]) + 1
            at += 1
        starts, words = _hashed(b" ".join(parts[first:at]))
        cuts = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts[first:at]]))
        for k, piece in zip(of[first:at], np.split(words, cuts[:-1]), strict=True):
            out[k].append(piece)
    return [np.concatenate(x) if len(x) != 1 else x[0] for x in (y or [np.zeros(0, np.uint64)] for y in out)]


def shape_of(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(SHAPES - 1)).astype(np.int64)


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, texts = 0, batch.column(1)
        while at < len(batch):
            first, size, some = at, 0, []
            while at < len(batch) and size < _BATCH_CHARS:
                some.append(texts[at].as_py() or "")
                size += len(some[-1])
                at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), pa.array([w.tobytes() for w in tokenize(some)], pa.binary())], ["id", "words"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and words of runs of rows that have about ``_BATCH_TOKENS`` tokens."""
    for batch in batches:
        at, column = 0, batch.column(1)
        while at < len(batch):
            first, size, some = at, 0, []
            while at < len(batch) and size < _BATCH_TOKENS:
                some.append(np.frombuffer(column[at].as_buffer(), "<u8"))
                size += len(some[-1])
                at += 1
            yield batch.column(0).slice(first, at - first), some


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate(held)
        order = np.argsort(every)
        word, first = np.unique(every[order], return_index=True)
        return word, np.add.reduceat(np.concatenate(counts)[order], first) if len(word) else np.zeros(0, np.int64)

    def out(word: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], ["word", "n"])

    for _, some in _parts(batches):
        word, n = np.unique(np.concatenate(some), return_counts=True)
        held.append(word)
        counts.append(n)
        if sum(map(len, held)) > 1_000_000:
            word, count = merged()
            held[:], counts[:] = [word], [count]
            if len(word) > 400_000:
                yield out(word, count)
                held.clear()
                counts.clear()
    if held:
        yield out(*merged())


class Classes:
    """Class of each token."""

    def __init__(self, frequent: np.ndarray) -> None:
        order = np.argsort(frequent)
        self.sorted, self.place = frequent[order], order

    def __call__(self, words: np.ndarray) -> np.ndarray:
        shapes = 1 + FREQUENT + shape_of(words)
        if not len(self.sorted):
            return shapes
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, 1 + self.place[at], shapes)


def inner_group(c: np.ndarray) -> np.ndarray:
    """The 20 commonest words and the end by themselves, other common words by three groups, shapes by eight."""
    return np.where(c <= 20, c, np.where(c <= FREQUENT, 21 + (c - 21) * 3 // max(1, FREQUENT - 20), 24 + (c - FREQUENT - 1) // 4))


def outer_group(c: np.ndarray) -> np.ndarray:
    return np.where(c == 0, 0, np.where(c <= 20, 1, np.where(c <= FREQUENT, 2, 3)))


_NEAR_GROUP, _FAR_GROUP = inner_group(np.arange(CLASSES)), outer_group(np.arange(CLASSES))


class Windows:
    """Texts in one row with gaps of two between them: words, places of the tokens, their classes and contexts."""

    def __init__(self, texts: list[np.ndarray], classify: Classes) -> None:
        gap = np.zeros(2, np.uint64)
        self.flat = np.concatenate([gap, *(x for w in texts for x in (w, gap))])
        inside = np.ones(len(self.flat), bool)
        ends = np.cumsum([2, *(len(w) + 2 for w in texts)])
        inside[ends - 2] = inside[ends - 1] = False
        self.real = np.flatnonzero(inside)
        classes = np.zeros(len(self.flat), np.int64)
        self.words = self.flat[self.real]
        self.target = classes[self.real] = classify(self.words)
        near, far = _NEAR_GROUP[classes], _FAR_GROUP[classes]
        left = near[1:-3] * OUTER + far[:-4]
        right = near[3:-1] * OUTER + far[4:]
        #: (left, right) groups in one number.
        self.context = (left * SIDE + right)[self.real - 2]

    def slots(self, factor: int, rows: int) -> np.ndarray:
        """The row of each place of ``flat``; ``rows`` itself in gaps."""
        out = np.full(len(self.flat), rows)
        out[self.real] = row_of(self.words, factor, rows)
        return out

    def beside(self, random: np.ndarray) -> np.ndarray:
        """Random vectors of the inner neighbours of every token."""
        one, two = (self.slots(k, RANDOM) for k in (4, 5))
        return np.concatenate([random[one[self.real + near]] + random[two[self.real + near]] for near in (-1, 1)], 1)


def row_of(words: np.ndarray, factor: int, rows: int) -> np.ndarray:
    return ((words * _FACTORS[factor]) >> np.uint64(65 - rows.bit_length())).astype(np.int64)


def member_of(words: np.ndarray, members: int) -> np.ndarray:
    return ((words >> np.uint64(40)) % np.uint64(members)).astype(np.int64)


def _count_windows(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classes(frequent)
        total = None
        for _, some in _parts(batches):
            w = Windows(some, classify)
            cells, n = np.unique(w.context * CLASSES + w.target, return_counts=True)
            total = np.zeros(SIDE * SIDE * CLASSES, np.int32) if total is None else total
            total[cells] += n.astype(np.int32)
        if total is not None:
            cells = np.flatnonzero(total)
            for at in range(0, len(cells), 200_000):
                part = cells[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], ["cell", "n"])

    return run


def _features() -> np.ndarray:
    """Inner and outer groups of both sides of each context, as rows of one embedding."""
    side = np.arange(SIDE)
    both = np.stack([side // OUTER, INNER + side % OUTER])
    left, right = np.divmod(np.arange(SIDE * SIDE), SIDE)
    return np.concatenate([both[:, left], both[:, right] + INNER + OUTER]).T


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def initial(counts: np.ndarray, hidden: int = HIDDEN) -> list[np.ndarray]:
    """Embeddings of groups, bias of the hidden layer, and weights and bias of the softmax, before training."""
    rng = np.random.RandomState(SEED)
    return [
        rng.normal(0, 0.3, (2 * (INNER + OUTER), hidden)).astype(np.float32),
        np.zeros(hidden, np.float32),
        rng.normal(0, 0.3, (hidden, CLASSES)).astype(np.float32),
        np.log((counts.sum(0) + 1) / (counts.sum() + CLASSES)).astype(np.float32),
    ]


def loss_and_gradient(params: list[np.ndarray], rows: np.ndarray, some: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of counts (contexts, classes), whose contexts have the features ``rows``, and its gradient."""
    embeddings, shift, weights, bias = params
    weight = some.sum(1)
    total = max(float(weight.sum(dtype=np.float64)), 1.0)
    h = np.tanh(embeddings[rows].sum(1) + shift)
    logp = log_softmax(h @ weights + bias)
    dz = (np.exp(logp) * weight[:, None] - some) / total
    dh = (dz @ weights.T) * (1 - h * h)
    de = np.zeros_like(embeddings)
    for k in range(rows.shape[1]):
        order = np.argsort(rows[:, k], kind="stable")
        found, first = np.unique(rows[order, k], return_index=True)
        de[found] += np.add.reduceat(dh[order], first)
    return -float((some * logp).sum(dtype=np.float64)) / total, [de, dh.sum(0), h.T @ dz, dz.sum(0)]


def train(counts: np.ndarray, epochs: int = EPOCHS, hidden: int = HIDDEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums before the hidden layer (contexts, hidden), and weights and bias of the softmax, of the network that fits the counts (contexts, classes), by Adam."""
    used = np.flatnonzero(counts.sum(1))
    features = _features()
    params = initial(counts, hidden)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    some, rows = counts[used].astype(np.float32), features[used]
    for step in range(1, epochs + 1 if len(used) else 1):
        _, gradient = loss_and_gradient(params, rows, some)
        for p, g, (m, v) in zip(params, gradient, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[0][features].sum(1) + params[1], params[2], params[3]


def _random() -> np.ndarray:
    """Whole random vectors of rows, the last one zero."""
    out = np.clip(np.rint(np.random.RandomState(SEED).normal(0, 64, (RANDOM + 1, WIDE))), -256, 256)
    out[RANDOM] = 0
    return out.astype(np.int32)


def _add_by(total: np.ndarray, at: np.ndarray, columns: np.ndarray) -> None:
    """Add whole numbers, one row for each column of ``total``, to its rows that ``at`` names."""
    for k, column in enumerate(columns):
        total[:, k] += np.bincount(at, weights=column, minlength=len(total)).astype(np.int64)


def steps(network: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For the network of groups: slopes of the hidden layer by context, and the mean pull of all classes on it."""
    before, weights, bias = network
    hidden = np.tanh(before)
    return 1 - hidden * hidden, np.exp(log_softmax(hidden @ weights + bias)) @ weights.T


def _sums(frequent: np.ndarray, network: tuple[np.ndarray, ...], rows: int, members: int):
    """(kind, row, count, sums): kind 0 gradients by place and row of a neighbouring word, 1 features by member, 2 squares of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify, random = Classes(frequent), _random()
        before, weights, _ = network
        slope, pull = (np.ascontiguousarray(x.T) for x in steps(network))
        whole = np.rint(np.tanh(before) * UNIT).astype(np.float64).T.copy()
        totals = {0: np.zeros((4 * rows, HIDDEN + 1), np.int64, order="F"), 1: np.zeros((SHAPES * members, FEATURES + 1), np.int64, order="F"), 2: np.zeros((1, FEATURES + 1), np.int64)}
        any_rows = False
        for _, some in _parts(batches):
            w = Windows(some, classify)
            if not len(w.target):
                continue
            any_rows = True
            step = np.ones((HIDDEN + 1, len(w.target)))
            for k in range(HIDDEN):
                step[k] = np.rint((weights[k][w.target] - pull[k][w.context]) * slope[k][w.context] * UNIT)
            for k, near in enumerate(_NEAR):
                at = w.slots(k, rows)[w.real + near]
                inside = np.flatnonzero(at < rows)
                if len(inside) < len(at):
                    _add_by(totals[0][k * rows : (k + 1) * rows], at[inside], step[:, inside])
                else:
                    _add_by(totals[0][k * rows : (k + 1) * rows], at, step)
            rare = np.flatnonzero(w.target > FREQUENT)
            x = np.ones((FEATURES + 1, len(rare)))
            x[:HIDDEN] = whole[:, w.context[rare]]
            x[HIDDEN:FEATURES] = w.beside(random)[rare].T
            _add_by(totals[1], (w.target[rare] - 1 - FREQUENT) * members + member_of(w.words[rare], members), x)
            totals[2][0] += (x * x).sum(1).astype(np.int64)
        for kind, total in totals.items() if any_rows else ():
            used = np.flatnonzero(total[:, -1])
            for at in range(0, len(used), 20_000):
                part = total[used[at : at + 20_000]]
                sums = np.ascontiguousarray(np.pad(part[:, :-1], ((0, 0), (0, FEATURES + 1 - part.shape[1]))))
                lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, FEATURES, dtype=np.int32), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(used[at : at + 20_000].astype(np.int64)), pa.array(part[:, -1]), lists], ["kind", "row", "n", "sums"])

    return run


def _embeddings(row: np.ndarray, n: np.ndarray, sums: np.ndarray, rows: int, network: tuple[np.ndarray, ...], seen: np.ndarray) -> np.ndarray:
    """(places, rows and one of zeros, hidden): one Newton step of all rows at once, by the mean curvature, and a quarter, since four rows add up in each token."""
    before, weights, bias = network
    hidden = np.tanh(before)
    p = np.exp(log_softmax(hidden @ weights + bias))
    curve = np.zeros((HIDDEN, HIDDEN))
    for at in np.flatnonzero(seen):
        w = weights * (1 - hidden[at] ** 2)[:, None]
        mean = w @ p[at]
        curve += seen[at] * ((w * p[at]) @ w.T - np.outer(mean, mean))
    curve = curve / max(seen.sum(), 1)
    curve += np.eye(HIDDEN) * (1e-6 + 0.05 * np.trace(curve) / HIDDEN)
    out = np.zeros((4, rows + 1, HIDDEN), np.float32)
    out[row // rows, row % rows] = (sums / UNIT / (n + PRIOR)[:, None]) @ np.linalg.inv(curve) / 4
    return out


def _discriminant(row: np.ndarray, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes, features, members) and bias (classes, members) of members, whose counts are ``shares`` (classes, members)."""
    members = shares.shape[1]
    total, count = np.zeros((SHAPES * members, FEATURES)), np.zeros(SHAPES * members)
    total[row], count[row] = sums, n
    total, count = total.reshape(SHAPES, members, FEATURES), count.reshape(SHAPES, members)
    centre = total.sum(1) / np.maximum(count.sum(1), 1)[:, None]
    spread = np.maximum(squares / max(count.sum(), 1) - (total.sum((0, 1)) / max(count.sum(), 1)) ** 2, 1.0)
    off = (total - count[:, :, None] * centre[:, None]) / (count + PRIOR)[:, :, None]
    weights = off / spread
    bias = np.log(np.maximum(shares, 1e-9)) - 0.5 * (off * weights).sum(2) - (weights * centre[:, None]).sum(2)
    return weights.transpose(0, 2, 1).astype(np.float32), bias.astype(np.float32)


def exact(weights: np.ndarray, bias: np.ndarray, unit: float, most: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest weights and bias with which inputs that are multiples of ``unit``, at most ``most``, have sums
    without any rounding in 32-bit floats, so that no order of adding them matters."""
    bound = (np.abs(bias) + (np.abs(weights) * np.reshape(most, (-1, 1))).sum(0)).max(initial=1e-6)
    grid = 2.0 ** np.ceil(np.log2(bound) - 23)
    return (np.rint(weights.astype(np.float64) * (unit / grid)) * (grid / unit)).astype(np.float32), (np.rint(bias.astype(np.float64) / grid) * grid).astype(np.float32)


def chosen(x: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of outcome ``at`` of each row, its logits being ``x @ weights + bias``."""
    out = np.empty(len(x), np.float32)
    held = np.zeros((_ROWS_AT_ONCE, x.shape[1] + 1), np.float32)
    both = np.concatenate([weights, bias[None]]).astype(np.float32)
    z = np.empty((_BLOCK, both.shape[1]), np.float32)
    for k in range(0, len(x), _BLOCK):
        size = min(_BLOCK, len(x) - k)
        for j in range(0, size, _ROWS_AT_ONCE):
            n = min(_ROWS_AT_ONCE, size - j)
            held[:n, :-1], held[:n, -1] = x[k + j : k + j + n], 1
            np.matmul(held, both, out=z[j : j + _ROWS_AT_ONCE])
        part = z[:size]
        part -= part.max(1, keepdims=True)
        mine = part[np.arange(size), at[k : k + size]]
        np.exp(part, out=part)
        out[k : k + size] = np.minimum(mine - np.log(part.sum(1)), 0)
    return out


def _score(frequent: np.ndarray, known: np.ndarray, log_n: np.ndarray, model: tuple[np.ndarray, ...]):
    """``_key`` is the row's own; ``_rest`` are the words whose counts are yet to be joined."""
    before, weights, bias, embeddings, member_weights, member_bias, log_members = model
    rows, members = embeddings.shape[1] - 1, log_members.shape[1]
    weights, bias = exact(weights, bias, 1 / STEPS, 1.0)
    most = np.r_[np.full(HIDDEN, UNIT), np.full(2 * WIDE, 512)]
    exact_members = [exact(a, b, 1.0, most) for a, b in zip(member_weights, member_bias, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify, random = Classes(frequent), _random()
        hidden = np.rint(np.tanh(before) * UNIT).astype(np.float32)
        key = TaskContext.get().partitionId() << 40
        for ids, some in _parts(batches):
            sizes = np.array([len(b) for b in some])
            of = np.repeat(np.arange(len(some)), sizes)
            w = Windows(some, classify)
            pre = before[w.context]
            for k, near in enumerate(_NEAR):
                pre += embeddings[k][w.slots(k, rows)[w.real + near]]
            each = chosen(np.rint(np.tanh(pre) * STEPS) / STEPS, weights, bias, w.target).astype(np.float64)
            x = np.concatenate([hidden[w.context], w.beside(random).astype(np.float32)], 1)
            order = np.argsort(w.target, kind="stable")
            edges = np.searchsorted(w.target[order], np.arange(1 + FREQUENT, CLASSES + 1))
            for c in range(SHAPES):
                if edges[c] < edges[c + 1]:
                    mine = order[edges[c] : edges[c + 1]]
                    m = member_of(w.words[mine], members)
                    each[mine] += chosen(x[mine], *exact_members[c], m) - log_members[c, m]
            rare = np.flatnonzero(w.target > FREQUENT)
            words = w.words[rare]
            at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
            found = known[at] == words if len(known) else np.zeros(len(words), bool)
            each[rare[found]] += log_n[at[found]]
            rest = rare[~found]
            total = np.bincount(of, weights=each, minlength=len(some))
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[rest], minlength=len(some)))]).astype(np.int32)
            keys = pa.array(np.arange(key, key + len(some)))
            key += len(some)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(total), keys, pa.ListArray.from_arrays(ends, pa.array(w.words[rest].view(np.int64)))], ["id", "n_tokens", "score", "_key", "_rest"])

    return run


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epochs: int = EPOCHS) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``score`` (summed log-probabilities) and ``per_token``."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    source = stage(source.mapInArrow(_tokenized, "id long, words binary"), "tokens")
    few = source.coalesce(max(2, 2 * spark.sparkContext.defaultParallelism, source.rdd.getNumPartitions() // 3))
    words = stage(source.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    frequent = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    # the least count that no more than TABLE words reach
    least, distinct = 1 << 62, 0
    for r in sorted(words.groupBy("n").count().collect(), reverse=True):
        distinct += r["count"]
        least = r["n"] if distinct <= TABLE else least
    known = words.where(F.col("n") >= least).toArrow()
    log_n, known = np.log(np.maximum(known["n"].to_numpy(), 1)), known["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    log_n, known = log_n[order], known[order]
    rows = min(1 << max(distinct.bit_length() - 1, 10), ROWS)
    members = min(1 << max(4, int(distinct**0.5 / 16).bit_length()), MEMBERS)
    rare = words.where(~F.col("word").isin([r["word"] for r in top])) if top else words
    shape = F.col("word").bitwiseAND(F.lit(SHAPES - 1).cast("long")).alias("shape")
    found = rare.groupBy(shape, (F.shiftrightunsigned("word", 40) % members).alias("member")).agg(F.sum("n").alias("n")).toArrow()
    in_member = np.zeros((SHAPES, members))
    in_member[found["shape"].to_numpy(), found["member"].to_numpy()] = found["n"].to_numpy()
    cells = few.mapInArrow(_count_windows(frequent), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIDE * SIDE * CLASSES)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    counts = counts.reshape(-1, CLASSES)
    network = train(counts, epochs)
    base = spark.sparkContext.broadcast(network)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sums(frequent, base.value, rows, members)(batches)

    added = few.mapInArrow(sums, "kind int, row long, n long, sums array<long>").groupBy("kind", "row")
    added = added.agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(FEATURES))).toArrow()
    kind, row, n = (added[c].to_numpy() for c in ("kind", "row", "n"))
    total = np.stack([added[f"s{k}"].to_numpy() for k in range(FEATURES)], 1).astype(float)
    g, m, q = (kind == k for k in range(3))
    embeddings = _embeddings(row[g], n[g], total[g, :HIDDEN], rows, network, counts.sum(1))
    shares = in_member / np.maximum(in_member.sum(1, keepdims=True), 1)
    discriminant = _discriminant(row[m], n[m], total[m], total[q].sum(0), shares)
    model = spark.sparkContext.broadcast((known, log_n, (*network, embeddings, *discriminant, np.log(np.maximum(in_member, 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(frequent, *model.value)(batches)

    scored = stage(source.mapInArrow(run, "id long, n_tokens long, score double, _key long, _rest array<long>"), "scored")
    others = words.where((F.col("n") > 1) & (F.col("n") < least)).select("word", F.round(F.log("n") * (1 << 32)).cast("long").alias("_log"))
    rest = scored.select("_key", F.explode("_rest").alias("word")).join(others, "word").groupBy("_key").agg(F.sum("_log").alias("_log"))
    out = scored.drop("_rest").join(rest, "_key", "left").withColumn("score", F.col("score") + F.coalesce(F.col("_log"), F.lit(0)) / float(1 << 32))
    return out.select(F.col("id").alias(id_col), "n_tokens", "score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")).alias("per_token"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"))
