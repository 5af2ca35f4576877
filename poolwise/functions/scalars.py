"""Numeric scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def safe_exp(x: Column) -> Column:
    """exp that saturates to infinity."""
    return F.exp(x)


def sigmoid(x: Column) -> Column:
    """Logistic function inside (0, 1); one half for null and NaN."""
    x = x.cast("double")
    low, high = F.lit(EPSILON), F.lit(1 - EPSILON)
    inner = F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
    inner = F.when(x >= 700, 1.0).when(x <= -700, 0.0).otherwise(inner)
    return F.when(x.isNull() | F.isnan(x), 0.5).otherwise(F.least(high, F.greatest(low, inner)))


def adapt_logits(x: Column) -> Column:
    """Score of a raw logit: its sigmoid, and 0 where it is not finite."""
    return F.when(finite(x), sigmoid(x)).otherwise(0.0)


def adapt_probability(p: Column) -> Column:
    """A probability as it is, 0 where it is not finite; one outside [0, 1] fails the query."""
    bad = finite(p) & ((p < 0) | (p > 1))
    said = F.concat(F.lit("a probability outside [0, 1]: "), p.cast("string"))
    return F.when(bad, F.raise_error(said).cast("double")).when(finite(p), p).otherwise(0.0)


def mean_logprob(logprobs: Column, tokens: Column, eos: int) -> Column:
    """Mean over positions whose token is not ``eos``; null if it is not finite."""
    live = F.zip_with(logprobs, tokens, lambda p, t: F.when(t != eos, p))
    live = F.filter(live, lambda p: p.isNotNull())
    total = F.aggregate(live, F.lit(0.0), lambda a, p: a + p)
    mean = total / F.greatest(F.size(live), F.lit(1))
    return F.when(finite(mean), mean)


def live_tokens(tokens: Column, eos: int) -> Column:
    return F.size(F.filter(tokens, lambda t: t != eos))


def spoken_tokens(n_tokens: Column, finish_reason: Column) -> Column:
    """Tokens of a sample less the end token, which only a sample that stopped by itself has."""
    return F.greatest(n_tokens - F.when(finish_reason.eqNullSafe("stop"), 1).otherwise(0), F.lit(0))


def finish_reason(n_tokens: Column, cap: int, last: Column, eos: int) -> Column:
    return F.when((n_tokens >= cap) & (last != eos), "length").otherwise("stop")


def coverage_law(p: Column, n: int | Column) -> Column:
    """Chance that one of n independent tries is right."""
    return 1 - F.pow(1 - p, n)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by Stirling's series eight steps further on."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    return series - F.log(steps)


def mcnemar_exact(only_a: Column, only_b: Column) -> Column:
    """Two-sided exact p-value of a paired comparison.

    The tail is its largest term, in logarithms so that no power of two overflows, times a sum of ratios that
    ends after 40 standard deviations, beyond which no term counts.
    """
    n, k = (only_a + only_b).cast("double"), F.least(only_a, only_b).cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * F.log(F.lit(2.0))
    places = F.sequence(F.lit(0), F.least(k, F.ceil(20 * F.sqrt(n)) + 100).cast("int"))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
    step = lambda acc, j: F.struct((acc["t"] * (k - j) / (n - k + j + 1)).alias("t"), (acc["s"] + acc["t"]).alias("s"))
    tail = F.exp(top) * F.aggregate(places, start, step, lambda acc: acc["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def chunk_size(n: int, logprobs: bool, vocabulary: int | None, max_tokens: int, free_bytes: int, override: int | None = None) -> int:
    """Trajectories to generate at a time: all without log-probabilities, else what memory allows."""
    if override:
        return max(1, int(override))
    if not logprobs:
        return n
    if not vocabulary:
        return min(n, 4)
    budget = max(2 << 30, int(free_bytes * 0.45))
    return max(1, min(n, budget // max(1, max_tokens * vocabulary * 6)))
