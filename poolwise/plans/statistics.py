"""Resampling and paired tests over pools, with draws that any engine repeats.

A repetition draws from a pool in the order of ``mix(mix(mix(seed * 1000003 + rep) ^ place of the pool) ^ sample)``
in 32 bits, the place being the first eight hexadecimal digits of ``md5(problem_id)``; so each pool is read once
and all its repetitions are drawn where it lies.  What meets in a shuffle are sums for each size and repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolwise.functions import answers, scalars
from poolwise.operators import accounting
from poolwise.operators.vote import all_selectors, draw, merged

CURVE = (1, 2, 4, 8, 16)
RESAMPLES, BOOTSTRAP, SEED = 500, 2000, 20260817


def min_pool_size(trajectories: DataFrame) -> DataFrame:
    return trajectories.groupBy("problem_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("n_max"))


def per_trajectory_accuracy(trajectories: DataFrame, gold: str) -> DataFrame:
    rows = trajectories.select("key", answers.normalise(F.col(gold)).alias("g"))
    return rows.agg((F.count_if((F.col("key") != "") & (F.col("key") == F.col("g"))) / F.count("*")).alias("p"))


def subsample(trajectories: DataFrame, k: int | Column, seed: int = SEED, tag: Column | None = None, by: tuple[str, ...] = ("problem_id",)) -> DataFrame:
    """``k`` rows of every pool, without replacement, in the order of ``md5(seed:tag:problem_id:sample_idx)``."""
    parts = [F.lit(str(seed)), *([tag.cast("string")] if tag is not None else []), F.col("problem_id").cast("string"), F.col("sample_idx").cast("string")]
    order = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws(":", *parts)), "sample_idx")
    return trajectories.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k).drop("_nth")


def mix(x: np.ndarray) -> np.ndarray:
    """32 bits that look random, of 32 bits."""
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(0x7FEB352D)) & np.uint64(0xFFFFFFFF)
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(0x46CA68B1)) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def _streams(seed: int, reps: int) -> np.ndarray:
    return mix((np.arange(reps, dtype=np.uint64) + np.uint64(seed * 1_000_003 & 0xFFFFFFFF)) & np.uint64(0xFFFFFFFF))


def _drawn(place: int, samples: np.ndarray, keys: list[str], gold: str, sizes: tuple[int, ...], streams: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size that the pool has, whether a random voter, the majority and any voter are right, by repetition.

    The order of drawing breaks ties, and its first voter is the random one.
    """
    code = {"": 0}
    codes = np.array([code.setdefault(k, len(code)) for k in keys])
    right = code.get(gold, -1) if gold else -1
    order = np.argsort(mix(mix(streams ^ np.uint64(place))[:, None] ^ samples.astype(np.uint64)), axis=1, kind="stable")
    every, n = np.arange(len(streams)), len(keys)
    weight = np.zeros((len(streams), len(code)), np.int64)  # votes, and on ties who was seen first
    one = np.zeros(len(streams), np.int64)
    for j in range(min(n, sizes[-1])):
        c = codes[order[:, j]]
        weight[every, c] += np.where(weight[every, c] > 0, n + 1, 2 * n + 1 - j)
        one = np.where(one > 0, one, c)
        if j + 1 in sizes:
            best = weight[:, 1:].argmax(1) + 1 if len(code) > 1 else every * 0
            voted = one > 0
            yield j + 1, np.stack([voted & (one == right), voted & (best == right), (weight[:, right] > 0) if right > 0 else voted & False])


#: What each pool adds up to, beside its draws.
_SUMS = ("problems", "generated", "voters", "truncated", "tokens", "hits", "majority_only", "random_only", "drift")
_DRAWN = "n int, rep int, pools long, short long, random long, majority long, coverage long, " + ", ".join(f"{c} long" for c in _SUMS)


def _resample(sizes: tuple[int, ...], reps: int, seed: int):
    """Sums of a task: rows of every size and repetition, and one (size 0) of what the pools add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = _streams(seed, reps)
        hits = np.zeros((len(sizes), 3, reps), np.int64)
        pools, short, sums = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(_SUMS), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                sums += [row[c] or 0 for c in _SUMS]
                for k, n in enumerate(sizes):
                    (pools if n <= len(row["keys"]) else short)[k] += 1
                for n, found in _drawn(row["place"], np.array(row["samples"], np.int64), row["keys"], row["gold_key"], sizes, streams):
                    hits[sizes.index(n)] += found
        size, rep = (x.ravel() for x in np.meshgrid(np.arange(len(sizes)), np.arange(reps), indexing="ij"))
        columns = [np.array(sizes)[size], rep, pools[size], short[size], *(hits[:, k].ravel() for k in range(3)), *np.zeros((len(_SUMS), len(size)), np.int64)]
        columns = [np.append(c, v) for c, v in zip(columns, [0, 0, 0, 0, 0, 0, 0, *sums], strict=True)]
        names = [x.split()[0] for x in _DRAWN.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if k < 2 else np.int64)) for k, c in enumerate(columns)], names)

    return run


def _curve(trajectories: DataFrame, gold: str, sizes: tuple[int, ...], reps: int, seed: int, draws: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per size (0: the sums of all pools): the curve, its spread and interval.  One pass over the pools."""
    made = {"generated": F.count("*"), **(extra or {})}
    # so many partitions whatever their bytes: the work is in the draws
    spread = int(trajectories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pools = merged(trajectories).repartition(spread, "problem_id").groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "rep"))).alias("pool"), F.min(gold).alias("gold"), *(c.alias(n) for n, c in made.items()))
    place = F.conv(F.substring(F.md5(F.col("problem_id").cast("string")), 1, 8), 16, 10).cast("long")
    known = [F.col(c) if c in made else F.lit(1 if c == "problems" else 0).cast("long").alias(c) for c in _SUMS]
    pools = pools.withColumn("gold_key", answers.normalise(F.col("gold"))).select(place.alias("place"), F.col("pool.sample_idx").alias("samples"), F.col("pool.rep").alias("keys"), "gold_key", *known, *(n for n in made if n not in _SUMS))
    if extra:  # what depends on the gold answer
        right = lambda c: F.coalesce((F.col(c) == F.col("gold_key")) & (F.col("gold_key") != ""), F.lit(False))
        best = F.aggregate(F.array_distinct("keys"), F.struct(F.lit(0).alias("n"), F.lit("").alias("k")), lambda a, k: F.when((k != "") & (F.size(F.filter("keys", lambda x: x == k)) > a["n"]), F.struct(F.size(F.filter("keys", lambda x: x == k)).alias("n"), k.alias("k"))).otherwise(a))
        pools = pools.withColumn("_best", best["k"])
        pools = pools.withColumns({"hits": F.size(F.filter("keys", lambda k: (k == F.col("gold_key")) & (k != ""))).cast("long"), "majority_only": (right("_best") & ~right("_one")).cast("long"), "random_only": (~right("_best") & right("_one")).cast("long")})
    pools = pools.select("place", "samples", "keys", "gold_key", *_SUMS)
    rows = pools.mapInArrow(_resample(tuple(sorted(sizes)), reps, seed), _DRAWN)
    rows = rows.groupBy("n", "rep").agg(*(F.sum(c).alias(c) for c in ("pools", "short", "random", "majority", "coverage", *_SUMS)))
    share = lambda c: F.try_divide(F.col(c), F.col("pools"))
    first = F.max(F.when(F.col("rep") == 0, F.col("majority")))
    rows = rows.where("short = 0").groupBy("n").agg(
        *((100 * F.avg(share(c))).alias(c) for c in ("random", "majority", "coverage")), (100 * F.stddev_pop(share("majority"))).alias("sd"), first.alias("hits_once"), F.max("pools").alias("pools"), *(F.sum(c).alias(c) for c in _SUMS)
    )
    low, high = _interval(F.col("hits_once"), F.col("pools"), draws, seed, 0.05)
    return rows.withColumns({"low": low, "high": high})


def accuracy_curve(trajectories: DataFrame, gold: str, sizes: tuple[int, ...] = CURVE, reps: int = RESAMPLES, seed: int = SEED, draws: int = BOOTSTRAP) -> DataFrame:
    """Per pool size: mean accuracy of random choice, majority and coverage over ``reps`` draws without
    replacement, the spread of majority over the draws, and (``low``, ``high``) a bootstrap interval over problems
    of majority in one of them, the first.  Sizes above the smallest pool are left out."""
    return _curve(trajectories, gold, sizes, reps, seed, draws).where("n > 0").select("n", "random", "majority", "coverage", "sd", "low", "high")


def quantiles(hits: int, n: int, uniform: np.ndarray) -> np.ndarray:
    """The binomial numbers of ``n`` tries at ``hits / n`` by inversion of each uniform number.

    Probabilities within 40 deviations of the mode, by their ratios; beyond that none is above 1e-300.
    """
    if not 0 < hits < n:
        return np.full(len(uniform), hits if n else 0)
    p = hits / n
    reach = int(40 * np.sqrt(n * p * (1 - p))) + 40
    k = np.arange(max(0, hits - reach), min(n, hits + reach) + 1)
    steps = np.log((n - k[:-1]) / (k[:-1] + 1.0)) + np.log(p / (1 - p))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.exp(logs - logs.max())
    return k[np.minimum(np.searchsorted(np.cumsum(mass) / mass.sum(), uniform), len(k) - 1)]


def _interval(hits: Column, n: Column, draws: int, seed: int, alpha: float) -> tuple[Column, Column]:
    """Per cent, of the sorted means of ``draws`` draws with replacement from ``n`` rows that have ``hits`` hits.

    Such a draw has a binomial number of hits, whichever rows they are, so each is one number: the quantile of
    its own uniform number, ``(mix(mix(seed * 1000003 + draw)) + 1/2) / 2**32``.
    """
    first, last = int(alpha / 2 * draws), min(draws - 1, int((1 - alpha / 2) * draws))

    @F.pandas_udf("array<double>")
    def ends(h, m):
        uniform = np.sort((mix(_streams(seed, draws)) + 0.5) / 2.0**32)[[first, last]]
        return h.combine(m, lambda a, b: [100 * float(x) / b if b else 0.0 for x in quantiles(int(a or 0), int(b), uniform)])

    both = ends(F.coalesce(hits, F.lit(0)).cast("long"), F.coalesce(n, F.lit(0)).cast("long"))
    return both[0], both[1]


def expected_curve(trajectories: DataFrame, gold: str, sizes: tuple[int, ...] = CURVE) -> DataFrame:
    """The same in closed form for random choice and coverage, where no draws are needed."""
    hit = (F.col("key") != "") & (F.col("key") == answers.normalise(F.col(gold)))
    pools = trajectories.groupBy("problem_id").agg(F.count("*").alias("pool"), F.count_if(F.col("key") != "").alias("v"), F.count_if(hit).alias("c"))
    rows = pools.withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).where("n <= pool")
    miss = lambda k: F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(1.0), lambda a, i: a * F.greatest(F.col("pool") - k - i, F.lit(0)) / (F.col("pool") - i))
    one = F.when(F.col("v") == 0, 0.0).otherwise(F.col("c") / F.col("v") * (1 - miss(F.col("v"))))
    return rows.groupBy("n").agg((100 * F.avg(one)).alias("random"), (100 * F.avg(1 - miss(F.col("c")))).alias("coverage"))


def bootstrap_ci(hits: DataFrame, hit: Column, draws: int = BOOTSTRAP, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """(low, high) in per cent: a percentile interval of the mean of ``hit``, by draws with replacement.

    One aggregate counts rows and hits, and the draws follow from these.  Without rows the interval is (0, 0).
    """
    rows = hits.agg(F.count_if(hit).alias("h"), F.count("*").alias("n"))
    low, high = _interval(F.col("h"), F.col("n"), draws, seed, alpha)
    return rows.select(low.alias("low"), high.alias("high"))


def paired(trajectories: DataFrame, gold: str, seed: int = 0) -> DataFrame:
    """(problem_id, majority, random): whether each is right; a gold answer without a key is never met."""
    rows = all_selectors(trajectories, gold, seed, ("majority", "random"), {"_gold": F.col(gold)})
    rows = rows.withColumn("g", answers.normalise(F.col("_gold")))
    right = lambda c: (F.col(c) == F.col("g")) & (F.col("g") != "")
    return rows.select("problem_id", right("majority").alias("majority"), right("random").alias("random"))


def paired_discordance(trajectories: DataFrame, gold: str, seed: int = 0) -> DataFrame:
    rows = paired(trajectories, gold, seed).agg(
        F.count_if(F.col("majority") & ~F.col("random")).alias("majority_only"), F.count_if(~F.col("majority") & F.col("random")).alias("random_only")
    )
    return rows.withColumn("p_value", scalars.mcnemar_exact(F.col("majority_only"), F.col("random_only")))


def majority_accuracy(trajectories: DataFrame, gold: str, draws: int = BOOTSTRAP, seed: int = SEED) -> DataFrame:
    rows = paired(trajectories, gold).agg(F.count_if("majority").alias("h"), F.count("*").alias("n"))
    low, high = _interval(F.col("h"), F.col("n"), draws, seed, 0.05)
    return rows.select(F.coalesce(100 * F.col("h") / F.col("n"), F.lit(0.0)).alias("accuracy"), low.alias("low"), high.alias("high"))


def gain_decomposition(curve: DataFrame) -> DataFrame:
    """From the curve: what avoiding abstentions gains, what voting gains, and both."""
    first, last = lambda c: F.min_by(c, "n"), lambda c: F.max_by(c, "n")
    return curve.agg(
        (last("random") - first("random")).alias("abstention_gain"), (last("majority") - last("random")).alias("voting_gain"), (last("majority") - first("random")).alias("total_gain")
    )


def reextraction_drift(nested: DataFrame) -> DataFrame:
    """How many stored answers differ from what the text gives now."""
    rows = nested.select(F.explode("trajectories").alias("t")).select("t.text", "t.answer")
    return rows.agg(F.count_if(~answers.extract_boxed(F.col("text")).eqNullSafe(F.col("answer"))).alias("drift"), F.count("*").alias("n"))


def summary(trajectories: DataFrame, gold: str, sizes: tuple[int, ...] = CURVE, reps: int = RESAMPLES, seed: int = SEED, draws: int = BOOTSTRAP, random_seed: int = 0) -> DataFrame:
    """One row with the whole evaluation, rounded as it is published; one pass over the pools.

    ``reextraction_drift`` counts stored answers that differ from what the text gives now (boxed).
    """
    drift = ~answers.extract_boxed(F.col("text")).eqNullSafe(F.col("answer"))
    rows = trajectories.withColumns({"_drift": drift, "_cut": accounting.truncated()})
    chosen = F.min(F.when(F.col("key") != "", F.struct(draw(random_seed).alias("h"), F.col("rep").alias("v"))))["v"]
    extra = {"voters": F.count_if(F.col("key") != ""), "truncated": F.count_if("_cut"), "tokens": F.sum("n_tokens").cast("long"), "drift": F.count_if("_drift"), "_one": F.coalesce(chosen, F.lit(""))}
    curve = _curve(rows, gold, sizes, reps, seed, draws, extra)
    point = F.struct("n", *(F.round(c, 2).alias(c) for c in ("random", "majority", "coverage")), F.round("sd", 3).alias("sd"), F.array(F.round("low", 2), F.round("high", 2)).alias("majority_ci95"))
    out = curve.agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, point))).alias("curve"), *(F.sum(c).alias(c) for c in _SUMS))
    rate = lambda c: F.round(F.coalesce(100 * F.try_divide(F.col(c), F.col("generated")), F.lit(0.0)), 2)
    test = F.struct("majority_only", "random_only", F.round(scalars.mcnemar_exact(F.col("majority_only"), F.col("random_only")), 6).alias("p_value"))
    return out.withColumn("abstained", F.col("generated") - F.col("voters")).select(
        "problems", F.coalesce(F.array_max("curve.n"), F.lit(0)).alias("n_generated"), rate("hits").alias("per_trajectory_accuracy"), rate("abstained").alias("abstention_rate"), rate("truncated").alias("truncation_rate"),
        F.col("tokens").alias("total_tokens"), "curve", test.alias("mcnemar_majority_vs_random"), F.col("drift").alias("reextraction_drift"),
    )
