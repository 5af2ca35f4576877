"""Choosing one answer per problem.

A pool is the rows of one ``problem_id``; ``sample_idx`` is its order and breaks every tie.  ``key`` is the
normalised answer, empty for a trajectory that abstains.  A vote is two aggregations on the problem's key,
the first of which is combined on the map side; with the input already partitioned by ``problem_id`` both
run without a further exchange.  Scores are added in the order of ``sample_idx``, so a sum is always the same;
for that the rows of a class, at most a pool, are held together.  Exponentials that are added in another order
differ in their last digits, by more the larger the pool; their sums keep what each addition loses, and are compared
at 12 places, as in their SQL.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwise.functions import answers
from poolwise.functions.latex import numeric_key
from poolwise.functions.scalars import finite, safe_exp

METHODS = ("random", "majority", "self_certainty", "verifier", "verifier_argmax", "oracle")
WEIGHTED = ("self_certainty", "verifier")
#: Pools with more distinct answers than this are compared as text even if a symbolic backend is installed.
MERGE_LIMIT = 24
#: Pools that are Python objects at once while answers are merged.
MERGE_POOLS = 256


def with_keys(trajectories: DataFrame, answer_col: str = "answer") -> DataFrame:
    return trajectories.withColumn("key", answers.normalise(F.col(answer_col)))


def merge_map(keyed: DataFrame) -> DataFrame:
    """(problem_id, key, rep): the class representative of each distinct non-empty key of a pool.

    Without a symbolic backend every key represents itself.  With one, the distinct keys of a pool (at most
    MERGE_LIMIT of them; beyond that they stay as they are) are compared with the first member of each class;
    the most frequent member, first seen on ties, represents the class.
    """
    seen = voters(keyed).groupBy("problem_id", "key").agg(F.count("*").alias("n"), F.min("sample_idx").alias("first"))
    verify = answers.symbolic_backend()
    if verify is None:
        return seen.select("problem_id", "key", F.col("key").alias("rep"))

    problem = keyed.schema["problem_id"].dataType.simpleString()
    member = F.struct(F.coalesce("first", F.lit(1 << 62)).cast("long").alias("first"), "key", "n")
    pools = seen.groupBy("problem_id").agg(F.sort_array(F.collect_list(member)).alias("members"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, MERGE_POOLS) for whole in batches for at in range(0, whole.num_rows, MERGE_POOLS)):
            rows = [(at, key, rep) for at, members in enumerate(batch.column(1).to_pylist()) for key, rep in _classes(members, verify)]
            at, keys, reps = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string()), pa.array(reps, pa.string())], ["problem_id", "key", "rep"])

    return pools.mapInArrow(merge, f"problem_id {problem}, key string, rep string")


def _classes(members: list[dict], verify: Callable[[str, str], bool]) -> Iterator[tuple[str, str]]:
    """(key, representative) of a pool's distinct keys, which come in the order in which they were first seen."""
    homes: list[list[dict]] = []
    for m in members:
        m["number"] = numeric_key(m["key"]) is not None
        alike = (c for c in homes if _means_same(verify, c[0], m)) if len(members) <= MERGE_LIMIT else iter(())
        home = next(alike, None)
        if home is None:
            homes.append([m])
        else:
            home.append(m)
    for home in homes:
        rep = max(home, key=lambda m: (m["n"], -m["first"]))["key"]
        yield from ((m["key"], rep) for m in home)


def _means_same(verify: Callable[[str, str], bool], a: dict, b: dict) -> bool:
    if a["number"] and b["number"]:
        return False
    try:
        return bool(verify(a["key"], b["key"]))
    except Exception:  # a malformed answer equals nothing
        return False


def merged(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``rep``, the key that its vote counts for."""
    if not answers.have_symbolic_backend():
        return keyed.withColumn("rep", F.col("key"))
    return keyed.join(merge_map(keyed), ["problem_id", "key"], "left").withColumn("rep", F.coalesce("rep", "key"))


def ordered_sum(weight: Column) -> Column:
    """Sum of a group's weights, added one by one in the order of ``sample_idx``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("sample_idx"), weight.alias("w"))))
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["w"])


def settled_sum(weight: Column) -> Column:
    """Sum at 12 places of a group's weights, none below 0; the same weights in another order have the same sum.

    They are added from the greatest, so that (a - total) + w is just what an addition loses; that is added at the end.
    """
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("lost"))

    def add(a: Column, w: Column) -> Column:
        total = a["total"] + w
        return F.struct(total.alias("total"), (a["lost"] + ((a["total"] - total) + w)).alias("lost"))

    exact = lambda a: F.when(a["total"] < float("inf"), a["total"] + a["lost"]).otherwise(a["total"])
    return F.aggregate(F.sort_array(F.collect_list(weight), asc=False), start, add, lambda a: _settled(exact(a)))


def _settled(total: Column) -> Column:
    """A sum at 12 places; one too small for that keeps its digits."""
    return F.when(total < 1e-6, total).otherwise(F.round(total, 12))


def voters(keyed: DataFrame, key: str = "key") -> DataFrame:
    """Rows with a ``key``.  What is always true of a task's number keeps the filter from sinking below the Python
    that makes keys, which would run there once more, in as many workers again."""
    once = F.when(F.spark_partition_id() >= 0, F.col(key))
    return keyed.withColumn(key, once).where(F.col(key) != "")


def vote_tally(keyed: DataFrame, weight: Column | None = None) -> DataFrame:
    """(problem_id, rep, weight, first_idx) of every answer class; abstentions do not vote."""
    total = F.count("*").cast("double") if weight is None else ordered_sum(weight)
    return voters(merged(keyed), "rep").groupBy("problem_id", "rep").agg(total.alias("weight"), F.min("sample_idx").alias("first_idx"))


def check(trajectories: DataFrame, scores: bool, usable: Column, what: str) -> None:
    """Fail if any pool has no row that is ``usable``, or (``scores``) if any finite score, of abstainers too, lies
    outside [0, 1]; names the pool, or the extremes.  One aggregate over the table."""
    score = F.when(finite(F.col("score")), F.col("score")) if scores else F.lit(None).cast("double")
    pools = trajectories.groupBy("problem_id").agg(F.min(score).alias("low"), F.max(score).alias("high"), F.bool_or(usable).alias("ok"))
    low, high, pool, bad = pools.agg(F.min("low"), F.max("high"), F.min(F.when(~F.col("ok"), F.col("problem_id"))), F.count_if(~F.col("ok"))).first()
    if low is not None and (low < 0 or high > 1):
        raise ValueError(f"scores must be probabilities; found {low!r} to {high!r}")
    if bad:
        raise ValueError(f"pool {pool!r} has no {what}")


def score_range(trajectories: DataFrame) -> DataFrame:
    ok = finite(F.col("score"))
    return trajectories.agg(
        F.min(F.when(ok, F.col("score"))).alias("low"),
        F.max(F.when(ok, F.col("score"))).alias("high"),
        F.count_if(ok & ((F.col("score") < 0) | (F.col("score") > 1))).alias("n_bad"),
    )


def select_answers(
    trajectories: DataFrame, method: str = "majority", gold: str | None = None, seed: int = 0, validate: bool = True, least: dict[str, Column] | None = None, most: dict[str, Column] | None = None
) -> DataFrame:
    """(problem_id, answer) of every pool by one of METHODS; weighted methods add ``fell_back``.

    Needs ``problem_id, sample_idx, key`` and what the method reads: ``logprob``, ``score``, or the column that
    ``gold`` names.  A pool in which everyone abstains answers with the empty string.  ``validate`` runs the
    eager check (a score out of range; a pool without a usable weight) that fails instead of degrading.
    ``random`` takes the voter with the least ``md5(seed:problem_id:sample_idx)``.  ``least`` and ``most`` name
    columns that the result has of each pool besides: the least and the greatest of an expression of its rows.
    """
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; one of {', '.join(METHODS)}")
    if method == "oracle" and gold is None:
        raise ValueError("oracle needs the name of the gold column")
    if validate and method == "self_certainty":
        check(trajectories, False, finite(F.col("logprob")), "finite log-probability")
    if validate and method.startswith("verifier"):
        voter = (F.col("key") != "") if method == "verifier_argmax" else F.lit(True)
        check(trajectories, True, finite(F.col("score")) & voter, "voter with a finite score" if method == "verifier_argmax" else "finite score")
    least, most = least or {}, most or {}
    rows = _prepared(trajectories, (method,), gold)
    classes = rows.groupBy("problem_id", "rep").agg(*_class_parts((method,), seed), *(F.min(c).alias(n) for n, c in least.items()), *(F.max(c).alias(n) for n, c in most.items()))
    pools = classes.groupBy("problem_id").agg(*_pool_parts((method,)), *(F.min(n).alias(n) for n in least), *(F.max(n).alias(n) for n in most))
    zero = F.coalesce(F.col(f"_{method}.w") <= 0, F.lit(False)) if method in WEIGHTED else None
    extra = [zero.alias("fell_back")] if zero is not None else []
    return pools.select("problem_id", _answer(method).alias("answer"), *extra, *least, *most)


def _prepared(trajectories: DataFrame, methods: tuple[str, ...], gold: str | None) -> DataFrame:
    """Rows with ``rep``, and for the oracle ``_rank``: 0 for the gold key, 1 for an equivalent one, else null."""
    rows = merged(trajectories)
    if "oracle" in methods:
        votes = F.col("key") != ""
        rank = F.when(votes & (F.col("key") == answers.normalise(F.col(gold))), 0)
        if answers.have_symbolic_backend():
            rank = F.coalesce(rank, F.when(votes & answers.equivalent(F.col("key"), F.col(gold)), 1))
        rows = rows.withColumn("_rank", rank)
    return rows


def _class_parts(methods: tuple[str, ...], seed: int) -> list[Column]:
    """What is known of each class of answers of a pool."""
    votes = F.col("key") != ""
    scored = finite(F.col("score"))
    out = []
    if {"majority", *WEIGHTED} & set(methods):
        out += [F.count("*").alias("_n"), F.min("sample_idx").alias("_first")]
    if "self_certainty" in methods:
        out.append(settled_sum(F.when(finite(F.col("logprob")), safe_exp(F.col("logprob"))).otherwise(0.0)).alias("_w_self_certainty"))
    if "verifier" in methods:
        out.append(ordered_sum(F.when(scored, F.col("score")).otherwise(0.0)).alias("_w_verifier"))
    if "random" in methods:
        out.append(F.min(F.when(votes, F.struct(draw(seed).alias("h"), F.col("key").alias("v")))).alias("_one_random"))
    if "verifier_argmax" in methods:
        out.append(F.max(F.when(scored & votes, F.struct(F.col("score"), (-F.col("sample_idx")).alias("f"), F.col("key").alias("v")))).alias("_one_verifier_argmax"))
    if "oracle" in methods:
        out.append(F.min(F.when(F.col("_rank").isNotNull(), F.struct("_rank", "sample_idx", F.col("key").alias("v")))).alias("_one_oracle"))
    return out


def _pool_parts(methods: tuple[str, ...]) -> list[Column]:
    """The best class of each pool, by method."""
    votes = F.col("rep") != ""
    best = lambda weight: F.max(F.when(votes, F.struct(weight.alias("w"), (-F.col("_first")).alias("f"), F.col("rep").alias("v"))))
    out = [best(F.col("_n")).alias("_majority")] if {"majority", *WEIGHTED} & set(methods) else []
    out += [best(F.col(f"_w_{m}")).alias(f"_{m}") for m in WEIGHTED if m in methods]
    return out + [(F.max if m == "verifier_argmax" else F.min)(f"_one_{m}").alias(f"_{m}") for m in ("random", "verifier_argmax", "oracle") if m in methods]


def _answer(method: str) -> Column:
    """A pool's answer; by count where all weights are 0, empty where nobody votes."""
    chosen = F.col(f"_{method}.v")
    if method in WEIGHTED:
        chosen = F.when(F.col(f"_{method}.w") <= 0, F.col("_majority.v")).otherwise(chosen)
    return F.coalesce(chosen, F.lit(""))


def draw(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("problem_id").cast("string"), F.col("sample_idx").cast("string")))


def select_random_slot(trajectories: DataFrame, seed: int) -> DataFrame:
    """Seeded choice that depends on the number of voters alone, so pools of equal size take the same slot."""
    pools = voters(trajectories).groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "key"))).alias("v"))

    @F.pandas_udf("int")
    def slot(n):
        import random

        return n.map(lambda k: random.Random(seed).choice(range(k)))

    chosen = pools.select("problem_id", F.get(F.col("v"), slot(F.size("v")))["key"].alias("answer"))
    return trajectories.select("problem_id").distinct().join(chosen, "problem_id", "left").select("problem_id", F.coalesce("answer", F.lit("")).alias("answer"))


def all_selectors(trajectories: DataFrame, gold: str, seed: int = 0, methods: tuple[str, ...] = METHODS, least: dict[str, Column] | None = None) -> DataFrame:
    """One wide row per problem: the answer of every method, and the columns of ``least``, in one pass over the pools."""
    least = least or {}
    classes = _prepared(trajectories, methods, gold).groupBy("problem_id", "rep").agg(*_class_parts(methods, seed), *(F.min(c).alias(n) for n, c in least.items()))
    pools = classes.groupBy("problem_id").agg(*_pool_parts(methods), *(F.min(n).alias(n) for n in least))
    return pools.select("problem_id", *(_answer(m).alias(m) for m in methods), *least)


def warn_of_fallback(selected: DataFrame) -> int:
    """Say aloud how many pools had no weight at all; gives their number."""
    n = selected.where("fell_back").count()
    if n:
        warnings.warn(f"{n} pools had no positive weight and were decided by majority", RuntimeWarning, stacklevel=2)
    return n
