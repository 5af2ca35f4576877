"""Votes while trajectories arrive.

One stateful aggregate keeps each problem's (place, key) pairs; the vote on top has no state of its own, so
the result of every trigger is what a batch over all rows so far would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vote_over(rows: Column) -> Column:
    """(answer, votes, voters) of an array of (sample_idx, key), most votes first and ties by place."""
    voters = F.filter(F.array_sort(rows), lambda r: r["key"] != "")
    keys = F.transform(voters, lambda r: r["key"])
    tally = F.transform(
        F.array_distinct(keys), lambda k: F.struct(F.size(F.filter(keys, lambda x: x == k)).alias("votes"), (-F.array_position(keys, k)).alias("f"), k.alias("answer"))
    )
    best = F.array_max(tally)
    return F.struct(F.coalesce(best["answer"], F.lit("")).alias("answer"), F.coalesce(best["votes"], F.lit(0)).alias("votes"), F.size(keys).alias("voters"))


def incremental_votes(keyed: DataFrame) -> DataFrame:
    """(problem_id, answer, votes, voters), for batch and for streams in complete or update mode."""
    pools = keyed.groupBy("problem_id").agg(F.collect_list(F.struct("sample_idx", "key")).alias("rows"))
    return pools.select("problem_id", vote_over(F.col("rows")).alias("v")).select("problem_id", "v.*")
