"""What became of every trajectory, and whether pools and answers were right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwise.functions import answers
from poolwise.operators.vote import select_answers


def truncated() -> Column:
    return F.col("finish_reason").eqNullSafe("length")


def pool_accounting(trajectories: DataFrame) -> DataFrame:
    return trajectories.groupBy("problem_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("key") != "").alias("effective_n"),
        F.count_if(F.col("key") == "").alias("n_abstained"),
        F.count_if(truncated()).alias("n_truncated"),
        F.sum("n_tokens").cast("long").alias("total_tokens"),
    )


def corpus_accounting(trajectories: DataFrame) -> DataFrame:
    n = F.count("*")
    voters, cut = F.count_if(F.col("key") != ""), F.count_if(truncated())
    return trajectories.agg(
        F.count_distinct("problem_id").alias("problems"),
        n.alias("n_generated"),
        voters.alias("voters"),
        (n - voters).alias("abstained"),
        cut.alias("truncated"),
        F.coalesce(F.sum("n_tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"),
        (100.0 * (n - voters) / n).cast("double").alias("abstention_rate"),
        (100.0 * cut / n).cast("double").alias("truncation_rate"),
    )


def agreement(trajectories: DataFrame) -> DataFrame:
    """Share of the largest class among voters; 0 for a pool without voters."""
    seen = trajectories.groupBy("problem_id", "key").agg(F.count("*").alias("n"))
    votes = F.when(F.col("key") != "", F.col("n"))
    return seen.groupBy("problem_id").agg(F.coalesce(F.max(votes) / F.sum(votes), F.lit(0.0)).alias("agreement"))


def coverage(trajectories: DataFrame, gold: str) -> DataFrame:
    """Whether any voter has the gold answer; never, if the gold answer has no key."""
    hit = (F.col("key") != "") & answers.equivalent(F.col("key"), F.col(gold))
    return trajectories.select("problem_id", hit.alias("hit")).groupBy("problem_id").agg(F.bool_or("hit").alias("covered"))


def _right() -> Column:
    return (F.col("answer") != "") & answers.equivalent(F.col("answer"), F.col("gold"))


def is_correct(trajectories: DataFrame, gold: str, method: str = "majority", **options) -> DataFrame:
    """The chosen answer of every problem and whether it is the gold one."""
    chosen = select_answers(trajectories, method, gold, least={"gold": F.col(gold)}, **options)
    return chosen.select("problem_id", "answer", _right().alias("correct"))


def diagnosis(trajectories: DataFrame, gold: str, method: str = "majority", **options) -> DataFrame:
    """Per problem, in one pass: did selection return the answer, and was it within reach?"""
    hit = F.coalesce((F.col("key") != "") & answers.equivalent(F.col("key"), F.col(gold)), F.lit(False))
    rows = trajectories.withColumn("_hit", hit)
    chosen = select_answers(rows, method, gold, least={"gold": F.col(gold)}, most={"covered": F.col("_hit")}, **options)
    chosen = chosen.withColumn("correct", _right())
    said = F.when(F.col("correct"), "working").when(F.col("covered"), "selection problem").otherwise("generation problem")
    return chosen.select("problem_id", "correct", "covered", said.alias("diagnosis"))


def answers_list(trajectories: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("sample_idx", "answer")))
    return trajectories.groupBy("problem_id").agg(F.transform(ordered, lambda x: x["answer"]).alias("answers"))
