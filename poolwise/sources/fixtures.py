"""Trajectories and problems derived by rule from plain tables, so that SQL can state what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwise.functions import answers
from poolwise.sources.tables import nest_trajectories


def raw_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen samples a problem from ``events``: boxed integers in four styles, and prose that abstains."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "props")
    pid, k = F.expr("event_id div 16"), F.get_json_object("props", "$.k").cast("int")
    lucky = (F.col("event_id") * 7919 + k * 31) % 100 < 36 + (pid % 3 - 1) * 20
    rows = ev.select(
        "event_id",
        "event_type",
        pid.alias("problem_id"),
        (F.col("event_id") % 16).cast("int").alias("sample_idx"),
        F.concat(F.lit("What is asked in problem "), pid.cast("string"), F.lit("?")).alias("question"),
        (3 + pid % 40).cast("string").alias("gold"),
        F.when(lucky, (3 + pid % 40).cast("int")).otherwise(1 + k % 12).alias("ans_int"),
        F.when(F.col("event_id") % 11 != 0, (F.col("event_id") * 37 % 65) / F.lit(64.0)).alias("score"),
        (-(1 + F.col("event_id") % 8) / F.lit(8.0)).alias("logprob"),
    )
    a = F.col("ans_int").cast("string")
    box = lambda *parts: F.concat(F.lit("The result follows: \\boxed{"), *parts, F.lit("}"))
    text = (
        F.when(F.col("event_type") == "click", box(a))
        .when(F.col("event_type") == "view", box(a, F.lit(".0")))
        .when(F.col("event_type") == "purchase", box(F.lit("\\frac{"), (F.col("ans_int") * 2).cast("string"), F.lit("}{2}")))
        .when(F.col("event_type") == "signup", box(a, F.lit("\\text{ km}")))
        .otherwise(F.concat(F.lit("Steps so far lead to "), a))
    )
    rows = rows.withColumn("text", text)
    cut = F.when(F.col("event_type") == "error", "length").otherwise("stop")
    return rows.withColumns({"finish_reason": cut, "n_tokens": (40 + F.length("text")).cast("int")})


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the answer that its text gives, and its key."""
    rows = raw_trajectories(spark, sf_dir)
    return rows.withColumn("answer", answers.extract_boxed(F.col("text"))).withColumn("key", answers.normalise(F.col("answer")))


def with_nan(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("score")))


def with_zero_scores(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.when(F.col("problem_id") % 5 == 0, 0.0).otherwise(F.col("score")))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools as arrays, with a wrong stored answer where ``event_id % 97`` is 0."""
    rows = trajectories(spark, sf_dir)
    return nest_trajectories(rows.withColumn("answer", F.when(F.col("event_id") % 97 == 0, "stale").otherwise(F.col("answer"))))


def order_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems from ``orders``; every ninth has no gold line."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    question = F.concat(F.lit("What does order "), F.col("o_orderkey").cast("string"), F.lit(" cost?"))
    line = F.concat(F.lit("It adds up.\n#### "), F.format_string("%s", F.col("price").cast("string")), F.lit("."))
    return rows.select("o_orderkey", question.alias("question"), F.when(F.col("o_orderkey") % 9 == 0, "no line").otherwise(line).alias("solution"))
