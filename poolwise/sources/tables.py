"""Problems, trajectories and results as files and tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAJECTORY = "text STRING, answer STRING, finish_reason STRING, logprob DOUBLE, n_tokens INT"
NESTED = f"i INT, gsm8k_id INT, question STRING, gold STRING, prompt_suffix STRING, trajectories ARRAY<STRUCT<{TRAJECTORY.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE').replace(' INT', ': INT')}>>"
#: Fixed value: what a prompt ends in unless told otherwise.
SUFFIX = "\n\nPlease reason step by step, and put your final answer within \\boxed{}."


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines with a fixed schema; blank lines are skipped, a missing path fails by name."""
    try:
        return spark.read.schema(NESTED).json(path)
    except AnalysisException as why:
        if "PATH_NOT_FOUND" in str(why):
            raise FileNotFoundError(path) from why
        raise


def explode_trajectories(nested: DataFrame, key: str = "i") -> DataFrame:
    """One row per trajectory; its place in the array is ``sample_idx``."""
    rows = nested.select(F.col(key).cast("long").alias("problem_id"), "question", "gold", F.posexplode("trajectories").alias("sample_idx", "t"))
    return rows.select("problem_id", "sample_idx", "question", "gold", "t.*")


def nest_trajectories(rows: DataFrame) -> DataFrame:
    """The inverse: pools as arrays in the order of ``sample_idx``."""
    fields = F.struct("sample_idx", "text", "answer", "finish_reason", "logprob", "n_tokens")
    pools = rows.groupBy("problem_id").agg(F.min("question").alias("question"), F.min("gold").alias("gold"), F.array_sort(F.collect_list(fields)).alias("t"))
    plain = F.transform("t", lambda x: F.struct(*(x[c].alias(c) for c in ("text", "answer", "finish_reason", "logprob", "n_tokens"))))
    return pools.select(F.col("problem_id").cast("int").alias("i"), F.col("problem_id").cast("int").alias("gsm8k_id"), "question", "gold", F.lit(SUFFIX).alias("prompt_suffix"), plain.alias("trajectories"))


def append_nested(nested: DataFrame, path: str) -> None:
    nested.write.mode("append").json(path)


def remaining(problems: DataFrame, done: DataFrame, key: str = "problem_id") -> DataFrame:
    """Problems that are not written yet, whatever order they were written in."""
    return problems.join(done.select(key).distinct(), key, "left_anti")


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)


def gold_answer(solution: Column) -> Column:
    """The number after ``####``, without commas and closing dots; null where there is none."""
    pattern = r"(?U)####\s*(-?[\d.,]+)"
    found = F.regexp_extract(solution, pattern, 1)
    return F.when(solution.rlike(pattern), F.rtrim(F.replace(found, F.lit(","), F.lit("")), F.lit(".")))


def load_problems(source: DataFrame, n: int, seed: int, key: str, question: str, solution: str) -> DataFrame:
    """``n`` problems with a gold answer, in a seeded order of ``md5(seed:key)``."""
    rows = source.select(F.col(key).alias("problem_id"), F.col(question).alias("question"), gold_answer(F.col(solution)).alias("gold")).where("gold IS NOT NULL")
    return shuffle_limit(rows, n, seed, "problem_id")


def shuffle_limit(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def coerce_inputs(rows: DataFrame, kind: str) -> DataFrame:
    """Trajectories in canonical columns, from full rows (``samples``), JSON objects (``dicts``, a string column
    ``value``) or bare answers (``strings``, the same).  An object's ``answer`` counts if the key is there, even
    if null; else its older name ``respuesta`` does.  Likewise ``text``/``texto``, ``logprob``/``certeza`` and
    ``score``/``prm_score``."""
    if kind == "samples":
        return rows
    if kind == "strings":
        made = {"answer": F.coalesce("value", F.lit("")), "text": F.lit(""), "logprob": F.lit(None).cast("double"), "score": F.lit(None).cast("double")}
        return rows.withColumns(made).drop("value")
    fields = F.from_json("value", "MAP<STRING, STRING>")
    pick = lambda name, old: F.when(F.map_contains_key(fields, name), F.element_at(fields, name)).otherwise(F.try_element_at(fields, F.lit(old)))
    made = {
        "answer": F.coalesce(pick("answer", "respuesta"), F.lit("")),
        "text": F.coalesce(pick("text", "texto"), F.lit("")),
        "logprob": pick("logprob", "certeza").try_cast("double"),
        "score": pick("score", "prm_score").try_cast("double"),
    }
    return rows.withColumns(made).drop("value")


def build_prompt(question: Column, suffix: str = SUFFIX) -> Column:
    return F.concat(question, F.lit(suffix))


def chat_messages(prompt: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def verifier_exchange(problem: Column, text: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), problem.alias("content")), F.struct(F.lit("assistant").alias("role"), text.alias("content")))
