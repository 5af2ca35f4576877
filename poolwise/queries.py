"""Every operator as a query over the plain tables, beside SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwise.functions import answers, scalars
from poolwise.operators import accounting, scoring, vote
from poolwise.plans import statistics
from poolwise.sources import fixtures, tables
from poolwise.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The trajectories of the fixtures, with the answers that their rule gives; no text is parsed here.
T = r"""
WITH t0 AS (
  SELECT *, event_id // 16 AS problem_id, CAST(event_id % 16 AS INTEGER) AS sample_idx, CAST(3 + (event_id // 16) % 40 AS INTEGER) AS g,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
t1 AS (
  SELECT *, CAST(g AS VARCHAR) AS gold, 'What is asked in problem ' || problem_id || '?' AS question,
    CASE WHEN (event_id * 7919 + k * 31) % 100 < 36 + (problem_id % 3 - 1) * 20 THEN g ELSE CAST(1 + k % 12 AS INTEGER) END AS a,
    CASE WHEN event_id % 11 <> 0 THEN CAST(event_id * 37 % 65 AS DOUBLE) / 64 END AS score, -(1 + event_id % 8) / CAST(8 AS DOUBLE) AS logprob FROM t0),
t2 AS (
  SELECT *, CASE WHEN event_type = 'error' THEN '' ELSE CAST(a AS VARCHAR) END AS key, CASE WHEN event_type = 'error' THEN 'length' ELSE 'stop' END AS finish_reason,
    CASE event_type WHEN 'click' THEN 'The result follows: \boxed{' || a || '}' WHEN 'view' THEN 'The result follows: \boxed{' || a || '.0}'
      WHEN 'purchase' THEN 'The result follows: \boxed{\frac{' || (2 * a) || '}{2}}' WHEN 'signup' THEN 'The result follows: \boxed{' || a || '\text{ km}}'
      ELSE 'Steps so far lead to ' || a END AS text,
    CASE event_type WHEN 'view' THEN a || '.0' WHEN 'purchase' THEN (2 * a) || '/2' WHEN 'error' THEN '' ELSE CAST(a AS VARCHAR) END AS answer FROM t1),
t AS (SELECT *, CAST(40 + length(text) AS INTEGER) AS n_tokens FROM t2)
"""


def _query(sql: str | None = None, name: str | None = None):
    def add(fn: Callable) -> Callable:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn

    return add


def _traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.trajectories(spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _winner(weight: str, extra: str = "", where: str = "key <> ''") -> str:
    """SQL: the key of the greatest weight per problem, first seen on ties, empty where nobody votes."""
    return f"""{T}, w AS (SELECT problem_id, key, {weight} AS w, min(sample_idx) AS f FROM t WHERE {where} GROUP BY problem_id, key),
r AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY w DESC, f) AS nth FROM w)
SELECT p.problem_id, coalesce(r.key, '') AS answer{extra} FROM (SELECT DISTINCT problem_id FROM t) p LEFT JOIN r ON r.problem_id = p.problem_id AND nth = 1"""


CERTAINTY = "sum(exp(logprob))"
SCORE = "sum(coalesce(score, 0))"

# ---- sources ---------------------------------------------------------------------------------------------


@_query(T + "SELECT problem_id, sample_idx, text, CASE WHEN event_id % 97 = 0 THEN 'stale' ELSE answer END AS answer, finish_reason, logprob, n_tokens FROM t")
def scan_nested(spark, sf_dir):
    path = scratch_path(spark, "nested")
    tables.append_nested(fixtures.nested(spark, sf_dir), path)
    return tables.explode_trajectories(tables.read_nested(spark, path)).drop("question", "gold")


_GOLD = r"rtrim(replace(regexp_extract(solution, '####\s*(-?[0-9.,]+)', 1), ',', ''), '.')"
_ORDERS = r"""WITH o AS (SELECT o_orderkey, 'What does order ' || o_orderkey || ' cost?' AS question,
  CASE WHEN o_orderkey % 9 = 0 THEN 'no line' ELSE 'It adds up.' || chr(10) || '#### ' || CAST(o_totalprice AS DECIMAL(12,2)) || '.' END AS solution FROM orders)
"""


@_query(_ORDERS + rf"SELECT o_orderkey AS problem_id, question, {_GOLD} AS gold FROM o WHERE solution LIKE '%####%' ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 200")
def load_problems(spark, sf_dir):
    return tables.load_problems(fixtures.order_problems(spark, sf_dir), 200, 7, "o_orderkey", "question", "solution")


@_query(_ORDERS + f"SELECT o_orderkey, CASE WHEN solution LIKE '%####%' THEN {_GOLD} END AS gold FROM o")
def gold_answer(spark, sf_dir):
    return fixtures.order_problems(spark, sf_dir).select("o_orderkey", tables.gold_answer(F.col("solution")).alias("gold"))


@_query(T + "SELECT DISTINCT problem_id, question FROM t WHERE problem_id % 3 <> 0")
def resume_anti_join(spark, sf_dir):
    problems = fixtures.raw_trajectories(spark, sf_dir).select("problem_id", "question").distinct()
    return tables.remaining(problems, problems.where("problem_id % 3 = 0"))


@_query(T + "SELECT problem_id, sample_idx, CASE problem_id % 4 WHEN 0 THEN key WHEN 1 THEN key WHEN 2 THEN '' ELSE key END AS answer FROM t")
def coerce_inputs(spark, sf_dir):
    rows = _traj(spark, sf_dir).select("problem_id", "sample_idx", "key")
    kind, key = F.col("problem_id") % 4, F.col("key")
    as_json = F.when(kind == 0, F.to_json(F.struct(key.alias("answer")))).when(kind == 1, F.to_json(F.struct(key.alias("respuesta"), F.lit("x").alias("texto"))))
    as_json = as_json.when(kind == 2, F.concat(F.lit('{"answer": null, "respuesta": "'), key, F.lit('"}')))
    dicts = tables.coerce_inputs(rows.where(kind < 3).select("problem_id", "sample_idx", as_json.alias("value")), "dicts")
    bare = tables.coerce_inputs(rows.where(kind == 3).select("problem_id", "sample_idx", key.alias("value")), "strings")
    return dicts.unionByName(bare).select("problem_id", "sample_idx", "answer")


def _models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(m[0], ["pytorch", f"license:{m[1]}", "license:late"]) for m in scoring.KNOWN_MODELS] + [("someone/new", ["pytorch"]), ("someone/free", ["license:mit"])], "model_id string, tags array<string>"
    )


_VALUES = ", ".join(f"('{m}', '{lic}', '{kind}')" for m, lic, kind in scoring.KNOWN_MODELS)


@_query(f"SELECT * FROM (SELECT a AS model_id, b AS licence FROM (VALUES {_VALUES}) v(a, b, c) UNION ALL VALUES ('someone/new', NULL), ('someone/free', 'mit'))")
def license_tag(spark, sf_dir):
    return _models(spark).select("model_id", scoring.license_tag(F.col("tags")).alias("licence"))


@_query(f"SELECT a AS model_id, b AS licence, c AS kind FROM (VALUES {_VALUES}) v(a, b, c) UNION ALL VALUES ('someone/new', NULL, NULL), ('someone/free', NULL, NULL)")
def license_join(spark, sf_dir):
    known = F.broadcast(scoring.known_models(spark))
    return _models(spark).select("model_id").join(known, "model_id", "left")


@_query(f"SELECT a AS model_id, b AS licence, b NOT IN ('apache-2.0', 'mit', 'bsd-3-clause', 'cc0-1.0') AS flagged FROM (VALUES {_VALUES}) v(a, b, c) UNION ALL VALUES ('someone/new', 'unknown', true), ('someone/free', 'mit', false)")
def licence_flag(spark, sf_dir):
    live = F.when(F.col("model_id").startswith("someone"), scoring.license_tag(F.col("tags")))
    return scoring.licence_flags(_models(spark).withColumn("live", live), "live")


# ---- prompts ---------------------------------------------------------------------------------------------

_SUFFIX = "chr(10) || chr(10) || 'Please reason step by step, and put your final answer within \\boxed{}.'"


@_query(f"SELECT conv_id, turn, text || {_SUFFIX} AS prompt FROM conversations WHERE role = 'user'")
def build_prompt(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", tables.build_prompt(F.col("text")).alias("prompt"))


@_query(f"SELECT conv_id, turn, CAST(1 AS INTEGER) AS n_messages, 'user' AS role, text || {_SUFFIX} AS content FROM conversations WHERE role = 'user'")
def chat_messages(spark, sf_dir):
    rows = build_prompt(spark, sf_dir).withColumn("m", tables.chat_messages(F.col("prompt")))
    return rows.select("conv_id", "turn", F.size("m").alias("n_messages"), F.col("m")[0]["role"].alias("role"), F.col("m")[0]["content"].alias("content"))


@_query(
    """SELECT u.conv_id, u.turn, 'user' AS first_role, u.text AS problem, 'assistant' AS second_role, a.text AS answer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"""
)
def verifier_exchange(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    replies = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    both = rows.where("role = 'user'").join(replies, ["conv_id", "turn"]).withColumn("m", tables.verifier_exchange(F.col("text"), F.col("reply")))
    m = F.col("m")
    return both.select("conv_id", "turn", m[0]["role"].alias("first_role"), m[0]["content"].alias("problem"), m[1]["role"].alias("second_role"), m[1]["content"].alias("answer"))


# ---- rows and pools --------------------------------------------------------------------------------------


@_query(T + "SELECT problem_id, count(*) FILTER (finish_reason = 'length') AS n_truncated FROM t GROUP BY ALL")
def n_truncated(spark, sf_dir):
    return fixtures.raw_trajectories(spark, sf_dir).groupBy("problem_id").agg(F.count_if(accounting.truncated()).alias("n_truncated"))


@_query(T + "SELECT problem_id, sample_idx, key FROM t WHERE key <> ''")
def voting(spark, sf_dir):
    return vote.voters(_traj(spark, sf_dir)).select("problem_id", "sample_idx", "key")


@_query(T + "SELECT problem_id, sample_idx, score FROM t WHERE score IS NOT NULL AND event_id % 13 <> 0")
def finite_filter(spark, sf_dir):
    rows = fixtures.with_nan(fixtures.raw_trajectories(spark, sf_dir))
    return rows.where(scalars.finite(F.col("score"))).select("problem_id", "sample_idx", "score")


@_query(T + "SELECT problem_id, string_agg(answer, '|' ORDER BY sample_idx) AS answers FROM t GROUP BY ALL")
def answers_list(spark, sf_dir):
    return accounting.answers_list(_traj(spark, sf_dir)).select("problem_id", F.array_join("answers", "|").alias("answers"))


@_query("SELECT count(*) FILTER (event_id % 97 = 0) AS drift, count(*) AS n FROM events")
def reextraction_drift(spark, sf_dir):
    return statistics.reextraction_drift(fixtures.nested(spark, sf_dir))


@_query(T + "SELECT problem_id, sample_idx, question, gold, text, CASE WHEN event_id % 97 = 0 THEN 'stale' ELSE answer END AS answer, finish_reason, logprob, n_tokens FROM t")
def explode_trajectories(spark, sf_dir):
    return tables.explode_trajectories(fixtures.nested(spark, sf_dir))


def _tokens(column: str = "embedding") -> Column:
    return F.transform(column, lambda x, i: i % 5)


@_query("SELECT vec_id, CAST(len(list_filter(range(len(embedding)), lambda i: i % 5 <> 4)) AS INTEGER) AS live FROM embeddings")
def live_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", scalars.live_tokens(_tokens(), 4).alias("live"))


@_query("SELECT vec_id, CASE WHEN len(embedding) >= 64 AND (vec_id % 3) <> 2 THEN 'length' ELSE 'stop' END AS reason FROM embeddings")
def finish_reason(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", scalars.finish_reason(F.size("embedding"), 64, F.col("vec_id") % 3, 2).alias("reason"))


@_query(T + "SELECT problem_id, sample_idx, CAST(n_tokens - (finish_reason = 'stop')::INT AS INTEGER) AS spoken FROM t")
def spoken_tokens(spark, sf_dir):
    rows = fixtures.raw_trajectories(spark, sf_dir)
    return rows.select("problem_id", "sample_idx", scalars.spoken_tokens(F.col("n_tokens"), F.col("finish_reason")).cast("int").alias("spoken"))


# ---- answers ---------------------------------------------------------------------------------------------


@_query(T + "SELECT event_id, answer FROM t")
def extract_boxed(spark, sf_dir):
    return fixtures.raw_trajectories(spark, sf_dir).select("event_id", answers.extract_boxed(F.col("text")).alias("answer"))


@_query(T + "SELECT event_id, CASE WHEN answer = '' THEN CAST(a AS VARCHAR) ELSE answer END AS answer FROM t")
def extract_boxed_fallback(spark, sf_dir):
    return fixtures.raw_trajectories(spark, sf_dir).select("event_id", answers.extract_boxed(F.col("text"), allow_fallback=True).alias("answer"))


@_query(r"SELECT page_id, coalesce(replace(list_extract(regexp_extract_all(html, '-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|-?[0-9]+(?:\.[0-9]+)?'), -1), ',', ''), '') AS number FROM pages")
def extract_number(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", answers.extract_number(F.col("html")).alias("number"))


@_query(r"SELECT doc_id, coalesce(list_extract(regexp_extract_all(' ' || regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g') || ' ', '(?:^|[^\p{L}\p{N}_])([ABCD])(?:[^\p{L}\p{N}_]|$)', 1), -1), '') AS letter FROM documents")
def extract_letter(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", answers.extract_letter(F.col("text")).alias("letter"))


@_query("SELECT page_id, trim(regexp_extract(url, '//([^/]+)', 1)) AS host FROM pages")
def extract_regex(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", answers.extract_regex(F.col("url"), "//([^/]+)").alias("host"))


def _literals(name: str, column: Callable[[Column], Column], kind: str, cases: list[tuple[str, object]]) -> None:
    """A query over given texts; its SQL lists what each must give."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(cases)], "n int, input string")
        return rows.select("n", column(F.col("input")).cast(kind).alias("output"))

    def shown(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"

    rows = ", ".join(f"({k}, {shown(v)})" for k, (_, v) in enumerate(cases))
    QUERIES[name] = run
    ORACLE[name] = f"SELECT CAST(n AS INTEGER) AS n, CAST(o AS {'BOOLEAN' if kind == 'boolean' else 'VARCHAR'}) AS output FROM (VALUES {rows}) v(n, o)"


_literals(
    "latex_to_text", answers.latex_to_text, "string",
    [
        (r"\frac{1}{2}", "(1)/(2)"), (r"\dfrac{3}{4}x", "(3)/(4)x"), (r"\frac12", None), (r"2\sqrt{5}", "2sqrt(5)"), (r"\sqrt[3]{8}", "(8)**(1/(3))"), ("", None),
        (r"\text{ Cape   Town }", "Cape Town"), (r"12\text{ m/s}", "12"), (r"\left(3, 4\right)", "(3,4)"), (r"\{1, 2\}", "{1,2}"), ("1{,}234", "1234"), ("50\\%", "50"),
        (r"x^{10}", "x**(10)"), ("x^2", "x**2"), (r"a_{12}", "a_12"), (r"3\cdot4\times5\div6", "3*4*5/6"), (r"\infty", "inf"), (r"\pi/2", "pi/2"), (r"5\text{ or }6", "56"), (r"\log_{2}8", "log_28"),
    ],
)
_literals("is_unit", answers.is_unit, "boolean", [("km", True), (" m/s ", True), ("cm^2", True), ("12", False), ("", False), ("a_b", False), ("m²", True), ("né", False), ("sq. in.", True)])
_literals("strip_thousands", answers.strip_thousands, "string", [("1,234", "1234"), ("12,345,678.5", "12345678.5"), ("1{,}000", "1000"), ("1,23", "1,23"), ("(3,4)", "(3,4)"), ("-9,000", "-9000"), ("1, 000", "1000"), ("1234,567", "1234,567")])
_literals("tidy_parens", answers.tidy_parens, "string", [("(1)/(2)", "1/2"), ("(2)(3)", "(2)(3)"), ("sqrt(5)", "sqrt(5)"), ("((7))", "7"), ("(1+2)/3", "(1+2)/3"), ("(-3)**2", "-3**2"), ("(3,4)", "(3,4)"), ("(x)", "x"), ("2-(-3)", "2--3"), ("(f(x))", "f(x)")])
_literals("is_atomic", answers.is_atomic, "boolean", [("5", True), ("sqrt(3+1)", True), ("1+2", False), ("", False), ("(a", False), (")(", False), ("[1,2]", True), ("-1", False)])


@_query(
    T + r"""SELECT * FROM (SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN key = '' THEN NULL WHEN event_type = 'purchase' THEN NULL ELSE key END AS k FROM t)
UNION ALL VALUES ('a', '1000'), ('b', NULL), ('c', '0.5'), ('d', '1e-05'), ('e', ''), ('f', ''), ('g', '9007199254740992'), ('h', '3'), ('i', '-0.25'), ('j', NULL)"""
)
def numeric_key(spark, sf_dir):
    more = [("a", "1_000"), ("b", "2d"), ("c", "00.50"), ("d", "0.00001"), ("e", "nan"), ("f", "-Infinity"), ("g", "9007199254740993"), ("h", "٣"), ("i", "-0.250"), ("j", "x")]
    rows = _traj(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), "answer")
    rows = rows.unionByName(spark.createDataFrame(more, "id string, answer string"))
    return rows.select("id", answers.numeric_key(F.col("answer")).alias("k"))


@_query(
    T + r"""SELECT CAST(event_id AS VARCHAR) AS id, key FROM t
UNION ALL VALUES ('a', '1000'), ('b', '2D'), ('c', '1/2'), ('d', '-3/2'), ('e', ''), ('f', '4'), ('g', ''), ('h', 'X+1'), ('i', '7'), ('j', '1234'), ('k', '(3,4)'), ('l', ''), ('m', '12'), ('n', '0.1')"""
)
def normalise(spark, sf_dir):
    more = [
        ("a", "1_000"), ("b", "2d"), ("c", "2/4"), ("d", "-6/4"), ("e", "1/0"), ("f", "8/2"), ("g", "inf"), ("h", " x + 1 . "), ("i", " 7.00.."), ("j", "1,234"), ("k", "(3, 4)"), ("l", None),
        ("m", "12."), ("n", "1e-1"),
    ]
    rows = _traj(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), "answer")
    rows = rows.unionByName(spark.createDataFrame(more, "id string, answer string"))
    return rows.select("id", answers.normalise(F.col("answer")).alias("key"))


@_query(T + "SELECT event_id, key <> '' AND key = gold AS same FROM t")
def equivalent(spark, sf_dir):
    return _traj(spark, sf_dir).select("event_id", answers.equivalent(F.col("answer"), F.col("gold")).alias("same"))


# ---- numbers ---------------------------------------------------------------------------------------------


@_query(T + "SELECT event_id, round(exp(logprob), 9) AS weight FROM t")
def self_certainty_weight(spark, sf_dir):
    return fixtures.raw_trajectories(spark, sf_dir).select("event_id", F.round(scalars.safe_exp(F.col("logprob")), 9).alias("weight"))


_SIGMOID = "least(1 - 1e-12, greatest(1e-12, 1 / (1 + exp(-(value - 50)))))"


@_query(f"SELECT event_id, round(coalesce({_SIGMOID}, 0.5), 9) AS p FROM events")
def sigmoid(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.round(scalars.sigmoid(F.col("value") - 50), 9).alias("p"))


@_query(f"SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 0 ELSE round(coalesce({_SIGMOID}, 0), 9) END::DOUBLE AS score FROM events")
def adapt_logits(spark, sf_dir):
    logit = F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 50)
    return _table(spark, sf_dir, "events").select("event_id", F.round(scalars.adapt_logits(logit), 9).alias("score"))


@_query(T + "SELECT event_id, coalesce(score, 0)::DOUBLE AS score FROM t")
def adapt_probability(spark, sf_dir):
    return fixtures.raw_trajectories(spark, sf_dir).select("event_id", scalars.adapt_probability(F.col("score")).alias("score"))


@_query("SELECT vec_id, round(list_sum([-abs(CAST(embedding[i] AS DOUBLE)) for i in range(1, len(embedding) + 1) if (i - 1) % 5 <> 4]) / len([i for i in range(1, len(embedding) + 1) if (i - 1) % 5 <> 4]), 6) AS logprob FROM embeddings")
def mean_logprob(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    logs = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    return rows.select("vec_id", F.round(scalars.mean_logprob(logs, _tokens(), 4), 6).alias("logprob"))


_P = "round(CASE WHEN x + y = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2))) FROM range(0, least(x, y) + 1) r(i))) END, 9)"


@_query(f"WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic <> 0) AS x, count(*) FILTER (quality <> 1 AND toxic = 0) AS y FROM labels) SELECT x AS only_a, y AS only_b, {_P}::DOUBLE AS p_value FROM c")
def mcnemar(spark, sf_dir):
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    rows = _table(spark, sf_dir, "labels").agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    return rows.select("only_a", "only_b", F.round(scalars.mcnemar_exact(F.col("only_a"), F.col("only_b")), 9).alias("p_value"))


@_query("SELECT CAST(n AS INTEGER) AS n, round(1 - pow(1 - (SELECT avg(quality) FROM labels), n), 9) AS coverage FROM (VALUES (1), (2), (4), (8), (16)) v(n)")
def coverage_law(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").agg(F.avg("quality").alias("p")).withColumn("n", F.explode(F.array(*map(F.lit, statistics.CURVE))))
    return rows.select("n", F.round(scalars.coverage_law(F.col("p"), F.col("n")), 9).alias("coverage"))


# ---- votes -----------------------------------------------------------------------------------------------


@_query(T + "SELECT DISTINCT problem_id, key, key AS rep FROM t WHERE key <> ''")
def merge_map(spark, sf_dir):
    return vote.merge_map(_traj(spark, sf_dir))


def _same_half(a: str, b: str) -> bool:
    """A stand-in for a symbolic backend: keys that differ in their first letter alone mean the same."""
    return a[1:] == b[1:]


@_query(
    T + """, m AS (SELECT problem_id, 'X' || (a // 2) AS class, CASE WHEN a % 2 = 0 THEN 'X' ELSE 'Y' END || (a // 2) AS key, count(*) AS n, min(sample_idx) AS first FROM t WHERE key <> '' GROUP BY ALL)
SELECT problem_id, key, first_value(key) OVER (PARTITION BY problem_id, class ORDER BY n DESC, first) AS rep FROM m"""
)
def merge_map_symbolic(spark, sf_dir):
    even = (F.col("ans_int") % 2) == 0
    key = F.when(F.col("key") == "", "").otherwise(F.concat(F.when(even, "X").otherwise("Y"), F.floor(F.col("ans_int") / 2).cast("string")))
    rows = _traj(spark, sf_dir).withColumn("key", key)
    before = answers.symbolic_backend()
    answers.set_symbolic_backend(_same_half)
    try:
        return vote.merge_map(rows)
    finally:
        answers.set_symbolic_backend(before)


@_query(T + "SELECT problem_id, key AS rep, CAST(count(*) AS DOUBLE) AS weight, min(sample_idx) AS first_idx FROM t WHERE key <> '' GROUP BY ALL")
def vote_tally(spark, sf_dir):
    return vote.vote_tally(_traj(spark, sf_dir))


@_query(T + "SELECT min(score) AS low, max(score) AS high, count(*) FILTER (score < 0 OR score > 1) AS n_bad FROM t")
def score_range(spark, sf_dir):
    return vote.score_range(fixtures.raw_trajectories(spark, sf_dir))


@_query(_winner("min(md5('5:' || problem_id || ':' || sample_idx))").replace("ORDER BY w DESC, f", "ORDER BY w, f"))
def select_random(spark, sf_dir):
    return vote.select_answers(_traj(spark, sf_dir), "random", seed=5)


@_query(_winner("count(*)"))
def select_majority(spark, sf_dir):
    return vote.select_answers(_traj(spark, sf_dir), "majority")


@_query(_winner("round(sum(exp(logprob)), 12)", ", false AS fell_back"))
def select_self_certainty(spark, sf_dir):
    return vote.select_answers(_traj(spark, sf_dir), "self_certainty")


@_query(_winner(SCORE, ", false AS fell_back"))
def select_verifier(spark, sf_dir):
    return vote.select_answers(_traj(spark, sf_dir), "verifier")


_ARGMAX = f"""{T}, r AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, sample_idx) AS nth FROM t WHERE key <> '' AND score IS NOT NULL)
SELECT p.problem_id, coalesce(r.key, '') AS answer FROM (SELECT DISTINCT problem_id FROM t) p LEFT JOIN r ON r.problem_id = p.problem_id AND nth = 1"""


@_query(_ARGMAX)
def select_verifier_argmax(spark, sf_dir):
    return vote.select_answers(_traj(spark, sf_dir), "verifier_argmax")


@_query(T + "SELECT problem_id, CASE WHEN bool_or(key = gold) THEN min(gold) ELSE '' END AS answer FROM t GROUP BY problem_id")
def select_oracle(spark, sf_dir):
    return vote.select_answers(_traj(spark, sf_dir), "oracle", gold="gold")


@_query(_winner("CASE WHEN problem_id % 5 = 0 THEN count(*) ELSE sum(coalesce(score, 0)) END", ", p.problem_id % 5 = 0 AS fell_back"))
def zero_weight_fallback(spark, sf_dir):
    return vote.select_answers(fixtures.with_zero_scores(_traj(spark, sf_dir)), "verifier")


@_query(
    f"SELECT a.problem_id, a.answer AS random, b.answer AS majority, c.answer AS self_certainty, d.answer AS verifier, e.answer AS verifier_argmax, f.answer AS oracle FROM "
    + " JOIN ".join(
        f"({sql}) {x}" + (f" ON a.problem_id = {x}.problem_id" if x != "a" else "")
        for x, sql in zip(
            "abcdef",
            (ORACLE["select_random"].replace("'5:'", "'0:'"), ORACLE["select_majority"], ORACLE["select_self_certainty"], ORACLE["select_verifier"], _ARGMAX, ORACLE["select_oracle"]),
            strict=True,
        )
    )
)
def all_selectors(spark, sf_dir):
    return vote.all_selectors(_traj(spark, sf_dir), "gold")


# ---- accounting ------------------------------------------------------------------------------------------


@_query(T + ", c AS (SELECT problem_id, key, count(*) AS n FROM t WHERE key <> '' GROUP BY ALL) SELECT p.problem_id, coalesce(max(n) / sum(n), 0)::DOUBLE AS agreement FROM (SELECT DISTINCT problem_id FROM t) p LEFT JOIN c USING (problem_id) GROUP BY ALL")
def agreement(spark, sf_dir):
    return accounting.agreement(_traj(spark, sf_dir))


@_query(T + "SELECT problem_id, bool_or(key = gold) AS covered FROM t GROUP BY ALL")
def coverage(spark, sf_dir):
    return accounting.coverage(_traj(spark, sf_dir), "gold")


_RIGHT = f"SELECT m.problem_id, m.answer, m.answer = CAST(3 + m.problem_id % 40 AS VARCHAR) AS correct FROM ({_winner('count(*)')}) m"


@_query(_RIGHT)
def is_correct(spark, sf_dir):
    return accounting.is_correct(_traj(spark, sf_dir), "gold")


@_query(
    f"SELECT r.problem_id, r.correct, c.covered, CASE WHEN r.correct THEN 'working' WHEN c.covered THEN 'selection problem' ELSE 'generation problem' END AS diagnosis FROM ({_RIGHT}) r JOIN ({ORACLE['coverage']}) c USING (problem_id)"
)
def diagnosis(spark, sf_dir):
    return accounting.diagnosis(_traj(spark, sf_dir), "gold")


@_query(
    T + """SELECT problem_id, count(*) AS n, count(*) FILTER (key <> '') AS effective_n, count(*) FILTER (key = '') AS n_abstained,
  count(*) FILTER (finish_reason = 'length') AS n_truncated, CAST(sum(n_tokens) AS BIGINT) AS total_tokens FROM t GROUP BY ALL"""
)
def pool_accounting(spark, sf_dir):
    return accounting.pool_accounting(_traj(spark, sf_dir))


_CORPUS = """count(DISTINCT problem_id) AS problems, count(*) AS n_generated, count(*) FILTER (key <> '') AS voters, count(*) FILTER (key = '') AS abstained,
  count(*) FILTER (finish_reason = 'length') AS truncated, CAST(sum(n_tokens) AS BIGINT) AS tokens,
  round(100.0 * count(*) FILTER (key = '') / count(*), 9)::DOUBLE AS abstention_rate, round(100.0 * count(*) FILTER (finish_reason = 'length') / count(*), 9)::DOUBLE AS truncation_rate"""


@_query(T + f"SELECT {_CORPUS} FROM t")
def corpus_accounting(spark, sf_dir):
    out = accounting.corpus_accounting(_traj(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("abstention_rate", "truncation_rate")})


@_query(T + "SELECT round(count(*) FILTER (key = gold) / count(*), 9)::DOUBLE AS p FROM t")
def per_trajectory_accuracy(spark, sf_dir):
    return statistics.per_trajectory_accuracy(_traj(spark, sf_dir), "gold").select(F.round("p", 9).alias("p"))


@_query(T + "SELECT min(n) AS n_max FROM (SELECT count(*) AS n FROM t GROUP BY problem_id)")
def min_pool_size(spark, sf_dir):
    return statistics.min_pool_size(fixtures.raw_trajectories(spark, sf_dir))


# ---- statistics ------------------------------------------------------------------------------------------

REPS, DRAWS, CURVE_SEED = statistics.RESAMPLES, statistics.BOOTSTRAP, 3


def _mixed(rows: str, value: str, out: str) -> str:
    """SQL: ``rows`` with 32 mixed bits of a 32-bit value."""
    return f"""SELECT * EXCLUDE (m0, m1, m2) FROM (SELECT *, ({value}) AS m0, (xor(m0, m0 >> 16) * {0x7FEB352D}) & 4294967295 AS m1, (xor(m1, m1 >> 15) * {0x46CA68B1}) & 4294967295 AS m2, xor(m2, m2 >> 16) AS {out} FROM ({rows}))"""


def _uniform(draws: int, seed: int) -> str:
    """SQL: sorted uniform numbers of the draws of a bootstrap."""
    streams = _mixed(f"SELECT b FROM range(0, {draws}) x(b)", f"({seed} * 1000003 + b) & 4294967295", "stream")
    return f"(SELECT list_sort(list((h + 0.5) / CAST(4294967296 AS DOUBLE))) FROM ({_mixed(streams, 'stream', 'h')}))"


def _ends(hits: str, draws: int, seed: int) -> str:
    """SQL: rows (id, h, m) of hits among rows, with the ends of their bootstrap intervals."""
    u = _uniform(draws, seed)
    return f"""SELECT id, any_value(h) AS h, any_value(m) AS m, 100 * CAST(min(s) FILTER (cdf >= {u}[{int(0.025 * draws) + 1}]) AS DOUBLE) / any_value(m) AS low, 100 * CAST(min(s) FILTER (cdf >= {u}[{min(draws - 1, int(0.975 * draws)) + 1}]) AS DOUBLE) / any_value(m) AS high
FROM (SELECT id, h, m, s, sum(exp(lgamma(m + 1) - lgamma(s + 1) - lgamma(m - s + 1) + s * ln(h / m) + (m - s) * ln(1 - h / m))) OVER (PARTITION BY id ORDER BY s) AS cdf FROM (SELECT id, h, m, unnest(range(0, m + 1)) AS s FROM ({hits}))) GROUP BY id"""


_REP = _mixed(f"SELECT CAST(rep AS BIGINT) AS rep FROM range(0, {REPS}) x(rep)", f"({CURVE_SEED} * 1000003 + rep) & 4294967295", "stream")
_PLACE = "SELECT DISTINCT problem_id, CAST('0x' || substr(md5(CAST(problem_id AS VARCHAR)), 1, 8) AS BIGINT) AS place FROM t"
_DRAW = _mixed(f"SELECT * FROM ({_mixed(f'SELECT * FROM ({_REP}), ({_PLACE})', 'xor(stream, place)', 'pool')}) JOIN (SELECT problem_id, sample_idx, key, gold FROM t) USING (problem_id)", "xor(pool, CAST(sample_idx AS BIGINT))", "h")
_CURVE = f"""{T}, d AS (SELECT problem_id, rep, key, gold, row_number() OVER (PARTITION BY problem_id, rep ORDER BY h, sample_idx) AS nth FROM ({_DRAW})),
x AS (SELECT d.*, n FROM d, (VALUES (1), (2), (4), (8), (16)) v(n) WHERE nth <= n AND n <= (SELECT min(c) FROM (SELECT count(*) AS c FROM t GROUP BY problem_id))),
k AS (SELECT n, rep, problem_id, key, min(gold) AS gold, count(*) AS votes, min(nth) AS first FROM x GROUP BY ALL),
o AS (SELECT n, rep, problem_id, min(gold) AS gold, bool_or(key = gold)::INT AS coverage, arg_min(key, first) FILTER (key <> '') AS r, arg_max(key, votes * 100 - first) FILTER (key <> '') AS m FROM k GROUP BY ALL),
s AS (SELECT n, rep, avg(coalesce(r = gold, false)::INT) AS random, avg(coalesce(m = gold, false)::INT) AS majority, avg(coverage) AS coverage, count(*) AS problems, sum(coalesce(m = gold, false)::INT) AS hits FROM o GROUP BY ALL),
curve AS (SELECT CAST(n AS INTEGER) AS n, 100 * avg(random) AS random, 100 * avg(majority) AS majority, 100 * avg(coverage) AS coverage, 100 * stddev_pop(majority) AS sd FROM s GROUP BY ALL),
once AS ({_ends("SELECT n AS id, CAST(hits AS DOUBLE) AS h, problems AS m FROM s WHERE rep = 0", DRAWS, CURVE_SEED)})
"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.accuracy_curve(_traj(spark, sf_dir), "gold", seed=CURVE_SEED)


@_query(_CURVE + "SELECT n, round(random, 6) AS random, round(majority, 6) AS majority, round(coverage, 6) AS coverage FROM curve")
def accuracy_curve(spark, sf_dir):
    return _curve(spark, sf_dir).select("n", *(F.round(c, 6).alias(c) for c in ("random", "majority", "coverage")))


@_query(_CURVE + "SELECT n, round(sd, 6) AS sd FROM curve")
def curve_sd(spark, sf_dir):
    return _curve(spark, sf_dir).select("n", F.round("sd", 6).alias("sd"))


@_query(_CURVE + "SELECT CAST(id AS INTEGER) AS n, round(low, 6) AS low, round(high, 6) AS high FROM once")
def curve_interval(spark, sf_dir):
    return _curve(spark, sf_dir).select("n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_COMB = "list_product([greatest(N - {0} - i, 0) / (N - i) for i in range(0, n)])"


@_query(
    T + f""", p AS (SELECT problem_id, count(*) AS N, count(*) FILTER (key <> '') AS v, count(*) FILTER (key = gold) AS c FROM t GROUP BY ALL)
SELECT CAST(n AS INTEGER) AS n, round(100 * avg(CASE WHEN v = 0 THEN 0 ELSE c / v * (1 - {_COMB.format('v')}) END), 6) AS random, round(100 * avg(1 - {_COMB.format('c')}), 6) AS coverage
FROM (SELECT p.problem_id, p.N, p.v, p.c, s.n FROM p, (VALUES (1), (2), (4), (8), (16)) s(n)) WHERE n <= N GROUP BY n""".replace(" N,", " pool,").replace("AS N", "AS pool").replace("p.N", "p.pool").replace("<= N ", "<= pool ").replace("(N -", "(pool -")
)
def expected_curve(spark, sf_dir):
    rows = statistics.expected_curve(_traj(spark, sf_dir), "gold")
    return rows.select("n", *(F.round(c, 6).alias(c) for c in ("random", "coverage")))


@_query(f"SELECT round(low, 9) AS low, round(high, 9) AS high FROM ({_ends('SELECT 0 AS id, CAST(sum(quality) AS DOUBLE) AS h, count(*) AS m FROM labels', DRAWS, 17)})")
def bootstrap_ci(spark, sf_dir):
    out = statistics.bootstrap_ci(_table(spark, sf_dir, "labels"), F.col("quality") == 1, seed=17)
    return out.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@_query(
    _CURVE + """SELECT round(max(CASE WHEN n = hi THEN random END) - max(CASE WHEN n = lo THEN random END), 6) AS abstention_gain,
  round(max(CASE WHEN n = hi THEN majority - random END), 6) AS voting_gain, round(max(CASE WHEN n = hi THEN majority END) - max(CASE WHEN n = lo THEN random END), 6) AS total_gain
FROM curve, (SELECT min(n) AS lo, max(n) AS hi FROM curve)"""
)
def gain_decomposition(spark, sf_dir):
    out = statistics.gain_decomposition(_curve(spark, sf_dir))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


_PAIRS = f"""SELECT m.problem_id, m.answer = CAST(3 + m.problem_id % 40 AS VARCHAR) AS majority, r.answer = CAST(3 + m.problem_id % 40 AS VARCHAR) AS random
FROM ({_winner('count(*)')}) m JOIN ({ORACLE['select_random'].replace("'5:'", "'0:'")}) r ON r.problem_id = m.problem_id"""
_DISCORDANT = f"WITH pairs AS ({_PAIRS}), c AS (SELECT count(*) FILTER (majority AND NOT random) AS x, count(*) FILTER (random AND NOT majority) AS y FROM pairs)"


@_query(f"{_DISCORDANT} SELECT x AS majority_only, y AS random_only, {_P}::DOUBLE AS p_value FROM c")
def paired_discordance(spark, sf_dir):
    return statistics.paired_discordance(_traj(spark, sf_dir), "gold").withColumn("p_value", F.round("p_value", 9))


@_query(f"SELECT round(100 * h / m, 9) AS accuracy, round(low, 9) AS low, round(high, 9) AS high FROM ({_ends(f'SELECT 0 AS id, CAST(sum(majority::INT) AS DOUBLE) AS h, count(*) AS m FROM ({_PAIRS})', DRAWS, 17)})")
def majority_accuracy(spark, sf_dir):
    out = statistics.majority_accuracy(_traj(spark, sf_dir), "gold", seed=17)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@_query(
    f"""SELECT a.problems, (SELECT CAST(max(n) AS INTEGER) FROM c) AS n_generated, round(100 * b.p, 2) AS per_trajectory_accuracy, round(a.abstention_rate, 2) AS abstention_rate, round(a.truncation_rate, 2) AS truncation_rate, a.tokens AS total_tokens,
  d.majority_only, d.random_only, round(d.p_value, 6) AS p_value, (SELECT count(*) FROM events WHERE event_id % 97 = 0) AS reextraction_drift,
  c.n, round(c.random, 2) AS random, round(c.majority, 2) AS majority, round(c.coverage, 2) AS coverage, round(c.sd, 3) AS sd, round(c.low, 2) AS low, round(c.high, 2) AS high
FROM ({ORACLE['corpus_accounting']}) a, ({ORACLE['per_trajectory_accuracy']}) b, ({ORACLE['paired_discordance']}) d, c""".join([f"WITH c AS ({_CURVE} SELECT curve.*, once.low, once.high FROM curve JOIN once ON once.id = curve.n) ", ""])
)
def summary(spark, sf_dir):
    rows = _traj(spark, sf_dir).withColumn("answer", F.when(F.col("event_id") % 97 == 0, "stale").otherwise(F.col("answer")))
    out = statistics.summary(rows, "gold", seed=CURVE_SEED)
    out = out.withColumn("c", F.explode("curve")).select("*", "c.*", "mcnemar_majority_vs_random.*").withColumns({"low": F.col("majority_ci95")[0], "high": F.col("majority_ci95")[1]})
    return out.drop("c", "curve", "mcnemar_majority_vs_random", "majority_ci95")


@_query(T + "SELECT problem_id, sample_idx FROM t QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY md5('9:' || problem_id || ':' || sample_idx), sample_idx) <= 4")
def subsample_k(spark, sf_dir):
    return statistics.subsample(fixtures.raw_trajectories(spark, sf_dir).select("problem_id", "sample_idx"), 4, seed=9)


@_query("SELECT o_orderkey FROM orders ORDER BY md5('13:' || o_orderkey), o_orderkey LIMIT 100")
def shuffle_limit(spark, sf_dir):
    return tables.shuffle_limit(_table(spark, sf_dir, "orders").select("o_orderkey"), 100, 13, "o_orderkey")


# ---- user functions and joins ----------------------------------------------------------------------------


def _last_word(text: str) -> str:
    return text.rpartition(" ")[2]


def _length_score(problem: str, text: str) -> float:
    return (len(problem) + len(text)) % 64 / 64


@_query(T + "SELECT event_id, regexp_extract(text, '([^ ]*)$', 1) AS answer FROM t")
def udf_extractor(spark, sf_dir):
    return fixtures.raw_trajectories(spark, sf_dir).select("event_id", answers.get_extractor(_last_word)(F.col("text")).alias("answer"))


@_query(T + "SELECT event_id, CAST((length(question) + length(text)) % 64 AS DOUBLE) / 64 AS score FROM t")
def udf_verifier(spark, sf_dir):
    rows = scoring.score_all(fixtures.raw_trajectories(spark, sf_dir).drop("score"), scoring.from_callable(_length_score, already_probability=True))
    return rows.select("event_id", "score")


@_query(T + "SELECT problem_id, sample_idx, key, CASE WHEN problem_id % 7 <> 0 THEN gold END AS gold FROM t")
def join_gold(spark, sf_dir):
    rows = _traj(spark, sf_dir)
    golds = rows.where("problem_id % 7 <> 0").select("problem_id", "gold").distinct()
    return rows.select("problem_id", "sample_idx", "key").join(golds, "problem_id", "left")
