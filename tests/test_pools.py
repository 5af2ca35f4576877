"""Selection, accounting, statistics, sources and the engine."""

import math
import random

import pytest
from pyspark.sql import functions as F

from poolwise import queries
from poolwise.functions import answers, scalars
from poolwise.operators import accounting, scoring, vote
from poolwise.plans import statistics
from poolwise.plans.engine import PoolEngine, check_sampling, fake_backend, resolve_backend
from poolwise.sources import fixtures, tables
from poolwise.streaming.votes import incremental_votes

SF = "/root/testdata/sf0.001"
ROW = "problem_id long, sample_idx int, key string, score double, logprob double, gold string"


def pool(spark, *rows, gold="1"):
    return spark.createDataFrame([(0, k, key, None if score is None else float(score), logprob, gold) for k, (key, score, logprob) in enumerate(rows)], ROW)


def chosen(df, method, **options):
    return vote.select_answers(df, method, "gold", **options).first()["answer"]


def test_ties_go_to_the_first_seen(spark):
    df = pool(spark, ("b", 0.5, -1.0), ("a", 0.5, -1.0), ("a", 0.0, -1.0), ("b", 0.0, -1.0), ("", 1.0, 0.0))
    assert [chosen(df, m) for m in ("majority", "verifier", "self_certainty", "verifier_argmax")] == ["b"] * 4
    assert [chosen(df.repartition(5), m) for m in ("majority", "verifier", "self_certainty")] == ["b"] * 3


def test_near_ties_add_in_order(spark):
    df = pool(spark, ("a", 0.1, 0.0), ("a", 0.2, 0.0), ("a", 0.3, 0.0), ("b", 0.6, 0.0))
    assert 0.1 + 0.2 + 0.3 != 0.6 and chosen(df, "verifier") == "a"
    assert chosen(df.orderBy(F.desc("sample_idx")), "verifier") == "a"


#: "a" and "b" have the same log-probabilities; added in their own orders, the sum of "b" is greater by its last digit.
NEAR_TIE = [("a", 0, p) for p in (-0.125, -0.25, -0.625)] + [("b", 0, p) for p in (-0.625, -0.25, -0.125)]


def test_all_selectors_tie_at_twelve_places(spark):
    x, y, z = map(math.exp, (-0.125, -0.25, -0.625))
    assert x + y + z < z + y + x
    assert vote.all_selectors(pool(spark, *NEAR_TIE), "gold").first()["self_certainty"] == "a"


def test_self_certainty_ties_at_twelve_places(spark):
    assert chosen(pool(spark, *NEAR_TIE), "self_certainty") == "a"
    assert chosen(pool(spark, *NEAR_TIE[3:], *NEAR_TIE[:3]), "self_certainty") == "b"
    small = vote.select_answers(pool(spark, ("a", 0, -41.0), ("b", 0, -40.0), ("c", 0, -1000.0)), "self_certainty").first()
    assert small["answer"] == "b" and not small["fell_back"]
    assert chosen(pool(spark, ("a", 0, 0.0), ("b", 0, 800.0)), "self_certainty") == "b"


def test_self_certainty_ties_in_large_pools(spark):
    """Both answers have the same weights; added in order, which loses more than 12 places bear, "b" has 2e-13 more."""
    low, high = [("a", 0, -0.125)] * 60, [("a", 0, -0.75)] * 60
    df = pool(spark, *low, *high, *(("b", *w) for _, *w in high + low))
    assert chosen(df, "self_certainty") == "a" == chosen(df.orderBy(F.desc("sample_idx")).repartition(5), "self_certainty")
    assert vote.all_selectors(df, "gold").first()["self_certainty"] == "a"
    got = df.groupBy("key").agg(vote.settled_sum(F.exp("logprob")).alias("w")).collect()
    assert {r["w"] for r in got} == {round(math.fsum([math.exp(-0.125), math.exp(-0.75)] * 60), 12)}


def test_nan_and_missing_weights(spark):
    df = pool(spark, ("a", math.nan, math.nan), ("b", 0.25, None), ("a", None, math.inf), ("c", 0.25, -0.5))
    assert chosen(df, "verifier") == "b" and chosen(df, "self_certainty") == "c" and chosen(df, "verifier_argmax") == "b"
    assert chosen(pool(spark, ("a", 0.0, 5.0), ("b", 0.0, -1.0), ("b", 0.0, -1.0)), "self_certainty") == "a"


def test_fallback_is_told(spark):
    df = pool(spark, ("a", 0.0, 0.0), ("b", 0.0, 0.0), ("b", 0.0, 0.0))
    out = vote.select_answers(df, "verifier")
    assert tuple(out.first()) == (0, "b", True)
    with pytest.warns(RuntimeWarning):
        assert vote.warn_of_fallback(out) == 1


def test_abstention_and_oracle(spark):
    df = pool(spark, ("", 0.5, -1.0), ("", 0.5, -1.0))
    assert [chosen(df, m, validate=False) for m in vote.METHODS] == [""] * 6
    assert chosen(pool(spark, ("2", 0, 0.0), ("1", 0, 0.0), gold=" 1.0 "), "oracle") == "1"
    assert chosen(pool(spark, ("2", 0, 0.0), gold="nan"), "oracle") == ""


def test_invalid_input_fails(spark):
    bad = pool(spark, ("a", 0.5, None), ("", 1.5, None))
    for method, error in (("verifier", "probabilities"), ("verifier_argmax", "probabilities"), ("self_certainty", "log-prob")):
        with pytest.raises(ValueError, match=error):
            vote.select_answers(bad, method)
    with pytest.raises(ValueError, match="finite score"):
        vote.select_answers(pool(spark, ("a", None, 0.0)), "verifier")
    for method in ("oracle", "best"):
        with pytest.raises(ValueError):
            vote.select_answers(bad, method)


def test_random_choice(spark):
    df = fixtures.trajectories(spark, SF)
    first = vote.select_answers(df, "random", seed=1).collect()
    assert sorted(first) == sorted(vote.select_answers(df.repartition(7), "random", seed=1).collect())
    assert sorted(first) != sorted(vote.select_answers(df, "random", seed=2).collect())
    slots = vote.select_random_slot(df, 4).join(df.where("key <> ''").groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "key"))).alias("v")), "problem_id").collect()
    assert all(r["v"][random.Random(4).choice(range(len(r["v"])))]["key"] == r["answer"] for r in slots)


def test_merging_with_a_backend(spark):
    df = pool(spark, ("2*3", 0, 0.0), ("6", 0, 0.0), ("6", 0, 0.0), ("7", 0, 0.0), ("7", 0, 0.0), gold="6")
    assert chosen(df, "majority") == "6"
    answers.set_symbolic_backend(lambda a, b: {a, b} <= {"2*3", "6"})
    try:
        assert {r["key"]: r["rep"] for r in vote.merge_map(df).collect()} == {"2*3": "6", "6": "6", "7": "7"}
        assert chosen(df, "majority") == "6"
        many = pool(spark, *((f"k{i}", 0, 0.0) for i in range(30)))
        assert all(r["key"] == r["rep"] for r in vote.merge_map(many).collect())
    finally:
        answers.set_symbolic_backend(None)


def test_merging_more_pools_than_are_read_at_once(spark):
    n = 2 * vote.MERGE_POOLS + 1
    rows = spark.range(n).selectExpr("id AS problem_id", "explode(array('x', 'y', 'y', '7')) AS key").withColumn("sample_idx", F.monotonically_increasing_id())
    answers.set_symbolic_backend(lambda a, b: {a, b} == {"x", "y"})
    try:
        got = vote.merge_map(rows.coalesce(1)).collect()
    finally:
        answers.set_symbolic_backend(None)
    assert sorted(got) == sorted((k, *pair) for k in range(n) for pair in (("x", "y"), ("y", "y"), ("7", "7")))


def test_accounting(spark):
    df = pool(spark, ("a", 0, 0.0), ("a", 0, 0.0), ("b", 0, 0.0), ("", 0, 0.0), gold="A")
    df = df.withColumns({"finish_reason": F.when(F.col("key") == "", "length"), "n_tokens": F.lit(None).cast("int"), "answer": F.col("key")})
    assert tuple(accounting.pool_accounting(df).first()) == (0, 4, 3, 1, 1, None)
    assert accounting.agreement(df).first()["agreement"] == 2 / 3
    assert accounting.answers_list(df).first()["answers"] == ["a", "a", "b", ""]
    assert accounting.corpus_accounting(df).first()["tokens"] == 0
    upper = df.withColumn("key", F.upper("key"))
    assert accounting.diagnosis(upper, "gold").first()["diagnosis"] == "working"
    assert not accounting.coverage(upper.withColumn("gold", F.lit("inf")), "gold").first()["covered"]


def test_curve_meets_closed_form(spark):
    df = fixtures.trajectories(spark, SF).where("problem_id < 24")
    drawn = {r["n"]: r for r in statistics.accuracy_curve(df, "gold", reps=60).collect()}
    exact = {r["n"]: r for r in statistics.expected_curve(df, "gold").collect()}
    assert set(drawn) == {1, 2, 4, 8, 16} == set(exact)
    for n in drawn:
        assert abs(drawn[n]["coverage"] - exact[n]["coverage"]) < 6 and abs(drawn[n]["random"] - exact[n]["random"]) < 6
    assert drawn[1]["majority"] == drawn[1]["random"] and drawn[16]["coverage"] == pytest.approx(exact[16]["coverage"])


def test_bootstrap_edges(spark):
    hits = spark.createDataFrame([(k, True) for k in range(9)], "k long, h boolean")
    assert tuple(statistics.bootstrap_ci(hits, F.col("h"), draws=40).first()) == (100, 100)
    assert tuple(statistics.bootstrap_ci(hits.where("false"), F.col("h"), draws=40).first()) == (0, 0)


def test_draws_of_a_bootstrap_are_binomial():
    import numpy as np

    for hits, n in ((0, 7), (7, 7), (3, 11), (180, 400)):
        u = (np.arange(97) + 0.5) / 97
        mass = [math.comb(n, k) * (hits / n) ** k * (1 - hits / n) ** (n - k) for k in range(n + 1)]
        expected = [min((k for k in range(n + 1) if sum(mass[: k + 1]) >= x - 1e-12), default=n) for x in u]
        assert statistics.quantiles(hits, n, u).tolist() == expected
    drawn = [sum(random.Random(k).choices([1, 0], [180, 220], k=400)) for k in range(4000)]
    got = statistics.quantiles(180, 400, np.array([0.025, 0.5, 0.975]))
    assert all(abs(a - b) <= 2 for a, b in zip(got, (sorted(drawn)[100], sorted(drawn)[2000], sorted(drawn)[3900]), strict=True))
    big = statistics.quantiles(4 * 10**9, 10**10, np.array([0.025, 0.975]))
    assert abs((big[1] - big[0]) / 2 / 1.96 - math.sqrt(10**10 * 0.24)) < 100


def test_mcnemar_of_many(spark):
    a, b = 5 * 10**8, 5 * 10**8 - 40_000
    z = (abs(a - b) - 1) / math.sqrt(a + b)
    p = spark.sql(f"SELECT {a}L AS a, {b}L AS b").select(scalars.mcnemar_exact(F.col("a"), F.col("b"))).first()[0]
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_subsample_of_all_is_the_pool(spark):
    df = fixtures.raw_trajectories(spark, SF).where("problem_id < 5")
    assert statistics.subsample(df, 16).count() == 80 and statistics.subsample(df, 3).count() == 15


def test_json_round_trip(spark, tmp_path):
    nested = fixtures.nested(spark, SF)
    tables.append_nested(nested, f"{tmp_path}/a")
    tables.append_nested(nested.limit(1), f"{tmp_path}/a")
    back = tables.read_nested(spark, f"{tmp_path}/a")
    assert back.count() == nested.count() + 1
    (tmp_path / "b.json").write_text('\n{"i": 1, "gold": "5", "trajectories": [{"text": "é \\\\boxed{5}", "answer": "5"}]}\n\n')
    rows = tables.explode_trajectories(tables.read_nested(spark, f"{tmp_path}/b.json"))
    assert rows.count() == 1 and statistics.reextraction_drift(tables.read_nested(spark, f"{tmp_path}/b.json")).first()["drift"] == 0
    with pytest.raises(FileNotFoundError):
        tables.read_nested(spark, f"{tmp_path}/none")
    tables.write_summary(statistics.summary(fixtures.trajectories(spark, SF), "gold", reps=2), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").first()["problems"] == 63


def test_scoring(spark):
    class Half:
        def score_batch(self, problems, texts):
            raise RuntimeError("no batches")

        def __call__(self, problem, text):
            return 0.5

    rows = spark.createDataFrame([("p", "t")] * 3, "question string, text string")
    assert [r["score"] for r in scoring.score_all(rows, Half()).collect()] == [0.5] * 3
    assert [r["score"] for r in scoring.score_all(rows, None).collect()] == [None] * 3
    model = scoring.from_hub("some/model", lambda _: lambda chats: [math.nan if c[0]["content"] == "n" else 0.0 for c in chats])
    assert model.score_batch(["p", "n"] * 5, ["t"] * 10) == [0.5, 0.0] * 5 and model("p", "t") == 0.5
    assert scoring.from_callable(lambda p, t: math.nan)("", "") == 0.0 and scoring.sigmoid_of("x") == 0.5
    assert scoring.sigmoid_of(-1000) == 1e-12 and abs(scoring.sigmoid_of(2) - 1 / (1 + math.exp(-2))) < 1e-15
    with pytest.raises(ValueError):
        scoring.from_callable(lambda p, t: 2.0, already_probability=True)("", "")
    with pytest.warns(UserWarning):
        assert scoring.warn_of_licence("who/knows", lambda _: None) == "unknown"
    assert scoring.warn_of_licence("openbmb/Eurus-RM-7b", lambda _: None) == "apache-2.0"

    def broken(*_, **__):
        raise OSError

    assert scoring.license_of("a/b", opener=broken) is None


def test_engine(spark):
    problems = spark.createDataFrame([(k, f"question {k}", "1") for k in range(6)], "problem_id long, question string, gold string")
    engine = PoolEngine(lambda: fake_backend, n=6, logprobs=True, verifier=scoring.from_callable(lambda p, t: len(t) % 3), batch=2)
    for method in vote.METHODS:
        out = engine.solve(problems, method=method)
        assert out.count() == 6 and {"answer", "effective_n", "agreement", "correct", "covered"} <= set(out.columns)
    assert engine.solve(problems, n=1).first()["n"] == 1
    for wrong in (lambda: check_sampling(0, 1), lambda: check_sampling(2, 0), lambda: engine.solve(problems, method="no"), lambda: resolve_backend("gpu")):
        with pytest.raises(ValueError):
            wrong()
    bare = PoolEngine(lambda: fake_backend, n=2)
    for method in ("verifier", "self_certainty", "oracle"):
        with pytest.raises(ValueError):
            bare.solve(problems.drop("gold"), method=method)


def test_stream_equals_batch(spark, tmp_path):
    keyed = fixtures.trajectories(spark, SF).select("problem_id", "sample_idx", "key")
    keyed.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = incremental_votes(stream).writeStream.outputMode("complete").format("memory").queryName("votes").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = incremental_votes(keyed)
    assert sorted(spark.table("votes").collect()) == sorted(batch.collect())
    majority = {r[0]: r[1] for r in vote.select_answers(keyed, "majority").collect()}
    assert {r[0]: r[1] for r in batch.collect()} == majority


def test_coerced_inputs(spark):
    rows = spark.createDataFrame([('{"answer": "1", "score": 0.5}',), ('{"respuesta": "2", "certeza": -1.5, "texto": "t"}',), ('{"answer": null, "respuesta": "5"}',), ("{}",)], "value string")
    got = [tuple(r) for r in tables.coerce_inputs(rows, "dicts").select("answer", "text", "logprob", "score").collect()]
    assert got == [("1", "", None, 0.5), ("2", "t", -1.5, None), ("", "", None, None), ("", "", None, None)]


def test_partitioned_votes_need_one_exchange(spark):
    keyed = fixtures.trajectories(spark, SF).select("problem_id", "sample_idx", "key").repartition("problem_id")
    plan = vote.select_answers(keyed, "majority")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["merge_map", "merge_map_symbolic", "vote_tally", "voting"])
def test_filter_on_keys_does_not_repeat_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 2  # the answer, and the key
