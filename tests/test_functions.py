"""Answers and scalars, through DataFrames; native paths against the plain functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolwise.functions import answers, latex, scalars


def outputs(spark, column, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"n int, v {kind}")
    return [r[0] for r in rows.select("n", column(F.col("v")).alias("o")).orderBy("n").select("o").collect()]


BOXES = {
    r"so \boxed{42}": "42",
    r"\boxed{-7}": "-7",
    r"\boxed{1} then \boxed{2}": "2",
    r"\boxed{\frac{1}{2}}": "1/2",
    r"\boxed{\dfrac{10}{4}}": "10/4",
    r"\boxed{\frac{-10}{4}}": "-10/4",
    r"\boxed{1} and \boxed{2": "",
    r"\boxed{}": "",
    "none here 5": "",
    r"\boxed{2\sqrt{5}}": "2sqrt(5)",
    r"\boxed{\frac{\sqrt{3}}{2}}": "sqrt(3)/2",
    r"\boxed{204\text{ km}}": "204",
    r"\boxed{9 \text{ cm^2}}": "9",
    r"\boxed{\text{Lima}}": "Lima",
    r"\boxed{(3, 4)}": "(3,4)",
    r"\boxed{[0,1)}": "[0,1)",
    r"\boxed{\{1,2\}}": "{1,2}",
    r"\boxed{(2)(3)}": "(2)(3)",
    r"\boxed{1,000}": "1000",
    r"\boxed{1{,}000}": "1000",
    r"\boxed{\frac12}": "",
    r"\boxed{50\%}": "50",
    r"\boxed{\textbf{42}}": "textbf42",
    r"\boxed{\infty}": "inf",
    r"\boxed{5\text{ or }6}": "56",
    r"\boxed{\frac{1}{2}x}": "1/2x",
    r"\boxed{(-3)^2}": "-3**2",
    r"\boxed{12.50}": "12.50",
}


def test_boxed(spark):
    assert outputs(spark, answers.extract_boxed, [*BOXES, None]) == [*BOXES.values(), ""]
    assert outputs(spark, lambda c: answers.extract_boxed(c, True), ["ends in 1,234.5", r"\boxed{3} is \boxed{", None]) == ["1234.5", "3", ""]


@pytest.mark.parametrize("depth, resolved", [(23, True), (24, True), (25, False)])
def test_nesting(depth, resolved):
    text = "x"
    for _ in range(depth):
        text = r"\sqrt{" + text + "}"
    assert (latex.latex_to_text(text) is not None) == resolved


NORMAL = {
    "204.0": "204", " 204 ": "204", " 7 ": "7", "3..": "3", "2/4": "1/2", "-6/4": "-3/2", "4/2": "2", "1/0": "", "inf": "", "nan": "", "Infinity": "", "": "",
    "1_000": "1000", "2d": "2D", "2f": "2F", "1e3": "1000", "1e-5": "1e-05", "9007199254740993": "9007199254740992", "٣": "3", "aB c": "ABC", "1,000": "1000", "1,00": "1,00",
    "0.50": "0.5", "00.5": "0.5", "-0.0": "0", "-0.25": "-0.25", "123456789.125": "123456789.125", "0.00001": "1e-05", "+5": "5", ".5": "0.5", "x/y": "X/Y", "t": "T", "E": "E", "yes": "YES",
    "1 / 2": "1/2", "٣/٤": "3/4", "a\tb": "AB", "...": "", "12345678901234567890": "12345678901234567168", "1/3 .": "1/3", "2/4 .": "2/4", "i": "I", "nay": "NAY",
}


def test_normalise(spark):
    assert outputs(spark, answers.normalise, [*NORMAL, None]) == [*NORMAL.values(), ""]
    assert [latex.normalise(x) for x in NORMAL] == [*NORMAL.values()]


TEXTS = st.text(alphabet="0123456789.-+/eE_dfinaxy,(){}\\  ٣\t", max_size=12)


@settings(max_examples=6, deadline=None)
@given(st.lists(TEXTS, min_size=40, max_size=120))
def test_native_is_plain(spark, texts):
    texts = [t for t in texts if "\x00" not in t]
    assert outputs(spark, answers.normalise, texts) == [latex.normalise(t) for t in texts]
    assert outputs(spark, answers.numeric_key, texts) == [latex.numeric_key(t) for t in texts]
    assert outputs(spark, answers.strip_thousands, texts) == [latex.strip_thousands(t) for t in texts]
    assert outputs(spark, answers.is_atomic, texts) == [latex.is_atomic(t) for t in texts]
    boxed = ["\\boxed{" + t + "}" for t in texts]
    assert outputs(spark, answers.extract_boxed, boxed) == [latex.boxed(t) for t in boxed]


def test_letters_and_numbers(spark):
    letters = {r"\boxed{c}": "C", r"\boxed{\mathrm{C}}": "A", r"\boxed{7}. Because": "B", "A or B": "B", "éA then Bé": "", "the C.": "C", "": "", "a b": ""}
    assert outputs(spark, answers.extract_letter, list(letters)) == list(letters.values())
    numbers = {"5-3": "-3", "1,000 and (3,4)": "4", "no": "", "v1.50": "1.50", "1,234,567.25!": "1234567.25"}
    assert outputs(spark, answers.extract_number, list(numbers)) == list(numbers.values())
    assert outputs(spark, lambda c: answers.extract_regex(c, "a=( *[0-9]+)"), ["x a= 5", "no"]) == ["5", ""]
    assert outputs(spark, answers.get_extractor(lambda t: t[::-1]), ["abc", None]) == ["cba", ""]
    for bad in ({"kind": "regex"}, {"kind": "other"}):
        with pytest.raises(ValueError):
            answers.get_extractor(**bad)


def test_symbolic_hook(spark):
    rows = spark.createDataFrame([("1/2", "0.5"), ("x", "y"), ("2", "3"), ("", "")], "a string, b string")
    answers.set_symbolic_backend(lambda a, b: {a, b} == {"1/2", "0.5"})
    try:
        assert [r[0] for r in rows.select(answers.equivalent(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
    finally:
        answers.set_symbolic_backend(None)
    assert [r[0] for r in rows.select(answers.equivalent(F.col("a"), F.col("b"))).collect()] == [False] * 4
    with pytest.warns(RuntimeWarning):
        answers.warn_if_no_symbolic_backend()


def test_sigmoid(spark):
    given_ = [0.0, 1.0, -1.0, 800.0, -800.0, math.inf, -math.inf, math.nan, None]
    got = outputs(spark, scalars.sigmoid, given_, "double")
    assert got[0] == 0.5 and abs(got[1] - 1 / (1 + math.exp(-1))) < 1e-15 and abs(got[1] + got[2] - 1) < 1e-15
    assert got[3:] == [1 - 1e-12, 1e-12, 1 - 1e-12, 1e-12, 0.5, 0.5]
    assert outputs(spark, scalars.adapt_logits, [math.nan, math.inf, 0.0], "double") == [0.0, 0.0, 0.5]
    assert outputs(spark, scalars.adapt_probability, [math.nan, 0.25, None], "double") == [0.0, 0.25, 0.0]
    with pytest.raises(Exception, match="outside"):
        outputs(spark, scalars.adapt_probability, [1.5], "double")


def test_mcnemar(spark):
    rows = spark.createDataFrame([(0, 0), (32, 3), (5, 5), (900, 880)], "a long, b long")
    p = [r[0] for r in rows.select(scalars.mcnemar_exact(F.col("a"), F.col("b"))).collect()]
    assert p[0] == 1 and p[2] == 1 and abs(p[1] - 4.176981747150421e-07) < 1e-15
    exact = min(1, 2 * sum(math.comb(1780, k) for k in range(881)) / 2**1780)
    assert abs(p[3] - exact) < 1e-9


def test_small_arrays(spark):
    rows = spark.createDataFrame([([-1.0, -2.0, -9.0], [1, 2, 0]), ([-math.inf], [1]), ([], [])], "p array<double>, t array<int>")
    got = rows.select(scalars.mean_logprob(F.col("p"), F.col("t"), 0).alias("m"), scalars.live_tokens(F.col("t"), 0).alias("n")).collect()
    assert [tuple(r) for r in got] == [(-1.5, 2), (None, 1), (0.0, 0)]
    assert scalars.chunk_size(16, False, 1000, 10, 0) == 16 and scalars.chunk_size(16, True, None, 10, 0) == 4
    assert scalars.chunk_size(64, True, 150_000, 8192, 0) == 1 and scalars.chunk_size(4, True, 9, 9, 0, override=7) == 7
