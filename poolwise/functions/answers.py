"""Extraction and normalisation of answers as columns.

Extraction is native for common answers; a pandas UDF is fed only what no native rule takes (null elsewhere),
so its rows cost next to nothing.  Keys of answers are one pandas UDF, which reads each distinct answer of a
batch once: as an expression the rules copy one another hundreds of times into the plan.  ``\\d``, ``\\s`` and
word boundaries are Unicode-aware.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from poolwise.functions import latex

_UNIT = r"\\(?:text|mathrm|mathbf|mathit|operatorname|bm)\s*\{\s*(?=[^{}]*[A-Za-z])[A-Za-z0-9 .,\-/^*()]+\}"


def _slow(fn: Callable[[str], str | None], text: Column) -> Column:
    """``fn`` of each text, read once for equal texts of a batch; null stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        place, distinct = pd.factorize(values)
        return pd.Series([*map(fn, distinct), None], dtype=object).take(place).reset_index(drop=True)

    return run(text)


def extract_number(text: Column) -> Column:
    """The last number of the text, without grouping commas; empty if there is none."""
    found = F.regexp_extract_all(text, F.lit("(?U)" + latex.NUMBER), 0)
    return F.coalesce(F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("")), F.lit(""))


def extract_boxed(text: Column, allow_fallback: bool = False) -> Column:
    """The canonical content of the last box; empty (or the last number, if allowed) where there is none."""
    text = F.coalesce(text, F.lit(""))
    has = F.contains(text, F.lit(latex.BOX))
    number = r"^(-?[0-9]+(?:\.[0-9]+)?)(?:" + _UNIT + r")?\}"
    ratio = r"^\\[dt]?frac\{(-?[0-9]+)\}\{(-?[0-9]+)\}\}"

    tail = F.substring_index(text, latex.BOX, -1)
    shown = F.regexp_replace(F.regexp_extract(tail, ratio, 0), ratio, "$1/$2")
    # a number, with or without a unit, or a fraction of whole numbers
    fast = F.when(has, F.nullif(F.concat(F.regexp_extract(tail, number, 1), shown), F.lit("")))
    rest = _slow(latex.boxed, F.when(has & fast.isNull(), text))
    out = F.coalesce(fast, rest, F.lit(""))
    return F.when(out == "", extract_number(text)).otherwise(out) if allow_fallback else out


def extract_letter(text: Column, options: str = "ABCD") -> Column:
    """An option letter: the first in the 60 characters after the last box opener, else the last that stands alone."""
    text = F.coalesce(text, F.lit(""))
    window = F.substring(F.substring_index(text, latex.BOX, -1), 1, 60)
    inside = F.upper(F.regexp_extract(window, f"([{options}{options.lower()}])", 1))
    alone = F.regexp_extract_all(text, F.lit(rf"(?U)\b([{options}])\b"), 1)
    alone = F.coalesce(F.try_element_at(alone, F.lit(-1)), F.lit(""))
    return F.when(F.contains(text, F.lit(latex.BOX)) & (inside != ""), inside).otherwise(alone)


def extract_regex(text: Column, pattern: str) -> Column:
    """The first match, its first group if the pattern has any; an unmatched group reads as empty."""
    import re

    group = min(1, re.compile(pattern).groups)
    return strip(F.regexp_extract(F.coalesce(text, F.lit("")), "(?U)" + pattern, group))


def get_extractor(kind: str | Callable[[str], str], **options) -> Callable[[Column], Column]:
    """An extractor by name (boxed, number, letter, regex), or any function of a text."""
    if callable(kind):
        return lambda text: F.coalesce(_slow(kind, F.coalesce(text, F.lit(""))), F.lit(""))
    name = str(kind).lower()
    if name == "regex" and not options.get("pattern"):
        raise ValueError("the regex extractor needs pattern=")
    known = {
        "boxed": lambda text: extract_boxed(text, bool(options.get("allow_fallback", False))),
        "number": lambda text: extract_number(F.coalesce(text, F.lit(""))),
        "letter": lambda text: extract_letter(text, options.get("options", "ABCD")),
        "regex": lambda text: extract_regex(text, options["pattern"]),
    }
    if name not in known:
        raise ValueError(f"no extractor {kind!r}: boxed, number, letter, regex or a function")
    return known[name]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_unit(content: Column) -> Column:
    bare = strip(F.coalesce(content, F.lit("")))
    return bare.rlike("[A-Za-z]") & bare.rlike("(?U)" + latex.UNIT_CHARS)


def strip_thousands(text: Column) -> Column:
    packed = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(packed.rlike("(?U)" + latex.THOUSANDS), F.regexp_replace(packed, r"[{},]", "")).otherwise(text)


def is_atomic(inner: Column) -> Column:
    """One balanced term without an operator outside of brackets."""
    step = lambda c: F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def walk(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + step(c)
        bad = (depth < 0) | ((depth == 0) & c.isin(*sorted(latex.OPERATORS)))
        return F.struct(depth.alias("depth"), (acc["ok"] & ~bad).alias("ok"))

    chars = F.filter(F.split(inner, ""), lambda c: c != "")
    return (F.length(inner) > 0) & F.aggregate(chars, start, walk, lambda a: a["ok"] & (a["depth"] == 0))


def latex_to_text(text: Column) -> Column:
    return _slow(latex.latex_to_text, text)


def tidy_parens(text: Column) -> Column:
    return _slow(latex.tidy_parens, text)


def numeric_key(text: Column) -> Column:
    """Canonical text of a number; empty if it is not finite, null if the text is no number."""
    return _slow(latex.numeric_key, text)


def normalise(answer: Column) -> Column:
    """The key under which answers count as one; empty means no vote."""
    return _slow(latex.normalise, F.coalesce(answer, F.lit("")))


_SYMBOLIC: list[Callable[[str, str], bool]] = []


def set_symbolic_backend(verify: Callable[[str, str], bool] | None) -> None:
    """Install (or, with None, remove) a function that decides whether two answers mean the same."""
    _SYMBOLIC[:] = [verify] if verify else []


def have_symbolic_backend() -> bool:
    return bool(_SYMBOLIC)


def symbolic_backend() -> Callable[[str, str], bool] | None:
    return _SYMBOLIC[0] if _SYMBOLIC else None


def warn_if_no_symbolic_backend() -> None:
    if not _SYMBOLIC:
        import warnings

        warnings.warn("no symbolic backend: answers that are written differently count apart", RuntimeWarning, stacklevel=2)


def equivalent(a: Column, b: Column) -> Column:
    """Equal non-empty keys; with a backend, also what it says of two that are not both numbers."""
    ka, kb = normalise(a), normalise(b)
    same = (ka == kb) & (ka != "")
    verify = symbolic_backend()
    if verify is None:
        return same

    @F.pandas_udf("boolean")
    def ask(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: str | None, q: str | None) -> bool:
            if p is None or q is None:
                return False
            try:
                return bool(verify(p, q))
            except Exception:  # a malformed answer equals nothing
                return False

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    both = numeric_key(ka).isNotNull() & numeric_key(kb).isNotNull()
    open_ = ~same & (ka != "") & (kb != "") & ~both
    return same | ask(F.when(open_, a), F.when(open_, b))
