"""Generate, score, extract and select, as one lazy plan over a table of problems."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwise.functions import answers, scalars
from poolwise.operators import accounting, scoring
from poolwise.operators.vote import METHODS, select_answers, with_keys
from poolwise.sources.tables import SUFFIX, build_prompt

#: A backend takes (prompts, n) and gives, for each prompt, n dicts of text, logprob, finish_reason, n_tokens.
Backend = Callable[[list[str], int], list[list[dict]]]


def check_sampling(n: int, temperature: float) -> None:
    if n < 1:
        raise ValueError(f"n must be at least 1, not {n}")
    if n > 1 and temperature <= 0:
        raise ValueError("n > 1 needs a temperature above 0: all samples would be the same")


def resolve_backend(name: str) -> str:
    """``auto`` is vllm where it can be imported, else transformers."""
    if name not in ("auto", "vllm", "transformers"):
        raise ValueError(f"no backend {name!r}")
    return name if name != "auto" else "vllm" if importlib.util.find_spec("vllm") else "transformers"


def fake_backend(prompts: list[str], n: int) -> list[list[dict]]:
    """A deterministic stand-in: its answers follow from the prompt, and some of its samples never finish."""
    import hashlib

    out = []
    for prompt in prompts:
        pool = []
        for k in range(n):
            h = hashlib.md5(f"{prompt}:{k}".encode()).digest()
            cut, value = h[0] % 5 == 0, h[1] % 3 + len(prompt) % 7
            text = "still thinking about 1" if cut else f"so it is \\boxed{{{value}}}"
            pool.append({"text": text, "logprob": -(1 + h[2] % 8) / 8, "finish_reason": "length" if cut else "stop", "n_tokens": 40 + len(text)})
        out.append(pool)
    return out


class PoolEngine:
    """Samples ``n`` trajectories of every problem and chooses an answer.

    ``make_backend`` is called once per Python worker and gives a Backend, so a model is loaded where it runs
    and only if it runs.  Plans stay lazy; preconditions are checked when they are built.
    """

    def __init__(
        self, make_backend: Callable[[], Backend], n: int = 8, temperature: float = 0.7, method: str = "majority", extractor="boxed",
        extractor_options: dict | None = None, verifier=None, logprobs: bool = False, prompt_suffix: str = SUFFIX, batch: int = 16,
    ) -> None:
        check_sampling(n, temperature)
        self.make_backend, self.n, self.temperature, self.method = make_backend, n, temperature, method
        self.extract = answers.get_extractor(extractor, **(extractor_options or {}))
        self.verifier, self.logprobs, self.prompt_suffix, self.batch = verifier, logprobs, prompt_suffix, batch

    def generate(self, problems: DataFrame, n: int | None = None) -> DataFrame:
        """(problem_id, sample_idx, question, text, logprob, finish_reason, n_tokens) for problems (problem_id, question)."""
        n, make, batch, keep = self.n if n is None else n, self.make_backend, self.batch, self.logprobs
        check_sampling(n, self.temperature)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            backend = make()
            for part in parts:
                for at in range(0, len(part), batch):
                    some = part.iloc[at : at + batch]
                    pools = backend(some["prompt"].tolist(), n)
                    yield pd.DataFrame(
                        [
                            (p, k, q, s["text"], s.get("logprob") if keep else None, s.get("finish_reason"), s.get("n_tokens"))
                            for p, q, pool in zip(some["problem_id"], some["question"], pools, strict=True)
                            for k, s in enumerate(pool)
                        ],
                        columns=["problem_id", "sample_idx", "question", "text", "logprob", "finish_reason", "n_tokens"],
                    ).astype({"logprob": "float64", "n_tokens": "Int32"})

        rows = problems.select(F.col("problem_id").cast("long"), "question", build_prompt(F.col("question"), self.prompt_suffix).alias("prompt"))
        return rows.mapInPandas(run, "problem_id long, sample_idx int, question string, text string, logprob double, finish_reason string, n_tokens int")

    def trajectories(self, problems: DataFrame, n: int | None = None) -> DataFrame:
        """Generated rows with their answer, its key, and a score."""
        rows = scoring.score_all(self.generate(problems, n), self.verifier)
        return with_keys(rows.withColumn("answer", self.extract(F.col("text"))))

    def solve(self, problems: DataFrame, n: int | None = None, method: str | None = None, seed: int = 0) -> DataFrame:
        """One row per problem: the answer and the accounting of its pool; with a ``gold`` column also ``correct`` and ``covered``."""
        method = method or self.method
        if method not in METHODS:
            raise ValueError(f"no method {method!r}; one of {', '.join(METHODS)}")
        if method in ("verifier", "verifier_argmax") and self.verifier is None:
            raise ValueError(f"{method} needs a verifier")
        if method == "self_certainty" and not self.logprobs:
            raise ValueError("self_certainty needs logprobs=True")
        has_gold = "gold" in problems.columns
        if method == "oracle" and not has_gold:
            raise ValueError("oracle needs a gold column")
        rows = self.trajectories(problems, n)
        if has_gold:
            rows = rows.join(problems.select(F.col("problem_id").cast("long"), "gold"), "problem_id", "left")
        chosen = select_answers(rows, method, "gold" if has_gold else None, seed, validate=False).select("problem_id", "answer")
        out = chosen.join(accounting.pool_accounting(rows), "problem_id").join(accounting.agreement(rows), "problem_id").withColumn("method", F.lit(method))
        if has_gold:
            right = accounting.is_correct(rows, "gold", method, seed=seed, validate=False).select("problem_id", "correct")
            out = out.join(right, "problem_id").join(accounting.coverage(rows, "gold"), "problem_id")
        return out


chunk_size = scalars.chunk_size
