"""Toxicity by weak supervision.

1. Voters: each word of ``LEXICON``, up to ``STEMS`` stems, one group of whole words (stems and words induced
   from at most ``LEXICON_ROWS`` labelled rows, by how much oftener they occur in toxic ones; texts that share
   their least shingle, as copies do, count once), and ``PATTERNS`` (several different hits, hits in a short text
   or close together, an address by second person beside a hit, shouting, runs of exclamation marks).
   One pass over the texts counts their hits.  The counts are staged, and grouped by equal ones; later steps
   never read a text again.
2. A generative label model sees only which voters fired, aggregated over all documents: two latent classes,
   and in each a tree of voters, where a voter's firing rate depends on whether its parent fired.  So it has
   the voters' accuracies and their correlations.  Expectation maximisation runs as sums over the table of vote
   patterns.  The rates have priors, which say that insults are rare in clean texts, and of induced voters how
   often they fire in labelled rows; they are worth as much as the documents are, at every size.  The tree is
   that of the largest mutual information within the classes, after rounds without one, without edges that are
   chance.
3. A logistic model on damped counts is trained on the posterior labels of all documents, by Newton steps whose
   sums run over the table of equal counts.
4. Its output is calibrated (slope and intercept) on at most ``FIT_ROWS`` labelled rows.

Labels are read only where ``crc32(id) % 5`` is not 0, and nothing but the text enters a score.
The samples are the rows of least hash, alike at every size, and all sums are over the whole cluster, so scores
do not depend on partitioning (but for the rounding of sums).  Defined cases: a null text is empty and is
scored like any text without hits; a null id counts as held out; without labelled rows the scores stay
uncalibrated; without any hit in the corpus every score is low; repeated rows get equal scores.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwise.llm import shingles
from poolwise.llm.staging import ship, stage

#: Insults in four languages, one voter each.
LEXICON = (
    "idiot", "moron", "stupid", "trash", "scum", "loser", "clown", "pathetic", "worthless", "disgusting",
    "dumb", "fool", "jerk", "imbecile", "garbage", "filth", "vermin", "bastard", "hate", "kill",
    "crétin", "connard", "débile", "ordure", "abruti",
    "dummkopf", "trottel", "abschaum", "arschloch", "vollidiot",
    "estúpido", "imbécil", "basura", "escoria", "idiota",
)
PATTERNS = ("several", "repeated", "close", "addressed", "shouting", "exclaiming")
STEMS = 12
VOTERS = (*LEXICON, *(f"stem {k}" for k in range(STEMS)), "induced", *PATTERNS)
FIT_ROWS, LEXICON_ROWS = 20_000, 6_000
#: Rounds of expectation maximisation, before and after the tree; Newton steps of the classifier.
ROUNDS, STEPS = (6, 8), 12
#: Prior rate of insults, in clean and in toxic texts, and of other voters; what it is worth against the documents of the class.
WORD_RATE, PATTERN_RATE, WORTH = (0.0005, 0.1), (0.01, 0.1), 1.0
#: Twice the log-likelihood that an edge of the tree must gain.
EDGE = 30.0
#: Penalty of the classifier's squared weights, for each document.
RIDGE = 0.005
#: Tasks that read the table of equal counts; each sends one row of sums to the driver.
TASKS = 32
#: So many times oftener in toxic texts must a stem and an induced word be, and in so many toxic texts.
STEM_RATIO, WORD_RATIO, LEAST_TEXTS = 8, 40, 4
_SECOND = re.compile(r"\b(?:you|your|tu|vous|du|ihr|sie|usted|eres)\b")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_WORD = re.compile(r"\w+")
_L, _N = len(LEXICON), len(LEXICON) + STEMS + 1


@functools.lru_cache(4)
def _automaton(stems: tuple[str, ...], words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds (place, length, is a stem) of the terms."""
    named: dict[str, list[tuple[int, int, bool]]] = {}
    for k, term in enumerate(LEXICON):
        named.setdefault(term, []).append((k, len(term), False))
    for k, term in enumerate(stems):
        named.setdefault(term, []).append((_L + k, len(term), True))
    for term in words:
        named.setdefault(term, []).append((_N - 1, len(term), False))
    out = ahocorasick.Automaton()
    for term, found in named.items():
        out.add_word(term, tuple(found))
    out.make_automaton()
    return out


def counts(text: str, stems: tuple[str, ...] = (), words: tuple[str, ...] = ()) -> np.ndarray:
    """Strength of each voter on a text; 0 where it does not fire."""
    out = np.zeros(len(VOTERS), np.float32)
    low = text.lower()
    at = []
    for end, found in _automaton(stems, words).iter(low):
        for place, size, stem in found:
            start = end - size + 1
            before, after = low[start - 1] if start else " ", low[end + 1] if end + 1 < len(low) else " "
            if before.isalnum() or before == "_" or (not stem and (after.isalnum() or after == "_")):
                continue
            out[place] += 1
            if not at or at[-1][0] != start:
                at.append((start, end))
    distinct = np.count_nonzero(out[:_L]) + np.count_nonzero(out[_L : _N - 1])
    out[_N] = distinct if distinct > 1 else 0
    out[_N + 1] = 100 * len(at) / (1 + len(low) / 6) if len(at) * 1200 > len(low) else 0
    out[_N + 2] = sum(b[0] - a[1] < 200 for a, b in zip(at, at[1:], strict=False))
    out[_N + 3] = sum(bool(_SECOND.search(low[max(0, s - 40) : e + 40])) for s, e in at)
    loud, marks = len(_UPPER.findall(text)), text.count("!")
    out[_N + 4] = loud / 100 if loud > 20 and loud * 2.5 > len(text) else 0
    out[_N + 5] = marks / 10 if marks > 3 and marks * 40 > len(text) else 0
    return np.ceil(out * 8) / 8  # in steps, so that many texts have equal ones


def _counted(stems: tuple[str, ...], words: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t.as_py() or "", stems, words) for t in batch.column(1)]
            masks = [int(sum(1 << k for k in np.flatnonzero(r).tolist())) for r in rows]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
            offsets = pa.array(np.arange(0, len(flat) + 1, len(VOTERS), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masks, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["id", "mask", "counts"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the least of their shingles, which copies and most near copies share."""
    for batch in batches:
        found = [shingles.shingles([shingles.word_hashes(t or "")])[1] for t in batch.column(1).to_pylist()]
        keys = [int(f.min().astype(np.int64)) if len(f) else 0 for f in found]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["id", "text", "toxic", "key"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, on, off) by texts: whole words and, with a star, their beginnings of 4 to 8 letters."""
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {w for w in _WORD.findall((text or "").lower()) if len(w) > 3}
            for term in words | {w[:k] + "*" for w in words for k in range(4, min(9, len(w)))}:
                seen.setdefault(term, [0, 0])[not toxic] += 1
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], ["term", "on", "off"])


def induce(docs: DataFrame, known: DataFrame, rows: int = LEXICON_ROWS) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Stems and whole words that tell toxic texts, from at most ``rows`` labelled texts: (id, toxic) in ``known``."""
    some = stage(known.orderBy(F.xxhash64("id"), "id").limit(rows), "labelled")
    texts = docs.join(F.broadcast(some), "id").select("id", "text", (F.col("toxic") > 0.5).alias("toxic"))
    texts = texts.mapInArrow(_keyed, "id long, text string, toxic boolean, key long").groupBy("toxic", "key").agg(F.min(F.struct("id", "text")).alias("one"))
    texts = stage(texts.select("one.text", "toxic"), "unlike")
    total = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    table = texts.mapInArrow(_terms, "term string, on long, off long").groupBy("term").agg(F.sum("on").alias("on"), F.sum("off").alias("off"))
    ratio = (F.col("on") / float(total.get(True, 0) + 1)) / ((F.col("off") + 0.5) / float(total.get(False, 0) + 1))
    table = table.withColumn("ratio", ratio).where((F.col("on") >= LEAST_TEXTS) & (F.col("ratio") >= STEM_RATIO))
    found = table.orderBy(F.desc(F.col("on") - F.col("off") / STEM_RATIO), "term").collect()
    words = sorted(r["term"] for r in found if r["ratio"] >= WORD_RATIO and not r["term"].endswith("*") and r["term"] not in LEXICON)
    stems: list[str] = []
    for r in found:
        stem = r["term"].removesuffix("*")
        known_ = any(stem.startswith(s) or s.startswith(stem) for s in (*stems, *LEXICON))
        if r["term"].endswith("*") and not known_ and len(stems) < STEMS:
            stems.append(stem)
    return tuple(stems), tuple(words)


class LabelModel:
    """Prior of both classes, a tree of voters, and the voters' firing rates by class and by whether the parent fired.

    ``rate[c, u, i]`` is voter i's in class c if its parent fired (u = 1) or not; voters without parent have one
    rate, as both.
    """

    def __init__(self, labelled: np.ndarray | None = None) -> None:
        """``labelled`` has the rates of all voters in clean and toxic labelled rows; those of induced ones are used."""
        n = len(VOTERS)
        self.prior, self.parent = 0.05, np.full(n, -1)
        self.believed = np.stack([np.where(np.arange(n) < _L, WORD_RATE[c], PATTERN_RATE[c]) for c in (0, 1)])
        if labelled is not None:
            self.believed[:, _L:_N] = labelled[:, _L:_N]
        self.rate = np.repeat(self.believed[:, None], 2, 1)

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        above = np.where(self.parent >= 0, fired[:, self.parent], 0)
        odds = np.full(len(fired), np.log(self.prior / (1 - self.prior)))
        for u in (0, 1):
            on, off = np.log(self.rate[1, u] / self.rate[0, u]), np.log((1 - self.rate[1, u]) / (1 - self.rate[0, u]))
            odds += ((above == u) * (fired * on + (1 - fired) * off)).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def update(self, size: np.ndarray, sums: np.ndarray, joint: np.ndarray) -> None:
        """From each class's expected number of documents, of firing voters, and of pairs that fire together."""
        self.prior = float(np.clip((size[1] + 1) / (size.sum() + 20), 1e-4, 0.5))
        n = len(VOTERS)
        for c in (0, 1):
            worth = WORTH * size[c] + 1
            alone = (sums[c] + self.believed[c] * worth) / (size[c] + worth)
            both = joint[c, np.arange(n), self.parent]
            times = sums[c, self.parent]
            # given the parent, the rate without it is the prior, worth one document
            given = np.stack([(sums[c] - both + alone) / (size[c] - times + 1), (both + alone) / (times + 1)])
            self.rate[c] = np.clip(np.where(self.parent >= 0, given, alone), 1e-6, 0.999)

    def grow(self, size: np.ndarray, sums: np.ndarray, joint: np.ndarray) -> None:
        """The tree of the largest mutual information within the classes, of edges that gain ``EDGE``."""
        gain = sum(_information(size[c], sums[c], joint[c]) for c in (0, 1))
        np.fill_diagonal(gain, -1)
        self.parent[:] = -1
        inside = [0]
        best, of = gain[0].copy(), np.zeros(len(VOTERS), np.int64)
        while len(inside) < len(VOTERS):
            best[inside] = -2
            k = int(np.argmax(best))
            if best[k] >= EDGE:
                self.parent[k] = of[k]
            inside.append(k)
            better = gain[k] > best
            better[inside] = False
            best[better], of[better] = gain[k][better], k


def _information(size: float, sums: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """Twice the log-likelihood that each pair of voters gains by its dependence."""
    size = max(float(size), 1e-9)
    out = np.zeros_like(joint)
    for a, b, both in ((1, 1, joint), (1, 0, sums[:, None] - joint), (0, 1, sums[None] - joint), (0, 0, size - sums[:, None] - sums[None] + joint)):
        apart = (sums if a else size - sums)[:, None] * (sums if b else size - sums)[None] / size
        out += 2 * np.where(both > 1e-9, both * np.log(np.maximum(both, 1e-9) / np.maximum(apart, 1e-9)), 0)
    return out


def _fired(masks: np.ndarray) -> np.ndarray:
    return ((masks[:, None] >> np.arange(len(VOTERS))) & 1).astype(np.float64)


def _summed(rows: DataFrame, sums, size: int) -> np.ndarray:
    """The sum over the table of what ``sums`` gives for a batch, as ``size`` numbers; each task sends its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += sums(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    found = rows.coalesce(TASKS).mapInArrow(run, "sums array<double>").collect()
    return np.sum([np.array(r["sums"]) for r in found], axis=0) if found else np.zeros(size)


def fit_label_model(patterns: DataFrame, labelled: np.ndarray | None = None) -> LabelModel:
    """From (mask, times) over all documents."""
    model, n = LabelModel(labelled), len(VOTERS)

    def expected(batch: pa.RecordBatch) -> np.ndarray:
        fired, times = _fired(batch.column(0).to_numpy()), batch.column(1).to_numpy().astype(float)
        post = model.posterior(fired)
        both = np.stack([(1 - post) * times, post * times])
        return np.concatenate([both.sum(1), (both @ fired).ravel(), *(((fired.T * b) @ fired).ravel() for b in both)])

    for step in range(sum(ROUNDS)):
        got = _summed(patterns, expected, 2 + 2 * n + 2 * n * n)
        parts = got[:2], got[2 : 2 + 2 * n].reshape(2, n), got[2 + 2 * n :].reshape(2, n, n)
        if step == ROUNDS[0]:
            model.grow(*parts)
        model.update(*parts)
    return model


def fit_classifier(vectors: DataFrame, model: LabelModel, ridge: float = RIDGE) -> np.ndarray:
    """Weights and, last, intercept of a ridge logistic model of the posterior labels on (mask, counts, times)."""
    n = len(VOTERS)
    w = np.zeros(n + 1)

    def curve(batch: pa.RecordBatch) -> np.ndarray:
        x = np.asarray(batch.column(1).flatten()).reshape(len(batch), n).astype(float)
        x = np.column_stack([np.log1p(x), np.ones(len(x))])
        times, p = batch.column(2).to_numpy().astype(float), 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        wrong = times * (model.posterior(_fired(batch.column(0).to_numpy())) - p)
        return np.concatenate([[times.sum()], x.T @ wrong, ((x.T * (times * np.maximum(p * (1 - p), 1e-6))) @ x).ravel()])

    for _ in range(STEPS):
        documents, *got = np.split(_summed(vectors, curve, 1 + (n + 1) * (n + 2)), [1, n + 2])
        penalty = np.r_[np.full(n, ridge * max(documents[0], 1.0)), 1e-3]
        step = np.linalg.solve(got[1].reshape(n + 1, n + 1) + np.diag(penalty), got[0] - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, intercept of a ridge logistic model for labels in [0, 1], by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Scorer:
    """What training leaves: terms, linear weights with their intercept, and the calibration."""

    stems: tuple[str, ...]
    words: tuple[str, ...]
    linear: np.ndarray
    slope: float
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (np.log1p(x) @ self.linear[:-1] + self.linear[-1]) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[Scorer, DataFrame]:
    """The trained scorer, and the staged votes (id, mask, counts) of all rows."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known, terms = None, ((), ())
    if labels is not None:
        known = labels.where("toxic is not null").where(~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("double").alias("toxic"))
        terms = induce(source, known)
    table = stage(source.mapInArrow(_counted(*terms), "id long, mask long, counts array<float>"), "votes")
    vectors = stage(table.groupBy("mask", "counts").agg(F.count("*").alias("times")), "vectors")
    rates, slope, shift = None, 1.0, 0.0
    if known is not None:
        some = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
        got = table.join(F.broadcast(some), "id").select("id", "mask", "counts", "toxic").orderBy("id", "mask").toArrow()
        x, y = np.array(got["counts"].to_pylist(), float).reshape(-1, len(VOTERS)), got["toxic"].to_numpy()
        fired = _fired(got["mask"].to_numpy().astype(np.int64))
        rates = np.stack([((y == c) @ fired + r) / (np.sum(y == c) + 1) for c, r in enumerate(PATTERN_RATE)])
    model = fit_label_model(stage(vectors.groupBy("mask").agg(F.sum("times").alias("times")), "patterns"), rates)
    linear = fit_classifier(vectors, model)
    if known is not None and len(set(y.tolist())) == 2:
        slope, shift = logistic((np.log1p(x) @ linear[:-1] + linear[-1])[:, None], y, ridge=1e-3).tolist()
    return Scorer(*terms, linear, slope, shift), table


def _scored(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).reshape(len(batch), len(VOTERS)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(x))], ["id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: id, ``held_out``, ``score`` and ``predicted``."""
    scorer, table = fit(docs, labels, id_col, text_col, fit_rows)
    out = table.select("id", "mask", "counts").mapInArrow(_scored(scorer), "id long, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows that are not predicted toxic, with the columns of ``docs``; rows are scored where they lie."""
    scorer, _ = fit(docs, labels, id_col, text_col, fit_rows)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = [counts(t or "", scorer.stems, scorer.words) for t in texts]
        return pd.Series(scorer.score(np.array(rows, float).reshape(-1, len(VOTERS))))

    return docs.where(score(F.coalesce(F.col(text_col), F.lit(""))) < 0.5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
