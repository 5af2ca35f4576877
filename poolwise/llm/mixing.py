"""Mixing sources to target weights by hierarchical budgets.

The tree is domain, language, source; a leaf's supply is its tokens times ``max_epochs``, a node's is the sum
below it.  The budget goes down the tree: a node divides its own among its children in proportion to their
weights, and what a child cannot use goes to its siblings in proportion to theirs, until they are full; since
a node never receives more than its supply, a shortage reaches the siblings of an ancestor only when all
nearer ones are full.  Shares are whole tokens; those left by rounding go one each to unfilled children by
name.  Each level is one window over a table of nodes.

A leaf's budget is so many whole epochs and a token prefix of the next, in the order of
``md5(seed:epoch:id)``.  A histogram over the first three hexadecimal digits tells in which of 4096 buckets
the prefix ends; only documents of that bucket are ordered, so no task sorts a leaf however large it is.

Tokens are runs of characters other than ``[\\x20\\x09-\\x0D]``.  Defined cases: a null text has no tokens
and is never taken; a null language or source is the empty name; a null id orders as empty; equal rows are
taken in any order among themselves; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poolwise.llm.staging import small, stage

LEAF = ("domain", "lang", "source")
#: Target weights of names at each level; a name that is not listed weighs 1.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"d0": 3, "d1": 2}, "lang": {"en": 4, "fr": 2, "de": 2}, "source": {}}
SHARE, MAX_EPOCHS, SEED = 0.8, 4, 11
_WORDS = r"[^\x20\x09-\x0D]+"
RESULT = ("domain", "n_tokens", "epochs", "prefix_tokens", "tokens_taken")


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number at its end, in four groups."""
    return F.concat(F.lit("d"), F.coalesce(F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")).cast("int") % 4, F.lit(0)).cast("string"))


def _named(docs: DataFrame, text_col: str) -> DataFrame:
    source = F.coalesce(F.col("source"), F.lit(""))
    return docs.withColumns(
        {
            "_domain": domain_of(source),
            "_lang": F.coalesce(F.col("lang"), F.lit("")),
            "_source": source,
            "_n": F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(_WORDS)).cast("long"),
        }
    )


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    known = weights.get(level, {})
    out = F.lit(1)
    for name, w in known.items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def divide(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to rows (parent..., name, weight, supply, given), where ``given`` is the parent's budget."""
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = of.orderBy((F.col("supply") / F.col("weight")).asc(), F.col(name))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = children.withColumns({"_used": F.coalesce(F.sum("supply").over(before), F.lit(0)), "_w": F.sum("weight").over(after)})
    # full: its supply is at most its share of what the fuller ones leave
    full = F.col("supply").cast("decimal(38,0)") * F.col("_w") <= F.col("weight").cast("decimal(38,0)") * (F.col("given") - F.col("_used"))
    rows = rows.withColumn("_full", full)
    open_weight = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(of)
    rest = F.col("given") - F.sum(F.when(F.col("_full"), F.col("supply")).otherwise(0)).over(of)
    rows = rows.withColumns({"_rest": rest, "_open": open_weight})
    rows = rows.withColumn("_share", F.when(F.col("_full"), F.col("supply")).otherwise(F.expr("(weight * _rest) div _open")))
    odd = F.col("_rest") - F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_share"))).over(of)
    nth = F.sum(F.when(F.col("_full"), 0).otherwise(1)).over(of.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_odd": odd, "_nth": nth})
    extra = F.when(~F.col("_full") & (F.col("_nth") <= F.col("_odd")), 1).otherwise(0)
    return rows.withColumn("budget", (F.col("_share") + extra).cast("long")).drop("_used", "_w", "_full", "_rest", "_open", "_share", "_odd", "_nth")


def budgets(leaves: DataFrame, share: float, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with ``budget``."""
    leaves = leaves.withColumn("supply", F.col("tokens") * max_epochs)
    domains = leaves.groupBy("domain").agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
    total = F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(share)).cast("long")
    domains = domains.withColumns({"weight": _weight("domain", weights), "given": total})
    domains = divide(domains, [], "domain").select("domain", F.col("budget").alias("given"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("supply").alias("supply")).withColumn("weight", _weight("lang", weights))
    langs = divide(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("budget").alias("given"))
    rows = leaves.withColumn("weight", _weight("source", weights)).join(langs, ["domain", "lang"])
    return divide(rows, ["domain", "lang"], "source").select(*LEAF, "tokens", "budget")


def _hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_epochs").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: dict[str, dict[str, int]] | None = None, seed: int = SEED) -> DataFrame:
    """Every input row with ``domain``, ``n_tokens``, ``epochs`` (whole ones), ``prefix_tokens`` of the next and ``tokens_taken``.

    Needs the columns ``lang`` and ``source``; columns of the input that clash with a result are replaced.
    """
    docs = docs.drop(*(c for c in RESULT if c in docs.columns))
    narrow = stage(_named(docs.select(id_col, text_col, "lang", "source"), text_col).drop(text_col, "lang", "source"), "mix")
    keys = [f"_{c}" for c in LEAF]
    leaves = stage(narrow.groupBy(*(F.col(k).alias(c) for k, c in zip(keys, LEAF, strict=True))).agg(F.sum("_n").alias("tokens")), "leaves")
    plan = budgets(leaves, share, max_epochs, WEIGHTS if weights is None else weights).where("tokens > 0")
    plan = plan.select(*(F.col(c).alias(k) for k, c in zip(keys, LEAF, strict=True)), F.expr("budget div tokens").alias("_epochs"), (F.col("budget") % F.col("tokens")).alias("_left"))
    plan = stage(plan, "plan")
    bucket = F.substring(_hash(id_col, seed), 1, 3)
    sums = narrow.join(small(plan), keys).groupBy(*keys, bucket.alias("_bucket")).agg(F.sum("_n").alias("_n"))
    so_far = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_sum", F.sum("_n").over(so_far)).join(plan, keys)
    ends = sums.where("_sum > _left").groupBy(*keys).agg(F.min(F.struct("_bucket", "_sum", "_n")).alias("_end"))
    ends = ends.select(*keys, F.col("_end._bucket").alias("_last"), (F.col("_end._sum") - F.col("_end._n")).alias("_below"))
    plan = stage(plan.join(ends, keys, "left"), "ends")
    rows = _named(docs, text_col).join(small(plan), keys, "left").withColumn("_hash", _hash(id_col, seed))
    at = F.substring("_hash", 1, 3)
    edge = F.coalesce(at == F.col("_last"), F.lit(False))
    inside = rows.where(~edge).withColumn("prefix_tokens", F.when(at < F.col("_last"), F.col("_n")).otherwise(0).cast("long"))
    order = Window.partitionBy(*keys).orderBy("_hash", id_col, "_n")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_left") - F.col("_below") - before))
    last = rows.where(edge).withColumn("prefix_tokens", taken.cast("long"))
    out = inside.unionByName(last).withColumns({"domain": F.col("_domain"), "n_tokens": F.col("_n"), "epochs": F.coalesce("_epochs", F.lit(0).cast("long"))})
    out = out.withColumn("tokens_taken", F.col("epochs") * F.col("n_tokens") + F.col("prefix_tokens"))
    return out.select(*docs.columns, *RESULT)


def mixed_documents(docs: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, max_epochs: int = 1) -> DataFrame:
    """The rows that are taken, with the columns of ``docs``: one copy for each whole epoch and one for the
    prefix of the next.  The text of a copy that a budget ends in is cut after its last token taken, and
    ``n_chars``, if there, is its new length."""
    hidden = {c: f"_in_{c}" for c in docs.columns if c in RESULT}
    out = mix(docs.withColumnsRenamed(hidden), id_col, text_col, share, max_epochs, None, seed).where("tokens_taken > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs") + F.when(F.col("prefix_tokens") > 0, 1).otherwise(0))))
    taken = F.when(F.col("_copy") <= F.col("epochs"), F.col("n_tokens")).otherwise(F.col("prefix_tokens"))
    parts = F.slice(F.split(F.col(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1), F.lit(1), taken.cast("int"))
    cut = taken < F.col("n_tokens")
    out = out.withColumn(text_col, F.when(cut, F.array_join(parts, "")).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("_copy", *RESULT).withColumnsRenamed({v: k for k, v in hidden.items()}).select(docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs).drop("text")


def _sql_weight(level: str) -> str:
    return f"CASE {level} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())} ELSE 1 END" if WEIGHTS[level] else "1"


def _sql_level(rows: str, parent: str, name: str, keep: str) -> str:
    of = f"PARTITION BY {parent}" if parent else ""
    return f"""
  SELECT {keep}, share + CASE WHEN NOT is_full AND nth <= rest - sum(CASE WHEN is_full THEN 0 ELSE share END) OVER ({of}) THEN 1 ELSE 0 END AS budget
  FROM (SELECT *, CASE WHEN is_full THEN supply ELSE (weight * rest) // open_weight END AS share FROM (
    SELECT *, given - sum(CASE WHEN is_full THEN supply ELSE 0 END) OVER ({of}) AS rest,
      sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({of}) AS open_weight,
      sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER ({of} ORDER BY {name} ROWS UNBOUNDED PRECEDING) AS nth
    FROM (SELECT *, supply * (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        <= weight * (given - coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
      FROM ({rows}) WINDOW w AS ({of} ORDER BY supply / weight, {name}))))"""


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'd' || coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INT) % 4, 0) AS domain,
    len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS n
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n) AS tokens, sum(n) * {MAX_EPOCHS} AS supply FROM d GROUP BY ALL),
l1 AS ({_sql_level(f"SELECT domain, sum(supply) AS supply, {_sql_weight('domain')} AS weight, (SELECT floor(sum(tokens) * CAST({SHARE} AS DOUBLE))::BIGINT FROM leaves) AS given FROM leaves GROUP BY domain", '', 'domain', 'domain')}),
l2 AS ({_sql_level(f"SELECT x.domain, x.lang, x.supply, {_sql_weight('lang')} AS weight, l1.budget AS given FROM (SELECT domain, lang, sum(supply) AS supply FROM leaves GROUP BY ALL) x JOIN l1 USING (domain)", 'domain', 'lang', 'domain, lang')}),
l3 AS ({_sql_level(f"SELECT x.*, {_sql_weight('source')} AS weight, l2.budget AS given FROM leaves x JOIN l2 USING (domain, lang)", 'domain, lang', 'source', 'domain, lang, source, tokens')}),
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS left_over FROM l3),
o AS (SELECT d.*, e.epochs, left_over - coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || e.epochs || ':' || doc_id), doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM d JOIN e USING (domain, lang, source))
SELECT doc_id, lang, source, domain, CAST(n AS BIGINT) AS n_tokens, CAST(epochs AS BIGINT) AS epochs,
  CAST(greatest(0, least(n, room)) AS BIGINT) AS prefix_tokens, CAST(epochs * n + greatest(0, least(n, room)) AS BIGINT) AS tokens_taken
FROM o
"""
