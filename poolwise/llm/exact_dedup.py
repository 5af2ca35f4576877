"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions run here.  A first scan keeps one narrow row for each document: the length of its
normalised text and a hash of its first characters.  Lengths that occur once drop out; of the rest, so do
prefixes that occur once for their length.  Only documents of surviving (length, prefix) pairs have their
full text hashed.  A group's size and keeper come from partial aggregates, so a group that holds a third of
all rows costs one row per task; rows find their group by a join whose inputs are both plain exchanges, and
whose result nothing else groups, so adaptive execution splits it where a key is hot.

Defined cases: a null text counts as empty, all empty texts are one group; a null id is the last choice as
keeper; of rows that repeat the keeper's id, text and length, one is kept; columns of the input that clash
with a result column are replaced by it in ``exact_dedup`` and stay as they are in ``drop_exact_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwise.llm.staging import small, stage

#: The characters that do not count: space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
PREFIX_CHARS = 64
RESULT = ("keep_id", "group_size", "kept")


def normalised(text: Column) -> Column:
    """The text without blanks; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _signed(docs: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    text = F.col(text_col)
    bare = normalised(text)
    return docs.withColumns(
        {
            "_len": F.length(bare),
            "_pre": F.xxhash64(F.substring(bare, 1, prefix_chars)),
            "_chars": F.length(F.coalesce(text, F.lit(""))),
        }
    )


def _survivors(docs: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    """(length, prefix hash) pairs of more than one document."""
    sig = stage(_signed(docs.select(text_col), text_col, prefix_chars).select("_len", "_pre"), "sig")
    lengths = stage(sig.groupBy("_len").count().where("count > 1").select("_len"), "lengths")
    left = sig.join(small(lengths), "_len", "left_semi")
    return stage(left.groupBy("_len", "_pre").count().where("count > 1").select("_len", "_pre"), "pairs")


def _groups(hashed: DataFrame, id_col: str) -> DataFrame:
    """Size and keeper of each full hash with more than one row."""
    rows = hashed.groupBy("_sha", F.col(id_col).alias("_id")).agg(F.max("_chars").alias("_chars"), F.count("*").alias("_n"))
    best = F.max(F.struct(F.col("_chars"), (-F.col("_id")).alias("_neg"), F.col("_n"), F.col("_id")))
    out = rows.groupBy("_sha").agg(F.sum("_n").alias("group_size"), best.alias("_best"))
    return out.where("group_size > 1").select(
        "_sha", "group_size", F.col("_best._id").alias("keep_id"), F.col("_best._chars").alias("_keep_chars"), F.col("_best._n").alias("_keep_n")
    )


def _decided(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    docs = docs.drop(*(c for c in RESULT if c in docs.columns and c not in (id_col, text_col)))
    pairs = _survivors(docs, text_col, prefix_chars)
    signed = _signed(docs, text_col, prefix_chars)
    single = signed.join(small(pairs), ["_len", "_pre"], "left_anti")
    multi = signed.join(small(pairs), ["_len", "_pre"], "left_semi").withColumn("_sha", F.sha2(normalised(F.col(text_col)), 256))
    groups = stage(_groups(stage(multi.select(id_col, "_chars", "_sha"), "hashed"), id_col), "groups")
    found = multi.join(groups, "_sha", "left")
    mine = F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_chars") == F.col("_keep_chars"))
    alone = F.col("group_size").isNull()
    found = found.withColumn("kept", alone | mine)
    if groups.where("_keep_n > 1").head(1):
        # a keeper that occurs in several equal rows: the least row number, by an aggregate that tasks begin by themselves
        again = F.coalesce(F.col("_keep_n") > 1, F.lit(False)) & F.col("kept")
        several = stage(found.where(again).withColumn("_row", F.monotonically_increasing_id()), "again")
        first = stage(several.groupBy("_sha").agg(F.min("_row").alias("_row")).withColumn("_first", F.lit(True)), "first")
        several = several.join(small(first), ["_sha", "_row"], "left").withColumn("kept", F.coalesce("_first", F.lit(False))).select(found.columns)
        found = found.where(~again).unionByName(several)
    found = found.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")))
    found = found.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long"))).drop("_keep_chars", "_keep_n")
    alone = single.withColumns(
        {"_sha": F.lit(None).cast("string"), "group_size": F.lit(1).cast("long"), "keep_id": F.col(id_col), "kept": F.lit(True)}
    )
    return found.unionByName(alone)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Every input row with ``keep_id``, ``group_size`` and ``kept``; other columns stay."""
    return _decided(docs, id_col, text_col, prefix_chars).drop("_len", "_pre", "_chars", "_sha")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    plain = [c for c in docs.columns if c in RESULT and c not in (id_col, text_col)]
    inner = docs.withColumnsRenamed({c: f"_in_{c}" for c in plain})
    out = exact_dedup(inner, id_col, text_col, prefix_chars).where("kept").drop(*RESULT)
    return out.withColumnsRenamed({f"_in_{c}": c for c in plain}).select(docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = _decided(docs, "doc_id", "text", PREFIX_CHARS)
    sha = F.coalesce(F.col("_sha"), F.sha2(normalised(F.col("text")), 256))
    return found.select("doc_id", "keep_id", "group_size", "kept", sha.alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = doc_id AS kept,
       text_sha256
FROM d
"""
