"""Queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from poolwise.llm import exact_dedup, media, mixing, near_dedup, packing, pii, pseudo_lm, revisits, site_tree, toxicity
from poolwise.llm.staging import ship


def _shipped(query: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: _shipped(query)
        for name, query in {
            "op1_site_style_tree": site_tree.op1_site_style_tree,
            "op2_progressive_jpeg": media.op2_progressive_jpeg,
            "op3_mixing": mixing.op3_mixing,
            "op4_revisits": revisits.op4_revisits,
            "op5_bagminhash": near_dedup.op5_bagminhash,
            "op6_hilbert_pack": packing.op6_hilbert_pack,
            "op7_toxicity": toxicity.op7_toxicity,
            "op8_exact_dedup": exact_dedup.op8_exact_dedup,
            "op9_pii": pii.op9_pii,
            "op10_pseudo_likelihood": pseudo_lm.op10_pseudo_likelihood,
        }.items()
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE, "op4_revisits": revisits.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE, "op9_pii": pii.ORACLE}
