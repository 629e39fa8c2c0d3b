"""Explanation casebook: top supporting / opposing token features per case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def token_rows(contrib: DataFrame, k: int = config.TOP_K_PER_SIDE,
               prefixes: Sequence[str] = tuple(config.TOKEN_PREFIXES)) -> DataFrame:
    """Token features only (name starts with a token prefix), first ``k`` by rank
    within (run, case, side)."""
    pref = None
    for p in prefixes:
        c = F.col("feature_name").cast("string").startswith(p)
        pref = c if pref is None else pref | c
    t = contrib.where(pref).withColumn("rank", F.col("rank").cast("int"))
    w = Window.partitionBy("run_name", "case_label", "side").orderBy("rank")  # one case's features
    return t.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def casebook(cases: DataFrame, tokens: DataFrame) -> DataFrame:
    """Cases joined with their token rows (run, case): one tidy table."""
    c = cases.select("run_name", "case_label", *[x for x in cases.columns
                                                 if x not in ("run_name", "case_label") and x not in tokens.columns])
    return c.join(tokens, ["run_name", "case_label"], "left")


def manifest(cases: DataFrame, tokens: DataFrame) -> DataFrame:
    """Runs included, cases exported, token rows exported."""
    u = cases.select("run_name", F.lit(True).alias("__case")).unionByName(
        tokens.select(F.lit(None).cast("string").alias("run_name"), F.lit(False).alias("__case")))
    return u.agg(F.count_distinct("run_name").alias("runs_included"), F.count_if("__case").alias("cases_exported"),
                 F.count_if(~F.col("__case")).alias("token_rows_exported"))
