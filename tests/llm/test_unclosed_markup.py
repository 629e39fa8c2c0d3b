"""Markup with unclosed parts: time grows with the length, and the end is defined."""

import time

import pytest
from pyspark.sql import functions as F

from tempora.llm import language


def strip(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", language.page_text(F.col("t")).alias("x")).orderBy("i").collect()
    return [r.x if r.x is None else " ".join(r.x.split()) for r in rows]


def test_parts_and_ends(spark):
    assert strip(spark, None, "", "<p>a<!-- b --> c</p>", "a <script x>b</script > c <style>d</STYLE>e",
                 "a <!-- b <p>c</p>", "a <script>b <p>c", "a < b <i>c</i> &amp; d", "a <b", "x<!-- a --><!-- b") == [
        None, "", "a c", "a c e", "a", "a", "a < b c d", "a <b", "x"]


@pytest.mark.parametrize("part", ["<!-- ", "<script ", "<style>", "<a ", "<html lang ", "&a", "&", "<", "<html lang  = "])
def test_two_megabytes_of_unclosed_parts(spark, part):
    page = spark.createDataFrame([(part * (2_000_000 // len(part)),)], "t string")
    own = page.select(F.length(language.page_text(F.col("t"))).alias("n"), F.length(language.declared_language(F.col("t"))).alias("d"))
    own.collect()
    start = time.perf_counter()
    own.collect()
    assert time.perf_counter() - start < 10
