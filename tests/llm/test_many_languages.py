"""Language identification with more than 64 languages."""

import random

import numpy as np
from pyspark.sql import functions as F

from tempora.llm import language


def speak(i, seed, n=60):
    letters, r = random.Random(i).sample("abcdefghijklmnopqrstuvwxyz", 7), random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(3, 7))) for _ in range(n))


def test_every_language_is_kept(spark):
    rows = [(f"l{i:02d}", speak(i, 100 * i + j)) for i in range(70) for j in range(2 if i < 66 else 1)]
    model = language.TextModel().fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == [f"l{i:02d}" for i in range(70)]
    new = spark.createDataFrame([(i, speak(i, 9000 + i)) for i in range(70)], "id long, text string")
    got = {r.row: int(np.argmax(r.loglik)) for r in model.likelihoods(new, "id", F.col("text")).collect()}
    assert got == {i: i for i in range(70)}
    pages = spark.createDataFrame([(i, f"http://h{i}.net/x", speak(i, 5000 + i)) for i in (0, 65, 68, 69)],
                                  "page_id long, url string, html string")
    assert {r.page_id: r.lang for r in language.identify(pages, model).collect()} == {i: f"l{i}" if i else "l00"
                                                                                       for i in (0, 65, 68, 69)}
