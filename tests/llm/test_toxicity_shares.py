"""Toxicity on label tables of which half or most rows are toxic."""

import random

import pytest

from tempora.llm import toxicity
from tests.llm.test_pairs_and_spans import DOCS, prose


@pytest.mark.parametrize("share", [0.5, 0.8])
def test_signs_are_mined_at_any_share(spark, share):
    r, rows, labels = random.Random(4), [], []
    for i in range(900):
        bad = r.random() < share
        words = prose(i, 20).split() + (["zorgish", "blimmer"] if bad else [])
        rows.append((i, " ".join(r.sample(words, len(words)))))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.ToxicityModel().fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model.slots)
    known = dict(labels)
    score = {x.doc_id: x.score for x in model.score(docs).where("held_out").collect()}
    assert min(s for i, s in score.items() if known[i]) > max(s for i, s in score.items() if not known[i])
