"""TF-IDF counts terms where the document lies; no row per (document, term) is moved."""

from pyspark.sql import functions as F

from tempora.operators import features
from tempora.plans import feature_plans
from tests.conftest import SF_SMALL


def test_weights_move_texts_not_terms(spark, capsys):
    for query in (feature_plans.tfidf_weights, feature_plans.top_terms):
        query(spark, SF_SMALL).explain()
        above = capsys.readouterr().out.split("Generate")
        assert len(above) == 2
        moved = [line for line in above[0].splitlines() if "Exchange" in line]
        assert all("BroadcastExchange" in line for line in moved), moved


def test_terms_outside_the_vocabulary_are_not_counted(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "c"), (3, None)], "doc_id long, x string") \
        .select("doc_id", F.split("x", " ").alias("t"))
    vocab = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 2.0)], "term string, index int, idf double")
    counts = features.term_counts(docs, "doc_id", "t", within=vocab)
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 2), (1, "b", 1)]
    w = {(r.doc_id, r.term): r.weight for r in features.tfidf_transform(counts, vocab, "doc_id").collect()}
    assert abs(sum(x * x for x in w.values()) - 1) < 1e-12 and w[1, "b"] > w[1, "a"]
