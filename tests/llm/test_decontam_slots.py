"""Decontamination: equal values, one changed value, items with few plain words."""

from tempora.llm import decontam
from tests.llm.test_pairs_and_spans import DOCS


def test_equal_changed_and_few_plain_words(spark):
    apples = "if someone buys 3 apples and later 4 pears how much fruit is there in the basket"
    tail = " then all of the others went home and nobody said a word about what had been seen there"
    long = "there were 3 men and also 3 dogs on the road to the old mill" + tail
    sums = "12 + 30 = 42 and 17 - 5 = 12 and 9 * 8 = 72 or 100 / 4 = 25"
    items = spark.createDataFrame([(1, apples), (2, long), (3, sums)], "item_id long, text string")
    rows = [(1, apples.replace("3", "5").replace("4", "5")), (2, long.replace("3 dogs", "4 dogs")), (3, f"so {sums} ok"),
            (4, sums.replace("2", "3")), (5, "there were 3 men and also 4 dogs on the road")]
    docs = spark.createDataFrame([(i, f"well now {t} indeed") for i, t in rows], DOCS)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}
