"""Near-dedup, substring dedup, decontamination and licence scans."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from tempora.llm import decontam, licenses, near_dedup, substring
from tests.conftest import SF_SMALL
from tests.llm import brute

DOCS = "doc_id long, text string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("aeioubcdfglmnprst", k=r.randint(2, 9))) for _ in range(n))


def test_near_groups_equal_brute_force(spark):
    base = prose(1, 120).split()
    texts = {}
    r = random.Random(7)
    for i in range(150):  # one family around the limit, so that links form chains
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 50)}"
        texts[i] = " ".join(w)
    texts |= {200 + i: prose(100 + i, 60) for i in range(40)}
    texts |= {300: None, 301: "", 302: " \n", 303: "Ab c", 304: "aB  C", 305: "ab c d", 306: prose(1, 5000)}
    docs = spark.createDataFrame(list(texts.items()), DOCS).withColumn("node", F.lit("x")).withColumn("rep", F.lit(1))
    got = {r.doc_id: r for r in near_dedup.near_groups(docs).collect()}
    comps, sizes = brute.near_components(texts)
    assert {i: r.component_id for i, r in got.items()} == comps
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (comps[i] == i) for i, r in got.items())


def test_dense_large_node_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    base, r, texts = prose(3, 60).split(), random.Random(5), {}
    for i in range(60):
        w = list(base)
        for at in r.sample(range(60), r.randint(0, 4)):
            w[at] = f"y{r.randint(0, 9)}"
        texts[i] = " ".join(w)
    got = near_dedup.near_groups(spark.createDataFrame(list(texts.items()), DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.near_components(texts)[0]


def test_near_repeated_and_null_ids_and_empty_table(spark):
    a, b = prose(11, 50), prose(12, 50)
    docs = spark.createDataFrame([(5, a), (5, b), (7, b), (7, b), (9, a), (None, a), (None, None)], DOCS)
    rows = near_dedup.near_groups(docs).collect()
    assert len(rows) == 7
    assert {r.component_id for r in rows if r.doc_id is not None} == {5}
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_dedup.near_groups(docs.limit(0)).count() == 0
    left = near_dedup.dedupe(docs).collect()
    assert sorted(str(r.doc_id) for r in left) == ["5", "5", "None", "None"]


def test_substring_cuts_planted_passages_and_leaves_clean_texts(spark):
    passage = prose(50, 51)
    rows = [(i, prose(1000 + i, 80)) for i in range(30)]
    planted = {i: f"{prose(2000 + i, 40)} {passage} {prose(3000 + i, 40)}" for i in range(100, 140)}
    rows += list(planted.items()) + [(200, None), (201, ""), (202, "short text"), (None, passage), (203, passage * 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("r")).withColumn("copies", F.lit(2))
    got = {(r["row"]["doc_id"], r["text"]): r for r in substring.cut_repeats(docs).collect()}
    by = {k[0]: r for k, r in got.items()}
    assert all(not by[i].removed for i in [*range(30), 100, 200, 201, 202])
    assert by[200].text is None and by[100].text == planted[100]
    kept = passage.split()
    for i in [*range(101, 140), 203]:
        gone = sum(x.last - x.first + 1 for x in by[i].removed)
        assert 24 <= gone <= 51
        assert all(w in by[i].text.split() for w in planted.get(i, "").split() if w not in kept)
    assert [r for k, r in got.items() if k[0] is None][0].text == passage
    assert by[100]["row"]["row"] == "r" and by[100]["row"]["copies"] == 2
    assert substring.cut_repeats(docs.limit(0)).count() == 0


def test_chunks_resist_an_insertion():
    import pyarrow as pa

    from tempora.llm.text import slices

    w = prose(8, 400).split()
    digests = [set(substring.chunk_pairs(next(slices(pa.array([" ".join(x)]))))[3].tolist())
               for x in (w, w[:200] + ["inserted"] + w[200:])]
    assert len(digests[0] - digests[1]) <= 5


def test_decontamination_follows_slots(spark):
    item = "If Anna buys 3 apples for 12 dollars and eats 3 apples how much does Anna pay for the rest today"
    items = spark.createDataFrame([(1, item), (2, "one two three four five"), (3, None), (4, ""), (None, item)],
                                  "item_id long, text string")
    same = "Well. If Bert buys 7 apples for 30 euros and eats 7 apples how much does Bert pay for the rest today then"
    rows = [(1, same), (2, same.replace("eats 7", "eats 8")), (3, "x one two THREE four, five y"), (4, None), (5, ""),
            (None, item), (1, "another row of one id"), (6, prose(4, 300)), (7, f"{item} {same}")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("item_id", F.lit(9)).withColumn("hash", F.lit(0))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 1), (3, 2), (7, 1)}
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "5", "6", "None"]
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.contaminated(docs.limit(0), items).count() == 0


def test_decontamination_finds_verbatim_items(spark):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(brute.words(t.lower()))
    bench = [(r.item_id, plain(r.text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in bench if t in plain(r.text or "")}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == want


def test_license_alignment(spark):
    rows = [(1, "so (Licensed under the fine Apache License version 2.0). all rights reserved"), (2, None), (3, ""),
            (4, "all rights reserved and again ALL rights reserved"), (5, "licensed under the"),
            (6, "Licensed under CC BY-NC 4.0."), (7, prose(3, 500)), (None, "Released under the MIT License")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("template", F.lit("t"))
    got = sorted((str(r.doc_id), r.template, r.first_word, r.last_word) for r in licenses.scan(docs).collect())
    assert got == [("1", "apache-2.0/notice", 1, 8), ("1", "proprietary/notice", 9, 11),
                   ("4", "proprietary/notice", 0, 2), ("4", "proprietary/notice", 5, 7),
                   ("6", "cc-by-nc-4.0/notice", 0, 4), ("None", "mit/notice", 0, 4)]
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [("a b c x d e", (5, 0, 5)), ("a b d e", (4, 0, 3)), ("a b q d e", (4, 0, 4))])
def test_alignment_by_hand(text, want):
    codes = {w: i for i, w in enumerate("abcdexq")}
    assert licenses.align([codes[w] for w in "a b c d e".split()], [codes[w] for w in text.split()], 0) == want


@pytest.mark.parametrize("text,want", [
    ("Released under the BSD License", "bsd/notice"), ("Released under the XYZ License", None),
    ("Licensed under the Mozilla License, Version 2.0", "mpl-2.0/notice"),
    ("Licensed under the Apache License, Version 1.1", "apache-1.1/notice"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0/notice"),
    ("This work is licensed under the GNU General Public License, version 2", "gpl-2.0/notice"),
    ("This work is licensed under the GNU General Public License, version 1", None),
    ("This work is licensed under the GNU General Public License v3", "gpl-3.0/notice"),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1", "lgpl-2.1/notice"),
    ("This work is licensed under the GNU Library General Public License, version 3", None),
    ("Licensed under CC BY-ND 4.0", "cc-by-nd-4.0/notice"), ("Licensed under CC BY-NC 3.0", "cc-by-nc-3.0/notice"),
    ("Licensed under CC BY 1.0", None)])
def test_identifying_words_must_match(text, want):
    assert [m[0] for m in matches(f"so {text} then")] == ([want] if want else [])


@functools.cache
def license_index():
    return licenses.Index(licenses.TEMPLATES)


def matches(text):
    import numpy as np
    import pyarrow as pa

    index = license_index()
    _, words, _ = next(licenses.bare_words(pa.array([text])))
    hits = []
    for k in index.sizes:
        hashes, _ = licenses.window_hashes(words, np.array([0, len(words)]), k)
        hits += [(at, h) for at, h in enumerate(hashes.tolist()) if h in index.grams]
    return licenses._matches(index, words, hits)


@pytest.mark.parametrize("name", list(licenses.TEXTS))
def test_whole_license_texts_have_their_own_span(name):
    words = licenses._text(name).replace(licenses.MARK, "").split()
    size = len(license_index().words[license_index().names.index(f"{name}/text")])
    words[len(words) // 2] = "changed"
    (got,) = matches(f"{prose(1, 30)} {' '.join(words)} {prose(2, 30)}")
    assert got[0] == f"{name}/text" and 1 - 3 / size <= got[1] < 1 and got[2] == 30 and got[3] >= 30 + size - 2
    assert f"{name}/text" not in [m[0] for m in matches(" ".join(words[: len(words) // 2]))]


def test_affero_title_is_not_the_general_public_license():
    text = licenses._text("gpl-3").replace(licenses.MARK, "").replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC")
    assert "gpl-3/text" not in [m[0] for m in matches(text)]


def test_license_headers_are_whole():
    header = licenses.TEMPLATES["gpl-2.0/header"].replace("^2|2.0|v2|v2.0|2.0-only|2-only", "2").replace("^", "")
    assert [m[:2] for m in matches(header)] == [("gpl-2.0/header", 1.0)]
    assert not matches(" ".join(header.split()[:40]))
