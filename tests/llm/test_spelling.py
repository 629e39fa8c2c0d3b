"""Spelling variants against a plain comparison of all words."""

import random
import zlib
from collections import Counter

import duckdb
import pytest

from tempora.llm import spelling
from tempora.llm.queries import OP11_SQL
from tests.llm import brute

DOCS = "doc_id long, text string, word string, n string"


def documents(seed, n_docs=60):
    r = random.Random(seed)
    stems = ["".join(r.choices("abcdeiloruéÀ", k=r.randint(5, 9))) for _ in range(40)]
    stems += ["stressed", "desserts", "abcab" * 9, "abcab" * 9 + "x", "abcab" * 8 + "abxab"]  # beyond WIDE

    def typo(w):
        at, c = r.randrange(len(w)), r.choice("abcdeiloruéÀ")
        return r.choice([w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]])

    def word():
        w = r.choice(stems)
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            w = typo(w)
        return w.upper() if r.random() < 0.1 else w

    return [(i, r.choice(["-", " ", "1"]).join(word() for _ in range(r.randint(1, 80)))) for i in range(n_docs)]


def check(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame).collect()}
    assert got == brute.spelling_variants(rows)
    return got


def test_variants_equal_brute_force(spark):
    got = check(spark, documents(1) + [(900, "vvvvva " * 3 + "vvvvvb " * 6 + "vvvvbb " * 12 + "vvvbbb " * 24)])
    assert [got[w][:2] for w in ("vvvvva", "vvvvvb", "vvvvbb", "vvvbbb")] == [
        ("vvvvvb", "vvvbbb"), ("vvvvbb", "vvvbbb"), ("vvvbbb", "vvvbbb"), (None, "vvvbbb")]


def test_every_split_of_nodes_and_searches_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(spelling, "NODE", 6)
    monkeypatch.setattr(spelling, "SEARCHES", 20)
    monkeypatch.setattr(spelling, "LEAF", 2)
    rows = documents(2)
    rows += [(i, " ".join("".join(random.Random(i * 50 + k).sample("abcdef", 6)) for k in range(50))) for i in range(30)]
    check(spark, rows)  # many words with equal counts: blocks at the lowest cut


def test_parts_of_long_texts_and_flushes(spark, monkeypatch):
    rows = [(i, t + " ") for i, t in documents(3)]
    long = [(7, " ".join(t for _, t in rows * 20))]
    assert len(long[0][1]) > 100_000
    check(spark, long)
    batch = pytest.importorskip("pyarrow").RecordBatch.from_pydict({"a": [i for i, _ in rows], "b": [t for _, t in rows]})
    whole = Counter()
    for b in spelling._count([batch]):
        whole.update(dict(zip(*b.to_pydict().values())))
    monkeypatch.setattr(spelling, "RUNS", 3)
    monkeypatch.setattr(spelling, "KEEP", 5)
    cut = Counter()
    for b in spelling._count([batch]):
        cut.update(dict(zip(*b.to_pydict().values())))
    assert cut == whole


def test_nulls_ties_repeats_and_empty_table(spark):
    rows = [(None, "abcde abcde abcde"), (1, None), (1, ""), (2, "abcdx abcdx abcdx"), (2, "abcdx abcdx abcdx"),
            (3, "abcdy " * 6), (4, "abcd " * 9), (5, "zzzzz zzzzz zzzzz")]
    assert all(zlib.crc32(f"{'' if i is None else i}:{w}".encode()) % 97 for i, t in rows for w in (t or "").split())
    got = check(spark, rows)
    assert got["abcde"] == ("abcdx", "abcdx", 3, 2, 6)  # abcdx and abcdy tie at 6
    assert got["zzzzz"] == (None, "zzzzz", 3, 0, None)
    check(spark, [])


def test_sql_says_the_same(spark):
    rows = documents(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    said = con.execute(OP11_SQL).fetchall()
    assert {r[0]: tuple(r[1:]) for r in said} == brute.spelling_variants(rows)
