"""Prefix hashes and fingerprints against plain comparison."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.llm import fingerprints
from tests.llm.test_pairs_and_spans import prose

DOCS = "doc_id long, text string, range int, hash string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé\U0001f600", max_size=30), min_size=1, max_size=5))
def test_spans_and_extensions_equal_slices(texts):
    whole, hashed = "".join(texts), fingerprints.PrefixHashes(texts)
    r = random.Random(len(whole))
    i, j = (np.array([r.randint(0, len(whole)) for _ in range(40)]) for _ in range(2))
    n = np.array([r.randint(0, min(len(whole) - max(a, b), 9)) for a, b in zip(i, j)])
    same = hashed.spans(i, i + n) == hashed.spans(j, j + n)
    assert same.tolist() == [whole[a:a + k] == whole[b:b + k] for a, b, k in zip(i, j, n)]
    right = hashed.common(i, j, len(whole) - np.maximum(i, j))
    left = hashed.common(i, j, np.minimum(i, j), back=True)
    for a, b, x, y in zip(i, j, right, left):
        assert whole[a:a + x] == whole[b:b + x] and whole[a - y:a] == whole[b - y:b]
        assert whole[a:a + x + 1] != whole[b:b + x + 1] or max(a, b) + x == len(whole)
        assert y == min(a, b) or whole[a - y - 1] != whole[b - y - 1]


def test_periodic_texts_have_different_hashes():
    # binary Thue-Morse words, whose polynomials vanish modulo powers of two
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    a, b = fingerprints.PrefixHashes([word, other]).fingerprints()
    assert a.split(".")[1] != b.split(".")[1]


def test_likeness():
    def prints(*texts):
        return fingerprints.PrefixHashes(list(texts)).fingerprints()

    base = prose(1, 400)
    words = base.split()
    moved = " ".join(["new", "start", *words[:200], "in", "between", *words[200:]])
    a, copy, shifted, other, empty, empty2 = prints(base, base, moved, prose(2, 400), "", "")
    like = fingerprints.likeness
    assert a == copy and like(a, copy) == 1 and like(empty, empty2) == 1 and like(a, empty) == 0
    assert like(a, shifted) > 0.7 and like(a, other) < 0.1 and like(a, shifted) == like(shifted, a)
    x, y = prints("abcd", "abce")
    assert 0.7 <= like(x, y) < 1


def expected(rows):
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        new = t[:len(t) - k] + after[:k]
        left = next((x for x, (p, q) in enumerate(zip(t, new)) if p != q), min(len(t), len(new)))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), *fingerprints.PrefixHashes([t, new]).fingerprints(), left))
    return out


def run(spark, rows):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(5)
    return fingerprints.neighbours(frame).collect()


def test_neighbours_equal_plain_order(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.randint(-10**12, 10**12), prose(i, r.randint(0, 60)) + r.choice(["", "é\U0001f600"])) for i in range(300)]
    rows += [(10**13, None), (10**13 + 1, ""), (10**13 + 2, "a"), (10**13 + 3, prose(5, 30_000))]
    want = expected(sorted((i, t or "") for i, t in rows))
    for size in (fingerprints.SLICE, 100):
        monkeypatch.setattr(fingerprints, "SLICE", size)
        got = sorted((x.doc_id, x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint, x.common_prefix)
                     for x in run(spark, rows))
        assert got == sorted(want)
    for x in run(spark, rows):
        assert 0 <= x.near_next <= 1 and (x.n_chars < 200 or x.near_edited > 0.6)


def test_hot_ids_null_ids_one_row_and_empty_table(spark):
    hot = [(7, prose(i, 5)) for i in range(400)] + [(None, prose(1000 + i, 5)) for i in range(300)]
    rows = hot + [(i, prose(2000 + i, 5)) for i in range(10)] + [(8, "twice"), (8, "twice")]
    got = run(spark, rows)
    texts = {}
    for i, t in rows:
        texts.setdefault((i, fingerprints.PrefixHashes([t]).fingerprints()[0]), t)
    assert len(got) == len(rows)
    edited = {x.edited_sha256 for x in got}
    # every document is the next of one other: its first code points are in some edited text
    assert sorted(x.n_chars for x in got) == sorted(len(t) for _, t in rows) and len(edited) > 700
    order = sorted(i for i, _ in rows if i is not None)
    assert sorted(x.doc_id for x in got if x.doc_id is not None) == order
    one = run(spark, [(3, "abcdefgh")])[0]
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert run(spark, []) == []
