"""Token alignment and the batch encoders against the libraries and all pairs."""

import random

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tempora.llm import alignment, batch_tokens  # noqa: E402
from tests.llm import brute  # noqa: E402

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a", "a ", "a  b", "a\nb c\t d", "\n", " x y", "a▁b", "<s> </s> <|endoftext|>",
       "x<|endoftext|>y z", "你好 \U0001f600 été", "<0x41> b", "a　 b", "​ z", "ab\u0000c d"]


def texts(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghéß123.,-", k=r.randint(1, 12))) for _ in range(80)] + ["the", "of", "漢字"]
    gaps = [" "] * 30 + ["\n", "  ", "\t", " \n"]
    return ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_batch_ids_equal_the_libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    own = [t or "" for t in ODD] + texts(1) + [" ".join(texts(2)) * 40]
    plain, special = Tokenizer.from_file(BYTES), Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    model = SentencePieceProcessor(model_file=PIECES)
    for encoder, say in (
            (batch_tokens.ByteLevel(BYTES, True, False), lambda t: plain.encode(" " + t, add_special_tokens=False).ids if t else []),
            (batch_tokens.ByteLevel(BYTES, False, True), lambda t: special.encode(t, add_special_tokens=False).ids),
            (batch_tokens.Pieces(PIECES), lambda t: model.encode(t))):
        for column in (pa.array(own), pa.array(own[::-1]).slice(3)):
            got = []
            for _, part in batch_tokens.text_slices(column):
                ids, ends = encoder.ids(part)
                got += [ids[lo:hi].tolist() for lo, hi in zip(ends[:-1], ends[1:])]
            assert got == [say(t) for t in column.to_pylist()]


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST, 0])
def test_alignment_equals_all_pairs(spark, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST", broadcast)
    rows = list(enumerate(ODD + texts(3))) + [(None, "no id"), (None, None), (4, "an id twice"), (4, "an id twice")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pair long, row string")
    got = [tuple(r) for r in alignment.alignment(frame.repartition(3), BYTES, PIECES).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(got, key=str) == sorted(brute.alignments(rows, BYTES, PIECES), key=str)
    if broadcast:
        assert alignment.alignment(frame.limit(0), BYTES, PIECES).count() == 0


def test_small_slices_give_the_same(monkeypatch):
    a, b = alignment.sides(BYTES, PIECES)
    own = pa.array([t or "" for t in ODD] + texts(4), pa.large_string())
    whole = alignment.align(a, b, own)
    monkeypatch.setattr(batch_tokens, "SLICE", 50)
    parts = [alignment.align(a, b, t) for _, t in batch_tokens.text_slices(own)]
    assert len(parts) > 10
    for name in whole:
        say = (lambda x: x.to_pylist()) if isinstance(whole[name], pa.Array) else list
        assert [v for p in parts for v in say(p[name])] == say(whole[name])
