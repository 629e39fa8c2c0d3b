"""What the token store reads and encodes again."""

import itertools

import public_tokenizers
import pytest

from tempora.llm import token_store
from tempora.llm.tokens import Encoder


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


def test_payloads_are_digested_where_they_lie(spark, path, tmp_path):
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(50)] + [(None, "a")], "doc_id long, text string")
    token_store.write(docs, root := f"{tmp_path}/store", path)
    places = token_store.places(spark, root, crc=True)
    lines = places._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    inside = itertools.takewhile(lambda i: depth[i] > depth[top], range(top + 1, len(lines)))
    below = "\n".join(lines[i] for i in inside)
    assert "payload" in below and "Join" not in below
    rows = sorted(places.collect(), key=lambda r: r.start)
    assert len(rows) == 51 and rows[0].id is None
    assert [r.start for r in rows] == [sum(x.length for x in rows[:i]) for i in range(51)]


def test_tokens_known_as_words_are_not_encoded_again(path):
    own, calls = Encoder(path), []

    class Model:
        def __init__(self, model):
            self.model = model

        def tokenize(self, chars):
            calls.append(chars)
            return self.model.tokenize(chars)

    own.model = Model(own.model)
    own.encode(["x known other"])
    calls.clear()
    texts = ["x known. other, (known) new! known", "x new? known\nother"]
    got = own.encode(texts)
    assert not {c for c in calls if c.endswith(("known", "other"))} - {"known", "other"}
    assert [len(g) // 4 for g in got] == [len(own.tokenizer.encode(t).ids) for t in texts]
    assert got == [own._whole(t) for t in texts]
