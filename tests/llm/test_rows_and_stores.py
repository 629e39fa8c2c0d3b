"""Quality rules, packing, toxicity, token store, URL trust, languages, pipeline."""

import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import (decontam, language, packing, quality, queries, token_store, tokens,
                         toxicity, url_trust)
from tempora.llm.tables import Scratch
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.test_pairs_and_spans import DOCS, prose

ODD = [None, "", " ", "a", "\n\n", "a b c a b c", "x\nx\n x\nx\r\nx\n", "é à É", "\x0b\x0c a\n\na\n", "#|<> $5 % &"]


def test_base_counts_equal_brute_force(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = quality.measure(pa.array(texts))[quality.BASE_COUNTS].to_numpy().tolist()
    assert got == [list(brute.base_counts(t)) for t in texts]


def test_binomial_bound_and_walk():
    # exact: (1 - 0.05)^59 = 0.0485 <= 0.05 < (1 - 0.05)^58
    assert quality.certified(0, 59, 0.05, 0.05) and not quality.certified(0, 58, 0.05, 0.05)
    assert not quality.certified(0, 0, 0.5, 0.5) and not quality.certified(5, 50, 0.05, 0.05)
    assert quality.walk([50, 0, 0], [90, 80, 10], 1000, 0.01, 0.05, 20) == 1
    assert quality.walk([50, 40, 0], [90, 80, 0], 1000, 0.01, 0.05, 20) is None


def test_quality_rejects_junk_and_keeps_clean(spark):
    rows, labels = [], []
    for i in range(1200):
        junk = i % 3 == 0
        text = prose(i, 70)
        rows.append((i, text.replace(" ", "%%% ") if junk else text, ["en", "xx"][i % 2]))
        labels.append((i, 0 if junk else 1))
    rows += [(5000, prose(1, 70).replace(" ", "%%% "), None), (5001, None, "en"), (None, prose(2, 60), "en")]
    docs = spark.createDataFrame(rows, DOCS + ", lang string").withColumn("n_words", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(docs, lab, risk=0.2).collect()}
    assert all(got[i].kept == (i % 3 != 0) for i in range(1200))
    assert got[5000].kept and not got[5001].kept and got[None].kept  # a stratum without labels has no rule
    kept = quality.keep_good(docs, lab, risk=0.2)
    assert kept.columns == docs.columns and kept.count() == 802
    assert quality.quality(docs, lab.limit(0)).where("kept").count() == 1202
    assert quality.quality(docs.limit(0), lab).count() == 0


def test_copies_are_no_evidence(spark):
    """Cutoffs equal a brute-force walk over distinct texts: 2,000 copies certify nothing."""
    def texts(n, copies):
        good = [prose(i, 70) for i in range(n)]
        junk = [prose(i, 70).replace(" ", "%%% ") for i in range(60)]
        rows = [(i, t) for i, t in enumerate(good + good[:1] * copies + junk)]
        lab = [(i, int(i < n + copies)) for i, _ in rows]
        return (spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS + ", lang string"),
                spark.createDataFrame(lab, "doc_id long, quality int"), good, junk)

    def brute_cutoffs(good, junk, risk):
        out = {}
        for name, (num, den) in quality.SIGNALS.items():
            level = [[sum(r[num] / r[den] >= c for c in quality.GRID[name]) if r[den] else 0
                      for r in quality.measure(pa.array(sorted(set(t)))).to_dict("records")] for t in (good, junk)]
            reach = [[sum(x > i for x in own) for i in range(len(quality.GRID[name]))] for own in level]
            i = quality.walk(*reach, len(level[0]), risk / 7, 0.05 / 7, 20)
            if i is not None:
                out[name] = quality.GRID[name][i]
        return out

    for n, copies, risk in ((101, 2000, 0.3), (500, 40, 0.3)):
        docs, lab, good, junk = texts(n, copies)
        f = quality.base_failed(quality.features(docs, ["doc_id", "lang"]))
        got = {r.signal: r.cutoff for r in quality.choose_cutoffs(f, lab, risk=risk).collect()}
        assert got == brute_cutoffs(good, junk, risk)
        assert bool(got) == (n == 500)


def test_bounds_are_optimal():
    r = random.Random(2)
    for _ in range(30):
        lengths = sorted(r.sample(range(1, 40), r.randint(1, 8)))
        counts = [r.randint(1, 9) for _ in lengths]
        k = r.randint(1, 4)
        pad = lambda b: sum(c * (min(x for x in b if x >= n) - n) for n, c in zip(lengths, counts))  # noqa: B023,E731
        best = min(pad(set(c) | {lengths[-1]}) for c in itertools.combinations(lengths, min(k, len(lengths)) - 1))
        got = packing.best_bounds(lengths, counts, k)
        assert len(got) <= k and pad(got) == best


def test_packing_places_every_word(spark, monkeypatch):
    monkeypatch.setattr(packing, "LANE", 20)
    rows = [(i, prose(i, 1 + i % 40)) for i in range(300)] + [(1, prose(1, 2)), (None, "a b"), (7, None), (8, ""),
                                                             (9, prose(9, 500))]
    docs = spark.createDataFrame(rows, DOCS).withColumn("bound", F.lit(1)).withColumn("length", F.lit("x"))
    out = packing.pack(docs, max_len=64, buckets=5, budget=256).toPandas()
    assert out["length"].sum() == sum(len(brute.words(t)) + 1 for _, t in rows)
    assert (out["length"] <= out["bound"]).all() and out["bound"].nunique() <= 5
    sizes = out.groupby(["bound", "lane", "batch"]).agg(n=("slot", "size"), slots=("slot", "nunique"))
    assert (sizes["n"] * sizes.index.get_level_values("bound") <= 256).all() and (sizes["n"] == sizes["slots"]).all()
    assert packing.pack(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(i, "a b c") for i in [None] * 300 + [7] * 300], DOCS)
    lanes = packing.pack(same, max_len=64, buckets=5, budget=256).groupBy("bound", "lane").count().toPandas()
    assert lanes["count"].sum() == 600 and lanes["count"].max() < 60 and len(lanes) > 20


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_op3_packs_token_ids(spark, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    rows = [(i, prose(i, 30 * i)) for i in range(40)] + [(50, "中文" * 4000), (51, None), (52, ""), (None, "a b"), (1, "x")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op3_packing(spark, str(tmp_path)).toPandas()
    want = {}
    for i, text in rows:
        want[i] = want.get(i, 0) + len(whole.encode(text or "", add_special_tokens=False).ids) + 1
    got = out.fillna({"doc_id": -1}).groupby("doc_id")["length"].sum()
    assert {None if i == -1 else i: n for i, n in got.items()} == want
    assert (out["length"] <= 2048).all() and (out["doc_id"] == 50).sum() > 1
    sizes = out.groupby(["bound", "lane", "batch"])["bound"].sum()
    assert (sizes <= 65_536).all()


def test_cached_ids_equal_the_library(tokenizer):
    from tokenizers import Tokenizer

    whole, own, r = Tokenizer.from_file(tokenizer), tokens.Encoder(tokenizer), random.Random(5)
    signs = [" ", "  ", "\n", " \n", "a", "b's", "É", "ß", "<|endoftext|>", "1", "23", "!", "...", "\t", "\xa0", "\u3000",
             "don't", "中", "😀", "\r\n", "\x1c", "\x85", "\u200b", "'ll", "' s", "word", "Word,"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 14))) for _ in range(4000)] + ["", " ", prose(3, 400)]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want


def test_token_store_round_trip(spark, tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "BUCKET", 64)
    whole = Tokenizer.from_file(tokenizer)
    rows = [(i * 7 - 300, prose(i, i % 50)) for i in range(400)] + [(1000000, None), (1000001, ""), (1000002, "é  x"),
                                                                   (1000003, prose(9, 3000))]
    docs = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("x")).withColumn("start", F.lit(1))
    root = Scratch(spark, "test").path("store")
    token_store.write(docs.repartition(5), root, tokenizer)
    got, at = {r.doc_id: r for r in token_store.digest(spark, root).collect()}, 0
    for i, text in sorted(rows):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.indexed
        at += len(ids)
    assert token_store.get(spark, root, 1000002) == whole.encode("é  x", add_special_tokens=False).ids + [2]
    assert token_store.get(spark, root, 2) is None
    empty = Scratch(spark, "test").path("store")
    token_store.write(docs.limit(0), empty, tokenizer)
    assert token_store.digest(spark, empty).count() == 0 and token_store.get(spark, empty, 5) is None
    odd = Scratch(spark, "test").path("store")
    token_store.write(spark.createDataFrame([(3, "a"), (3, "b"), (None, "c"), (None, None)], DOCS), odd, tokenizer)
    found = token_store.digest(spark, odd).collect()
    assert len(found) == 4 and sum(bool(r.indexed) for r in found) == 1


@pytest.mark.parametrize("m", [1, 2, 3, 50, 3000])
def test_perfect_hash_is_a_permutation(m):
    keys = np.random.default_rng(m).choice(10**12, m, replace=False) - 10**11
    seeds, slots = token_store.perfect_hash(keys)
    assert sorted(slots) == list(range(m))
    assert (token_store.slot_of(keys, seeds, m) == slots).all()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.ToxicityModel().fit(docs, labels).score(docs)
    assert out.count() == docs.count()
    assert out.where("score < 0 or score > 1 or score is null").isEmpty()
    held = out.join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    rank = held["score"].rank()
    auc = (rank[held.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert auc > 0.95 and toxic["predicted"].mean() > 0.85 and clean["predicted"].mean() < 0.03


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(30)] + [(90, None), (91, ""), (None, "you idiot"),
                                                                          (92, "you idiot"), (92, "you idiot")], DOCS)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        out = toxicity.ToxicityModel().fit(docs, lab).score(docs)
        assert out.count() == 35 and out.where("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.ToxicityModel().fit(docs.limit(0), labels).score(docs.limit(0)).count() == 0


def test_url_rules_and_propagation(spark):
    rows = [(1, "HTTP://A.Example.ORG/es/x?y#z", "<a href='//b.net/q'>"), (2, "http://org/ES", ""), (3, None, None),
            (4, "nourl", ""), (5, "a://", "x"), (6, "http://b.net?x://y/z", ""),
            (7, "http://xorg/es/", '<a href="https://spam.com/de/1">'), (8, "http://spam.com/de/", ""),
            (9, "http://org", ""), (10, "http://sub.example.org/en/17", ""), (8, "http://spam.com/de/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_trust.judge(pages, queries.URL_RULES).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("org", "/ES", "org/", "allow") and got[9] == ("org", "", None, "allow")
    assert got[3] == got[4] == got[5] == ("", "", None, "allow") and got[6] == ("b.net", "", None, "allow")
    assert got[7] == ("xorg", "/es/", None, "block")  # it links to a blocked host
    assert got[10][2:] == ("example.org/en/1", "block") and got[8][2:] == ("com/de/", "block")
    assert url_trust.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_page_rank_equals_power_iteration(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 2.0), ("d", "c", 1.0)]
    seeds = {"a": (1.0, 0.0), "c": (0.0, 0.5)}
    got = url_trust.spread(spark.createDataFrame(edges, "src string, dst string, w double"),
                           spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"),
                           Scratch(spark, "test"))
    for kind, column in ((0, "trust"), (1, "distrust")):
        own = [(s, d, w) if not kind else (d, s, w) for s, d, w in edges]
        out = {n: sum(w for s, _, w in own if s == n) for n in "abcd"}
        base = {n: 0.15 * seeds.get(n, (0, 0))[kind] for n in "abcd"}
        rank = base
        for _ in range(200):
            rank = {n: base[n] + 0.85 * sum(rank[s] * w / out[s] for s, d, w in own if d == n) for n in "abcd"}
        for r in got.collect():
            assert r[column] == pytest.approx(rank[r.host] / sum(rank.values()), rel=0.01)


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    """Hosts that lead to a blocked one, however many links away; seeds' number is no scale."""
    rows = [(i, f"http://h{i}.net/x", f"<a href='http://h{i + 1}.net/'>") for i in range(25)] \
        + [(25, "http://h25.net/x", "<a href='http://bad.com/de/'>"), (26, "http://bad.com/de/", "")] \
        + [(100 + i, f"http://t{i}.org/", f"<a href='http://good{i}.net/'>") for i in range(9)] \
        + [(200 + i, f"http://good{i}.net/", "") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_trust.judge(pages, queries.URL_RULES + [(f"t{i}.org/", "allow") for i in range(9)])
           .collect()}
    assert all(got[i].verdict == "block" and got[i].distrust > 0 for i in range(26))
    assert all(got[200 + i].verdict == "allow" and got[200 + i].trust > 0 for i in range(9))
    # a path without cycles: each host has 0.85 of the next one's distrust
    assert all(got[i].distrust == pytest.approx(0.85 * got[i + 1].distrust) for i in range(25))


def test_language_fusion(spark):
    docs, pages = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "pages"))
    model = language.TextModel().fit(docs)
    alone = model.likelihoods(docs, "doc_id", F.col("text")).join(
        docs.select(F.col("doc_id").alias("row"), "lang", "n_chars"), "row").where("n_chars > 80").collect()
    right = [model.languages[int(np.argmax(r.loglik))] == r.lang for r in alone]
    assert np.mean(right) > 0.97
    odd = spark.createDataFrame([(900, None, None), (901, "x", ""), (902, "http://a.de/fr/x", "<html lang='de'></html>"),
                                 (902, "http://a.de/fr/x", "<html lang='de'></html>")],
                                "page_id long, url string, html string")
    both = pages.unionByName(odd).withColumn("lang", F.lit("clash")).withColumn("host", F.lit(0))
    out = language.identify(both, model)
    assert out.count() == pages.count() + 4
    checked = out.where("page_id < 900 and declared = address").toPandas()
    assert (checked["lang"] == checked["declared"]).mean() > 0.97
    assert out.where("lang is null or probability is null or probability > 1.0000001").isEmpty()
    assert language.identify(both.limit(0), model).count() == 0
    nothing = language.TextModel().fit(docs.limit(0))
    assert language.identify(odd, nothing).where("lang is null").count() == 4


def test_pipeline_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    scratch, kept = Scratch(spark, "test"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.put(stage(spark, docs, SF_SMALL), name)
        if name != "length_packing":
            assert docs.columns == before.columns
        kept[name] = (before, docs)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = kept["minhash_dedup"]
    comps, _ = brute.near_components({r.doc_id: r.text for r in before.collect()})
    assert ids(after) == {i for i, c in comps.items() if i == c}
    before, after = kept["quality_rules"]
    short = {r.doc_id for r in before.collect() if len(brute.words(r.text)) < 50}
    assert not ids(after) & short
    before, after = kept["substring_dedup"]
    assert ids(before) == ids(after) and after.where("n_chars <> length(text)").count() == before.where(
        "n_chars <> length(text)").count()
    before, after = kept["benchmark_decontamination"]
    hit = ids(decontam.contaminated(before, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")))
    assert ids(after) == ids(before) - hit
    before, after = kept["length_packing"]
    assert after.agg(F.sum("length")).first()[0] == sum(len(brute.words(r.text)) + 1 for r in before.collect())


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 3), (1, "", None, "s", 0)],
                                docs.schema)
    for frame in (docs.limit(0), docs.limit(30).unionByName(odd).unionByName(docs.limit(2))):
        own = frame.withColumn("row", F.lit(1)).withColumn("node", F.lit("n"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            own = Scratch(spark, "test").put(stage(spark, own, SF_SMALL), name)
            assert own.columns == [*docs.columns, "row", "node"]


def test_op1_sql_by_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    want = con.execute(queries.SQL["op1_near_dedup"]).fetchall()
    got = [tuple(r) for r in queries.op1_near_dedup(spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(want)
