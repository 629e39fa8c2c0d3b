"""Exact-segment term removal and leakage scanning (regression cases of the
evaluated study, plus hand-derived cases)."""

import json

from pyspark.sql import functions as F

from tempora import config
from tempora.functions import report as rpt
from tempora.functions import text
from tempora.operators import audit


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()["y"]


def test_remove_terms_keeps_embedded_names(spark):
    assert one(spark, text.remove_terms("x"), "kernel32.dll.createremotethread") == \
        "kernel32.dll.createremotethread"
    assert one(spark, text.remove_terms("x"), "global\\trickbot") == "global\\"
    assert one(spark, text.remove_terms("x"), "c:/tmp/emotet.py") == "c:/tmp/.py"


def _reports(spark, docs):
    rows = [(str(i), json.dumps(d) if not isinstance(d, str) else d) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "sample_id string, text string")
    return df.withColumn("report", rpt.parse("text"))


def test_benign_api_report_has_no_hits(spark):
    rep = {"behavior": {"summary": {"resolved_apis": [
        "kernel32.dll.CreateRemoteThread", "advapi32.dll.CryptVerifySignatureW"]}}}
    hits = audit.scan_reports(_reports(spark, [rep]))
    assert hits.count() == 0


def test_leaked_mutex_gives_one_hit(spark):
    rep = {"behavior": {"summary": {"mutexes": ["Global\\TrickBot"]}}}
    hits = audit.scan_reports(_reports(spark, [rep])).collect()
    assert len(hits) == 1
    assert hits[0]["matched_term"] == "trickbot"
    assert hits[0]["match_type"] == "family_name"


def test_mixed_list_strings_and_dict_values(spark):
    rep = {"behavior": {"summary": {"files": ["a", {"k": "zeus x"}, 3], "mutexes": "notalist"}}}
    r = _reports(spark, [rep])
    pairs = audit.report_values(r).collect()
    assert sorted((p["field"], p["value"]) for p in pairs) == [("files", "a"), ("files", "zeus x")]
    hits = audit.scan_reports(r).collect()
    assert [(h["field"], h["matched_term"]) for h in hits] == [("files", "zeus")]
    counts = r.select(*rpt.list_counts("report", ["files", "mutexes"])).first()
    assert counts["count_files"] == 3 and counts["count_mutexes"] == 0


def test_malformed_report_policies(spark):
    r = _reports(spark, ['{"behavior": ', {"behavior": {"summary": {"files": ["x"]}}}])
    dropped = r.where(F.col("report").isNotNull())
    assert dropped.count() == 1  # audit: not scanned
    emptied = r.withColumn("report", F.coalesce("report", F.parse_json(F.lit("{}"))))
    c = emptied.where(F.col("sample_id") == "0").select(*rpt.list_counts("report")).first()
    assert all(v == 0 for v in c.asDict().values())
    pe = emptied.where(F.col("sample_id") == "0").select(*rpt.pe_features("report")).first()
    assert pe["pe_timestamp"] is None and pe["pe_n_sections"] == 0.0 and pe["pe_n_exports"] == 0.0


def test_pe_guards(spark):
    rep = {"static": {"pe": {"timestamp": "0x1", "imagebase": True, "entrypoint": 7,
                             "sections": [{"entropy": 2.0, "size_of_data": 0, "virtual_size": 10}],
                             "imports": [{"imports": ["a", "b", "c"]}, "x"], "exports": "none"}}}
    pe = _reports(spark, [rep]).select(*rpt.pe_features("report")).first()
    assert pe["pe_timestamp"] is None          # strings are not numbers
    assert pe["pe_imagebase"] is None          # neither are booleans
    assert pe["pe_entrypoint"] == 7.0
    assert pe["pe_total_size"] == 10.0         # size_of_data 0 -> virtual_size
    assert pe["pe_std_entropy"] == 0.0         # one section
    assert pe["pe_n_sections"] == 1.0 and pe["pe_n_import_dlls"] == 2.0
    assert pe["pe_n_import_funcs"] == 3.0 and pe["pe_n_exports"] == 0.0


def test_path_registry_command_tokens(spark):
    rep = {"behavior": {"summary": {"files": ["C:\\Users\\Bob\\x\\a.EXE"], "keys": ["HKLM\\A\\B\\C\\D"],
                                    "executed_commands": [" CMD.exe /c x"]}}}
    toks = _reports(spark, [rep]).select(rpt.artifact_tokens("report").alias("t")).first()["t"]
    assert toks == ["FILE_EXT:exe", "FILE:a.exe", "REG:hklm/a/b/c", "CMD:cmd.exe"]
    assert one(spark, text.normalise_path("x"), "C:\\Users\\Bob\\x\\a.EXE") == "c:/users/<user>/x/a.exe"


def test_guid_before_hex_and_temp(spark):
    s = "C:\\Temp\\Dir\\{0123abcd-0123-4567-89ab-0123456789ab}\\deadbeef99.bin"
    out = one(spark, text.normalise_path("x"), s)
    assert out == "c:/temp/<tmp>/{<guid>}/<hex>.bin"
    assert one(spark, text.normalise_path("x"), "c:/x/temp/secret/file.txt") == "c:/x/temp/<tmp>/file.txt"


def test_segments_are_exact_and_distinct(spark):
    segs = one(spark, text.segments("x"), "CryptVerifySignatureW sig SIG x-y")
    assert sorted(segs) == ["cryptverifysignaturew", "sig", "x", "y"]
    assert one(spark, text.segments("x"), None) == []


def test_large_vocabulary_uses_join_path(spark):
    vocab = {"family_name": [f"term{i}" for i in range(3000)] + ["zeus"]}
    df = spark.createDataFrame([("1", "f", "a zeus term7 b")], "sample_id string, field string, value string")
    hits = audit.scan(df, vocab).collect()
    assert sorted(h["matched_term"] for h in hits) == ["term7", "zeus"]
    assert config.CLASS_NAMES[0] == "emotet"
