"""Nested JSON reports derived from ``events`` (one report per event), parsed
back through VARIANT.  The reports mix string, object and number list elements,
hold a non-list field, a JSON null, PE sections and imports, and every 50th one
is truncated (malformed).  Oracles compute the expected values straight from the
event columns, so the JSON path is checked end to end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import report as rpt
from ..functions import text
from ..operators import audit
from . import sqlgen as S
from .catalog import register, table
from .metric_plans import r6

def _cls_arr():
    return F.array(*[F.lit(c) for c in config.CLASS_NAMES])


_CLS_SQL = "[" + ", ".join(S.q(c) for c in config.CLASS_NAMES) + "]"


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def _append(json_array, extra):
    """Splice raw JSON elements before the closing bracket of a JSON array
    (plain string slicing: no regex replacement, which would eat backslashes)."""
    return F.concat(F.regexp_extract(json_array, r"^(.*)\]$", 1), F.lit(","), extra, F.lit("]"))


def event_reports(spark, d):
    """``sample_id, text`` — the report JSON text of every event."""
    e = table(spark, d, "events").withColumn("k", _k())
    cls = F.element_at(_cls_arr(), ((F.col("user_id") + F.col("k")) % 10 + 1).cast("int"))
    et = F.col("event_type")
    uid = F.col("user_id").cast("string")
    k = F.col("k").cast("string")
    apis = _append(F.to_json(F.array(
        F.concat(F.lit("kernel32.dll."), et), F.concat(F.lit("Advapi32."), F.upper(et), F.lit("W")),
        F.concat(F.lit(" ntdll."), cls, F.lit(".Init ")), F.lit("kernel32.dll.CreateRemoteThread"))), k)
    n_files = (F.col("user_id") % 3 + 1).cast("int")
    paths = F.transform(F.sequence(F.lit(1), n_files), lambda i: F.concat(
        F.lit("C:\\Users\\U"), uid, F.lit("\\AppData\\Temp\\T"), k, F.lit("\\"), et, i.cast("string"),
        F.lit(".EXE")))
    h = F.md5(F.col("event_id").cast("string"))
    guid_path = F.concat(F.lit("D:\\Cache\\{"), F.substring(h, 1, 8), F.lit("-abcd-4abc-8abc-"),
                         F.substring(h, 9, 12), F.lit("}\\"), cls, F.lit(".dat"))
    drop = F.to_json(F.struct(F.concat(F.lit("C:\\Temp\\"), cls, F.lit("_drop.bin")).alias("path"),
                              F.col("k").alias("size")))
    files = _append(F.to_json(F.concat(paths, F.array(guid_path))), F.concat(drop, F.lit(","), k))
    keys = F.to_json(F.array(F.concat(F.lit("HKLM\\Software\\Microsoft\\"), et, F.lit("\\S-1-5-21-"), uid,
                                      F.lit("\\Run"))))
    mutexes = F.when(et == "error", F.lit('"notalist"')).otherwise(F.to_json(F.array(
        F.concat(F.lit("Global\\"), cls, F.lit("_"), k),
        F.concat(F.lit("Local\\"), F.substring(F.md5(uid), 1, 10)))))
    cmds = F.to_json(F.array(F.concat(F.lit("  CMD.exe /c "), et, F.lit(" --sig"))))
    svcs = F.to_json(F.array(F.concat(F.lit(" Svc"), uid, F.lit(" "))))
    doms = F.to_json(F.array(F.concat(F.lit("update."), et, F.lit(".example.com"))))
    pe = F.when(et == "signup", F.lit("null")).otherwise(F.concat(
        F.lit('{"timestamp":'), F.col("value").cast("string"),
        F.lit(',"imagebase":4194304,"entrypoint":"0x1","sections":[{"entropy":'),
        (F.col("value") / 100).cast("string"), F.lit(',"size_of_data":'), (F.col("k") % 3).cast("string"),
        F.lit(',"virtual_size":'), k,
        F.lit('},{"entropy":1.5,"size_of_data":512,"virtual_size":0},"bad"],'
              '"imports":[{"imports":["a","b"]},{"imports":"x"},{"dll":"k"}],"exports":'),
        F.when(F.col("k") % 2 == 0, F.lit('["f1"]')).otherwise(F.lit('"none"')), F.lit("}")))
    doc = F.concat(
        F.lit('{"behavior":{"summary":{"resolved_apis":'), apis, F.lit(',"files":'), files,
        F.lit(',"keys":'), keys, F.lit(',"mutexes":'), mutexes, F.lit(',"executed_commands":'), cmds,
        F.lit(',"started_services":'), svcs, F.lit(',"created_services":null,"domains":'), doms,
        F.lit('}},"static":{"pe":'), pe, F.lit("}}"))
    doc = F.when(F.col("event_id") % 50 == 7, F.substring(doc, 1, 40)).otherwise(doc)
    return e.select(F.col("event_id").alias("sample_id"), doc.alias("text"))


def parsed(spark, d, on_malformed="empty"):
    r = event_reports(spark, d).withColumn("report", rpt.parse("text"))
    if on_malformed == "null":
        return r
    if on_malformed == "drop":
        return r.where(F.col("report").isNotNull())
    return r.withColumn("report", F.coalesce("report", F.parse_json(F.lit("{}"))))


# ------------------------------------------------------------------ oracle side

BASE_SQL = f"""
WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
ev AS (SELECT *, {_CLS_SQL}[(user_id + k) % 10 + 1] AS cls, (event_id % 50 = 7) AS malformed,
              user_id % 3 + 1 AS n_files FROM e)
"""


@register("report_counts", BASE_SQL + """
SELECT event_id AS sample_id,
       CASE WHEN malformed THEN 0 ELSE n_files + 3 END AS count_files,
       CAST(0 AS BIGINT) AS count_read_files,
       CASE WHEN malformed THEN 0 ELSE 1 END AS count_keys,
       CASE WHEN malformed OR event_type = 'error' THEN 0 ELSE 2 END AS count_mutexes,
       CASE WHEN malformed THEN 0 ELSE 1 END AS count_executed_commands,
       CASE WHEN malformed THEN 0 ELSE 5 END AS count_resolved_apis,
       CASE WHEN malformed THEN 0 ELSE 1 END AS count_started_services,
       CAST(0 AS BIGINT) AS count_created_services
FROM ev
""")
def report_counts(spark, d):
    """F14, SC3 (malformed -> empty report): list lengths, 0 when not a list."""
    r = parsed(spark, d)
    cols = ["files", "read_files", "keys", "mutexes", "executed_commands", "resolved_apis",
            "started_services", "created_services"]
    return r.select("sample_id", *rpt.list_counts("report", cols))


def _api_sql():
    toks = [f"'kernel32.dll.' || event_type", "'advapi32.' || lower(event_type) || 'w'",
            S.remove_terms("'ntdll.' || cls || '.init'"), "'kernel32.dll.createremotethread'"]
    return " || ' ' || ".join(toks)


@register("report_api_tokens", BASE_SQL + f"""
SELECT event_id AS sample_id, CASE WHEN malformed THEN '' ELSE {_api_sql()} END AS api_text FROM ev
""")
def report_api_tokens(spark, d):
    """API tokens (strings only, lower, strip, class names removed)."""
    r = parsed(spark, d)
    return r.select("sample_id", F.array_join(rpt.api_tokens("report"), " ").alias("api_text"))


@register("report_api_raw", BASE_SQL + """
SELECT event_id AS sample_id,
       CASE WHEN malformed THEN '' ELSE 'kernel32.dll.' || event_type || ' advapi32.' || lower(event_type)
            || 'w  ntdll.' || cls || '.init  kernel32.dll.createremotethread' END AS api_text FROM ev
""")
def report_api_raw(spark, d):
    """API text without term removal or stripping (walk-forward variant)."""
    r = parsed(spark, d)
    return r.select("sample_id", F.array_join(rpt.api_tokens("report", terms=None, strip_first=False), " ")
                    .alias("api_text"))


def _api_artifact_sql(filtered: bool):
    clean = (lambda x: S.remove_terms(f"lower({x})")) if filtered else (lambda x: S.strip(f"lower({x})"))
    art = lambda x: f"'ART:' || {clean(x)}[1:80]"
    api = _api_sql() if filtered else (
        "'kernel32.dll.' || event_type || ' advapi32.' || lower(event_type) || 'w ntdll.' || cls "
        "|| '.init kernel32.dll.createremotethread'")
    path = "'C:\\Users\\U' || user_id || '\\AppData\\Temp\\T' || k || '\\' || event_type || i || '.EXE'"
    guid = ("'D:\\Cache\\{' || md5(CAST(event_id AS VARCHAR))[1:8] || '-abcd-4abc-8abc-' || "
            "md5(CAST(event_id AS VARCHAR))[9:20] || '}\\' || cls || '.dat'")
    mutexes = (f"CASE WHEN event_type = 'error' THEN [] ELSE [{art("'Global' || chr(92) || cls || '_' || k")}, "
               f"{art("'Local' || chr(92) || md5(CAST(user_id AS VARCHAR))[1:10]")}] END")
    files = f"list_concat(list_transform(range(1, n_files + 1), lambda i: {art(path)}), [{art(guid)}])"
    return f"array_to_string(list_concat([{api}], {mutexes}, {files}), ' ')"


@register("report_api_artifacts", BASE_SQL + f"""
SELECT event_id AS sample_id, CASE WHEN malformed THEN '' ELSE {_api_artifact_sql(True)} END AS filtered,
       CASE WHEN malformed THEN '' ELSE {_api_artifact_sql(False)} END AS unfiltered FROM ev
""")
def report_api_artifacts(spark, d):
    """API and ``ART:`` tokens, with and without removal of class names."""
    r = parsed(spark, d)
    return r.select("sample_id", F.array_join(rpt.api_artifact_tokens("report"), " ").alias("filtered"),
                    F.array_join(rpt.api_artifact_tokens("report", None), " ").alias("unfiltered"))


def _artifact_sql():
    path = ("'C:\\Users\\U' || user_id || '\\AppData\\Temp\\T' || k || '\\' || event_type || i || '.EXE'")
    file_norm = S.remove_terms(S.normalise_path(path))
    file_toks = (f"list_transform(range(1, n_files + 1), lambda i: ['FILE_EXT:' || "
                 f"{S.extension(S.base_name(file_norm))}, 'FILE:' || {S.base_name(file_norm)}[1:80]])")
    guid_path = ("'D:\\Cache\\{' || md5(CAST(event_id AS VARCHAR))[1:8] || '-abcd-4abc-8abc-' || "
                 "md5(CAST(event_id AS VARCHAR))[9:20] || '}\\' || cls || '.dat'")
    gnorm = S.remove_terms(S.normalise_path(guid_path))
    gname = S.base_name(gnorm)
    guid_toks = f"[{'CASE WHEN strpos(' + gname + ', chr(46)) > 0 THEN ' + chr(39) + 'FILE_EXT:' + chr(39) + ' || ' + S.extension(gname) + ' END'}, 'FILE:' || {gname}[1:80]]"
    key = "'HKLM\\Software\\Microsoft\\' || event_type || '\\S-1-5-21-' || user_id || '\\Run'"
    reg = f"['REG:' || {S.remove_terms(S.normalise_registry(key))}]"
    mut = (f"CASE WHEN event_type = 'error' THEN [] ELSE "
           f"['MUTEX:' || {S.remove_terms(S.normalise_mutex(chr(39) + 'Global' + chr(92) + chr(39) + ' || cls || ' + chr(39) + '_' + chr(39) + ' || k'))}, "
           f"'MUTEX:' || {S.remove_terms(S.normalise_mutex(chr(39) + 'Local' + chr(92) + chr(39) + ' || md5(CAST(user_id AS VARCHAR))[1:10]'))}] END")
    cmd = f"['CMD:' || {S.remove_terms(S.command_head(chr(39) + '  CMD.exe /c ' + chr(39) + ' || event_type'))}[1:80]]"
    svc = f"['SVC:' || {S.remove_terms(S.strip('lower(' + chr(39) + ' Svc' + chr(39) + ' || user_id || ' + chr(39) + ' ' + chr(39) + ')'))}[1:80]]"
    allt = (f"list_concat(flatten({file_toks}), {guid_toks}, {reg}, {mut}, {cmd}, {svc})")
    return f"array_to_string(list_filter({allt}, lambda t: t IS NOT NULL)[1:400], ' ')"


@register("report_artifact_tokens", BASE_SQL + f"""
SELECT event_id AS sample_id, CASE WHEN malformed THEN '' ELSE {_artifact_sql()} END AS artifact_text FROM ev
""")
def report_artifact_tokens(spark, d):
    """Namespaced artifact tokens (paths, registry, mutexes,
    commands, services), first 400 kept."""
    r = parsed(spark, d)
    return r.select("sample_id", F.array_join(rpt.artifact_tokens("report"), " ").alias("artifact_text"))


@register("report_pe", BASE_SQL + """
, pe AS (SELECT event_id, malformed, (NOT malformed AND event_type = 'signup') AS pe_null,
                value, value / 100 AS e1,
                CASE WHEN k % 3 = 0 THEN k ELSE k % 3 END AS s1, k
         FROM ev)
SELECT event_id AS sample_id,
       CASE WHEN malformed OR pe_null THEN NULL ELSE value END AS pe_timestamp,
       CASE WHEN malformed OR pe_null THEN NULL ELSE 4194304.0 END AS pe_imagebase,
       CAST(NULL AS DOUBLE) AS pe_entrypoint,
       CASE WHEN pe_null THEN NULL WHEN malformed THEN 0.0 ELSE 3.0 END AS pe_n_sections,
       CASE WHEN malformed OR pe_null THEN NULL ELSE round((e1 + 1.5) / 2, 6) END AS pe_mean_entropy,
       CASE WHEN malformed OR pe_null THEN NULL ELSE greatest(e1, 1.5) END AS pe_max_entropy,
       CASE WHEN malformed OR pe_null THEN NULL ELSE round(abs(e1 - 1.5) / 2, 6) END AS pe_std_entropy,
       CASE WHEN malformed OR pe_null THEN NULL ELSE s1 + 512.0 END AS pe_total_size,
       CASE WHEN pe_null THEN NULL WHEN malformed THEN 0.0 ELSE 3.0 END AS pe_n_import_dlls,
       CASE WHEN pe_null THEN NULL WHEN malformed THEN 0.0 ELSE 2.0 END AS pe_n_import_funcs,
       CASE WHEN pe_null THEN NULL WHEN malformed THEN 0.0 WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END AS pe_n_exports
FROM pe
""")
def report_pe(spark, d):
    """F15, AG34: PE numeric features (typed guards, size fallback, population std)."""
    r = parsed(spark, d)
    return r6(r.select("sample_id", *rpt.pe_features("report")))


def _audit_strings_sql():
    path = ("'C:\\Users\\U' || user_id || '\\AppData\\Temp\\T' || k || '\\' || event_type || i || '.EXE'")
    guid_path = ("'D:\\Cache\\{' || md5(CAST(event_id AS VARCHAR))[1:8] || '-abcd-4abc-8abc-' || "
                 "md5(CAST(event_id AS VARCHAR))[9:20] || '}\\' || cls || '.dat'")
    return f"""
, strs AS (
  SELECT event_id, 'resolved_apis' AS field, unnest(['kernel32.dll.' || event_type,
         'Advapi32.' || upper(event_type) || 'W', ' ntdll.' || cls || '.Init ',
         'kernel32.dll.CreateRemoteThread']) AS value FROM ev WHERE NOT malformed
  UNION ALL SELECT event_id, 'files', unnest(list_concat(list_transform(range(1, n_files + 1), lambda i: {path}),
         [{guid_path}, 'C:\\Temp\\' || cls || '_drop.bin'])) FROM ev WHERE NOT malformed
  UNION ALL SELECT event_id, 'keys', 'HKLM\\Software\\Microsoft\\' || event_type || '\\S-1-5-21-' || user_id || '\\Run'
         FROM ev WHERE NOT malformed
  UNION ALL SELECT event_id, 'mutexes', unnest(['Global\\' || cls || '_' || k,
         'Local\\' || md5(CAST(user_id AS VARCHAR))[1:10]]) FROM ev WHERE NOT malformed AND event_type <> 'error'
  UNION ALL SELECT event_id, 'executed_commands', '  CMD.exe /c ' || event_type || ' --sig' FROM ev WHERE NOT malformed
  UNION ALL SELECT event_id, 'started_services', ' Svc' || user_id || ' ' FROM ev WHERE NOT malformed
  UNION ALL SELECT event_id, 'domains', 'update.' || event_type || '.example.com' FROM ev WHERE NOT malformed),
segs AS (SELECT *, list_distinct(regexp_extract_all(lower(value), '[a-z0-9]+')) AS s FROM strs),
vocab(term, match_type) AS (VALUES {", ".join(f"({S.q(t)}, 'family_name')" for t in config.CLASS_NAMES)},
                                   {", ".join(f"({S.q(t)}, 'detection_indicator')" for t in config.DETECTION_TERMS)}),
hits AS (SELECT event_id, field, value, v.match_type, v.term AS matched_term
         FROM segs JOIN vocab v ON list_contains(segs.s, v.term))
"""


@register("report_audit_terms", BASE_SQL + _audit_strings_sql() + """
SELECT match_type, matched_term, count(*) AS n_hits, count(DISTINCT event_id) AS n_samples
FROM hits GROUP BY ALL
""")
def report_audit_terms(spark, d):
    """F12, F13, SC3 (audit drops malformed reports): hits over all audited fields."""
    # a malformed (NULL) report yields no strings, so no filter is needed here —
    # filtering would be pushed below the parse and run try_parse_json twice
    hits = audit.scan_reports(parsed(spark, d, "null"))
    return audit.by_term(hits)


@register("report_audit_summary", BASE_SQL + _audit_strings_sql() + """
SELECT (SELECT count(*) FROM ev WHERE NOT malformed) AS n_scanned, (SELECT count(*) FROM hits) AS n_total_hits,
       (SELECT count(DISTINCT event_id) FROM hits) AS n_flagged_samples,
       round((SELECT count(DISTINCT event_id) FROM hits) / (SELECT count(*) FROM ev WHERE NOT malformed), 6)
       AS hit_rate
""")
def report_audit_summary(spark, d):
    """AG2 on reports: malformed reports are neither scanned nor counted."""
    hits = audit.scan_reports(parsed(spark, d, "null"))  # NULL reports give no hits
    return r6(audit.summarise(hits, parsed(spark, d, "drop").select("sample_id")))


# ------------------------------------------------------------------ URL strings (pages)

PAGE_TERMS = ["example", "blog", "www"]


@register("url_normalise", f"""
SELECT page_id, {S.normalise_path('url')} AS path_norm, {S.normalise_registry('url')} AS reg_norm,
       {S.normalise_mutex('url')} AS mutex_norm, {S.base_name(S.normalise_path('url'))} AS base_name,
       {S.extension(S.base_name(S.normalise_path('url')))} AS extension,
       {S.command_head('url')} AS command_head,
       {S.remove_terms('url', PAGE_TERMS)} AS without_terms,
       list_distinct(regexp_extract_all(lower(coalesce(url, '')), '[a-z0-9]+')) IS NOT NULL AS has_segments,
       len(list_distinct(regexp_extract_all(lower(coalesce(url, '')), '[a-z0-9]+'))) AS n_segments
FROM pages
""")
def url_normalise(spark, d):
    """F1–F7 on real strings: path / registry / mutex normalisation, base name,
    extension, command head, exact-segment term removal, segment count."""
    p = table(spark, d, "pages")
    pn = text.normalise_path("url")
    return p.select("page_id", pn.alias("path_norm"), text.normalise_registry("url").alias("reg_norm"),
                    text.normalise_mutex("url").alias("mutex_norm"), text.base_name(pn).alias("base_name"),
                    text.extension(text.base_name(pn)).alias("extension"),
                    text.command_head("url").alias("command_head"),
                    text.remove_terms("url", PAGE_TERMS).alias("without_terms"),
                    text.segments("url").isNotNull().alias("has_segments"),
                    F.size(text.segments("url")).cast("long").alias("n_segments"))


@register("html_hex_masks", f"""
SELECT page_id, {S.normalise_mutex('html')} AS masked,
       len(regexp_extract_all(lower(html), {S.q(config.HEX_PATTERN)})) AS n_hex
FROM pages
""")
def html_hex_masks(spark, d):
    """F5 on whole page texts: GUID and long-hex masking."""
    p = table(spark, d, "pages")
    return p.select("page_id", text.normalise_mutex("html").alias("masked"),
                    F.size(F.regexp_extract_all(F.lower("html"), F.lit(config.HEX_PATTERN), 0))
                    .cast("long").alias("n_hex"))
