"""Typed access to schemaless nested JSON reports through VARIANT.

A report is ``{behavior: {summary: {<field>: [string | object, ...]}},
static: {pe: {...}}}``; any level may be missing or of the wrong type.  Every
accessor returns NULL/empty instead of failing, guarded by
``schema_of_variant`` so numbers are never read from strings and vice versa.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .text import (command_head, file_tokens, normalise_mutex, normalise_registry,
                   remove_terms, strip)

SUMMARY = "$.behavior.summary"
_NUM = ("schema_of_variant({x}) IN ('BIGINT','INT','SMALLINT','TINYINT','DOUBLE','FLOAT') "
        "OR schema_of_variant({x}) LIKE 'DECIMAL%'")


def _is_num(x: str) -> str:
    return "(" + _NUM.format(x=x) + ")"


def parse(text: str | Column) -> Column:
    """``try_parse_json``: malformed text -> NULL."""
    return F.try_parse_json(F.col(text) if isinstance(text, str) else text)


def field_list(v: str, field: str, root: str = SUMMARY) -> Column:
    """``array<variant>`` of a summary field; NULL if missing or not a list."""
    return F.expr(f"try_variant_get({v}, '{root}.{field}', 'array<variant>')")


def _strings_sql(v: str, field: str, with_dict_values: bool) -> str:
    arr = f"try_variant_get({v}, '{SUMMARY}.{field}', 'array<variant>')"
    as_str = "CASE WHEN schema_of_variant({e}) = 'STRING' THEN variant_get({e}, '$', 'string') END"
    if not with_dict_values:
        return (f"filter(transform(coalesce({arr}, array()), e -> {as_str.format(e='e')}), "
                f"s -> s IS NOT NULL)")
    dict_vals = (f"filter(transform(coalesce(map_values(try_variant_get(e, '$', "
                 f"'map<string,variant>')), array()), d -> {as_str.format(e='d')}), "
                 f"s -> s IS NOT NULL)")
    return (f"flatten(transform(coalesce({arr}, array()), e -> CASE "
            f"WHEN schema_of_variant(e) = 'STRING' THEN array(variant_get(e, '$', 'string')) "
            f"WHEN schema_of_variant(e) LIKE 'OBJECT%' THEN {dict_vals} "
            f"ELSE cast(array() AS array<string>) END))")


def string_items(v: str, field: str) -> Column:
    """String elements of a summary list (other element types skipped)."""
    return F.expr(_strings_sql(v, field, with_dict_values=False))


def report_strings(v: str, fields: Sequence[str] = config.AUDIT_FIELDS) -> Column:
    """``array<struct<field, value>>``: string elements and the string values of
    object elements of each field, field by field, in list order."""
    parts = [f"transform({_strings_sql(v, f, True)}, s -> named_struct('field', '{f}', "
             f"'value', s))" for f in fields]
    return F.expr("concat(" + ", ".join(parts) + ")")


def list_counts(v: str, fields: Sequence[str] = config.FEATURE_FIELDS) -> list[Column]:
    """``count_<field>``: list length, 0 when missing or not a list."""
    return [F.coalesce(F.size(field_list(v, f)), F.lit(0)).cast("long").alias(f"count_{f}")
            for f in fields]


def api_tokens(v: str, terms: Sequence[str] | None = config.CLASS_NAMES,
               strip_first: bool = True) -> Column:
    """Resolved API names: strings only, lower-cased, stripped, class-name runs
    removed, empties dropped.  ``terms=None, strip_first=False`` is the raw variant
    (lower-cased only)."""
    items = string_items(v, "resolved_apis")

    def norm(s: Column) -> Column:
        t = F.lower(s)
        if strip_first:
            t = strip(t)
        if terms is not None:
            t = remove_terms(t, terms)
        return t

    toks = F.transform(items, norm)
    return F.filter(toks, lambda t: t != "") if terms is not None or strip_first else toks


ART_FIELDS = ("mutexes", "files", "write_files")


def api_artifact_tokens(v: str, terms: Sequence[str] | None = config.CLASS_NAMES) -> Column:
    """API tokens, then the strings of ``ART_FIELDS`` lower-cased as ``ART:<value, 80
    chars>``; class-name runs are removed from both unless ``terms`` is None."""
    def clean(s: Column) -> Column:
        return remove_terms(F.lower(s), terms) if terms is not None else strip(F.lower(s))

    arts = [F.transform(F.filter(F.transform(string_items(v, f), clean), lambda t: t != ""),
                        lambda t: F.concat(F.lit("ART:"), F.substring(t, 1, 80))) for f in ART_FIELDS]
    return F.concat(api_tokens(v, terms), *arts)


def artifact_tokens(v: str, terms: Sequence[str] | None = config.CLASS_NAMES,
                    cap: int = config.ARTIFACT_TOKEN_CAP) -> Column:
    """Namespaced artifact tokens FILE_EXT/FILE, REG, MUTEX, CMD, SVC in field
    order, first ``cap`` kept (the cap is the feature, applied before re-tokenising)."""
    def rm(c: Column) -> Column:
        return remove_terms(c, terms) if terms is not None else c

    parts = []
    for f in config.FILE_FIELDS:
        parts.append(F.flatten(F.transform(string_items(v, f), lambda s: file_tokens(s, terms))))
    for f in config.REGISTRY_FIELDS:
        parts.append(F.transform(string_items(v, f),
                                 lambda s: F.concat(F.lit("REG:"), rm(normalise_registry(s)))))
    parts.append(F.transform(string_items(v, "mutexes"),
                             lambda s: F.concat(F.lit("MUTEX:"), rm(normalise_mutex(s)))))
    parts.append(F.transform(string_items(v, "executed_commands"),
                             lambda s: F.concat(F.lit("CMD:"),
                                                F.substring(rm(command_head(s)), 1, 80))))
    for f in config.SERVICE_FIELDS:
        parts.append(F.transform(string_items(v, f),
                                 lambda s: F.concat(F.lit("SVC:"),
                                                    F.substring(rm(strip(F.lower(s))), 1, 80))))
    return F.slice(F.concat(*parts), 1, cap)


def pe_features(v: str) -> list[Column]:
    """The eleven ``pe_*`` numeric features; NULL where the report lacks them.
    Booleans are not numbers here."""
    pe = f"try_variant_get({v}, '$.static.pe', 'variant')"
    # a missing static.pe behaves as an empty object; JSON null or a non-object
    # yields no features at all
    is_obj = f"({pe} IS NULL OR coalesce(schema_of_variant({pe}) LIKE 'OBJECT%', false))"
    out = []
    for key in ("timestamp", "imagebase", "entrypoint"):
        x = f"try_variant_get({pe}, '$.{key}', 'variant')"
        out.append(F.expr(f"CASE WHEN {is_obj} AND {_is_num(x)} THEN "
                          f"try_variant_get({x}, '$', 'double') END").alias(f"pe_{key}"))
    secs = f"try_variant_get({pe}, '$.sections', 'array<variant>')"
    ent_x = "try_variant_get(s, '$.entropy', 'variant')"
    ents = (f"filter(transform(coalesce({secs}, array()), s -> CASE WHEN {_is_num(ent_x)} "
            f"THEN try_variant_get({ent_x}, '$', 'double') END), e -> e IS NOT NULL)")
    sod = "try_variant_get(s, '$.size_of_data', 'variant')"
    vsz = "try_variant_get(s, '$.virtual_size', 'variant')"
    # python truthiness of size_of_data decides whether virtual_size is used
    falsy = (f"({sod} IS NULL OR schema_of_variant({sod}) = 'VOID' "
             f"OR ({_is_num(sod)} AND try_variant_get({sod}, '$', 'double') = 0) "
             f"OR (schema_of_variant({sod}) = 'STRING' AND variant_get({sod}, '$', 'string') = '') "
             f"OR (schema_of_variant({sod}) = 'BOOLEAN' AND NOT variant_get({sod}, '$', 'boolean')) "
             f"OR coalesce(size(try_variant_get({sod}, '$', 'array<variant>')), -1) = 0 "
             f"OR coalesce(size(map_keys(try_variant_get({sod}, '$', 'map<string,variant>'))), -1) = 0)")
    size_one = (f"CASE WHEN {falsy} THEN (CASE WHEN {_is_num(vsz)} THEN "
                f"try_variant_get({vsz}, '$', 'double') END) "
                f"WHEN {_is_num(sod)} THEN try_variant_get({sod}, '$', 'double') END")
    sizes = f"filter(transform(coalesce({secs}, array()), s -> {size_one}), x -> x IS NOT NULL)"
    ents_c, sizes_c = F.expr(ents), F.expr(sizes)
    n_ent = F.size(ents_c)
    mean = F.aggregate(ents_c, F.lit(0.0), lambda a, x: a + x) / n_ent
    # Welford's update: a mean taken outside the lambda would be evaluated again for
    # every section
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))
    var = F.aggregate(ents_c, start, lambda a, x: F.struct(
        (a["n"] + 1.0).alias("n"), (a["m"] + (x - a["m"]) / (a["n"] + 1.0)).alias("m"),
        (a["s"] + (x - a["m"]) * (x - a["m"]) * a["n"] / (a["n"] + 1.0)).alias("s")),
        lambda a: a["s"] / a["n"])
    pe_ok = F.expr(is_obj)
    secs_raw = f"try_variant_get({pe}, '$.sections', 'variant')"
    has_secs = pe_ok & F.expr(f"({secs_raw} IS NULL OR {secs} IS NOT NULL)")
    out.append(F.when(has_secs, F.coalesce(F.size(F.expr(secs)), F.lit(0)).cast("double"))
               .alias("pe_n_sections"))
    out.append(F.when(has_secs & (n_ent > 0), mean).alias("pe_mean_entropy"))
    out.append(F.when(has_secs & (n_ent > 0), F.array_max(ents_c)).alias("pe_max_entropy"))
    out.append(F.when(has_secs & (n_ent > 1), F.sqrt(var))
               .when(has_secs & (n_ent == 1), F.lit(0.0)).alias("pe_std_entropy"))
    out.append(F.when(has_secs & (F.size(sizes_c) > 0),
                      F.aggregate(sizes_c, F.lit(0.0), lambda a, x: a + x)).alias("pe_total_size"))
    imps = f"try_variant_get({pe}, '$.imports', 'array<variant>')"
    funcs = (f"aggregate(coalesce({imps}, array()), 0L, (acc, i) -> acc + coalesce("
             f"size(try_variant_get(i, '$.imports', 'array<variant>')), 0))")
    imps_raw = f"try_variant_get({pe}, '$.imports', 'variant')"
    has_imps = pe_ok & F.expr(f"({imps_raw} IS NULL OR {imps} IS NOT NULL)")
    out.append(F.when(has_imps, F.coalesce(F.size(F.expr(imps)), F.lit(0)).cast("double"))
               .alias("pe_n_import_dlls"))
    out.append(F.when(has_imps, F.expr(funcs).cast("double")).alias("pe_n_import_funcs"))
    exps = f"try_variant_get({pe}, '$.exports', 'array<variant>')"
    out.append(F.when(pe_ok, F.coalesce(F.size(F.expr(exps)), F.lit(0)).cast("double"))
               .alias("pe_n_exports"))
    return out
