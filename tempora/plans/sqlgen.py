"""DuckDB spellings of the text functions, used only to build oracle SQL.

They restate the semantics in another engine's dialect (DuckDB's RE2 has no
look-around, so term removal splits on alphanumeric runs instead)."""

from __future__ import annotations

from .. import config


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def remove_terms(x: str, terms=config.CLASS_NAMES) -> str:
    in_list = ", ".join(q(t.lower()) for t in terms)
    parts = f"string_split(regexp_replace({x}, '([A-Za-z0-9]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return strip(f"array_to_string(list_transform({parts}, lambda p: CASE WHEN lower(p) IN ({in_list}) "
                 f"THEN '' ELSE p END), '')")


def mask_ids(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, {q(config.GUID_PATTERN)}, '<guid>', 'g'), "
            f"{q(config.HEX_PATTERN)}, '<hex>', 'g')")


def normalise_path(x: str) -> str:
    s = f"replace(lower({x}), '\\', '/')"
    s = f"regexp_replace({s}, 'c:/users/[^/]+', 'c:/users/<user>', 'g')"
    s = f"regexp_replace({s}, '/temp/[^/]+', '/temp/<tmp>', 'g')"
    return mask_ids(s)


def normalise_registry(x: str) -> str:
    s = f"replace(lower({x}), '\\', '/')"
    s = f"regexp_replace({s}, {q(config.GUID_PATTERN)}, '<guid>', 'g')"
    s = f"regexp_replace({s}, '/s-1-[0-9-]+', '/<sid>', 'g')"
    return f"array_to_string(string_split({s}, '/')[1:4], '/')"


def normalise_mutex(x: str) -> str:
    return mask_ids(f"lower({x})")


def base_name(x: str) -> str:
    return f"string_split({x}, '/')[-1]"


def extension(name: str) -> str:
    return f"CASE WHEN strpos({name}, '.') > 0 THEN string_split({name}, '.')[-1] END"


def command_head(x: str) -> str:
    return f"string_split(regexp_replace(lower({x}), '^\\s+', ''), ' ')[1]"
