"""String functions as Catalyst column expressions.

All of them run inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """Whitespace strip on both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def segments(x: str | Column) -> Column:
    """Distinct lower-cased maximal ASCII alphanumeric runs; NULL -> []."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("[a-z0-9]+"), 0))


def terms_pattern(terms: Iterable[str]) -> str:
    alts = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return f"(?i)(?<![A-Za-z0-9])(?:{alts})(?![A-Za-z0-9])"


def remove_terms(x: str | Column, terms: Iterable[str] = config.CLASS_NAMES) -> Column:
    """Delete alphanumeric runs exactly equal (case-insensitively) to a term,
    keep every separator, then strip.  ``createremotethread`` survives."""
    return strip(F.regexp_replace(F.coalesce(_c(x), F.lit("")), terms_pattern(terms), ""))


def mask_ids(s: Column, *, guid: bool = True, hex_: bool = True) -> Column:
    if guid:
        s = F.regexp_replace(s, config.GUID_PATTERN, "<guid>")
    if hex_:
        s = F.regexp_replace(s, config.HEX_PATTERN, "<hex>")
    return s


def normalise_path(x: str | Column) -> Column:
    """lower; backslash -> slash; user profile, temp dir, GUID, long hex masked
    (in this order)."""
    s = F.translate(F.lower(_c(x)), "\\", "/")
    s = F.regexp_replace(s, "c:/users/[^/]+", "c:/users/<user>")
    s = F.regexp_replace(s, "/temp/[^/]+", "/temp/<tmp>")
    return mask_ids(s)


def normalise_registry(x: str | Column) -> Column:
    """lower; slashes; GUID and SID masked; hive plus three levels."""
    s = F.translate(F.lower(_c(x)), "\\", "/")
    s = F.regexp_replace(s, config.GUID_PATTERN, "<guid>")
    s = F.regexp_replace(s, "/s-1-[0-9-]+", "/<sid>")
    return F.array_join(F.slice(F.split(s, "/", -1), 1, 4), "/")


def normalise_mutex(x: str | Column) -> Column:
    return mask_ids(F.lower(_c(x)))


def base_name(normed: Column) -> Column:
    """Text after the last slash (the whole string when there is none)."""
    return F.element_at(F.split(normed, "/", -1), -1)


def extension(name: Column) -> Column:
    """Text after the last dot; NULL when the name has no dot."""
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1))


def command_head(x: str | Column) -> Column:
    """First whitespace-separated word of the lower-cased command."""
    low = F.lower(_c(x))
    return F.element_at(F.split(F.regexp_replace(low, r"^\s+", ""), r"\s+", -1), 1)


def file_tokens(x: str | Column, terms: Iterable[str] | None = config.CLASS_NAMES) -> Column:
    """``[FILE_EXT:<ext>,] FILE:<base name, 80 chars>`` for one path."""
    normed = normalise_path(x)
    if terms is not None:
        normed = remove_terms(normed, terms)
    name = base_name(normed)
    ext = extension(name)
    file_tok = F.concat(F.lit("FILE:"), F.substring(name, 1, 80))
    return F.when(ext.isNotNull(), F.array(F.concat(F.lit("FILE_EXT:"), ext), file_tok)) \
        .otherwise(F.array(file_tok))


def words(x: str | Column) -> Column:
    """Lower-cased words: maximal runs of two or more Unicode letters,
    digits or underscores (the vectorizers' ``\\b\\w\\w+\\b`` rule written as a
    character-class run, which needs no word-boundary look-around)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))),
                                F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def ngrams(tokens: str | Column, lo: int = 1, hi: int = 2) -> Column:
    """Contiguous n-grams (space joined) for n in [lo, hi], unigrams first.

    Built from shifted slices combined with ``zip_with`` so the token array is
    evaluated once per n (a lambda indexing into ``tokens`` would re-evaluate
    the tokeniser for every position)."""
    t = _c(tokens)
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(t)
            continue
        length = F.greatest(F.size(t) - n + 1, F.lit(0))
        g = F.slice(t, 1, length)
        for k in range(1, n):
            g = F.zip_with(g, F.slice(t, k + 1, length), lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(g)
    return parts[0] if len(parts) == 1 else F.concat(*parts)
