"""Quality rules with risk-controlled thresholds.

``features`` measures every whole text in one vectorised pass without a shuffle.
``choose_cutoffs`` calibrates one cutoff for each stratum and signal on labelled
rows: walking from the mildest cutoff of a fixed grid to the strictest, a cutoff is
certified while the exact binomial (Clopper-Pearson) test rejects "good documents
are rejected more often than ``risk``".  Walking a fixed order and stopping at the
first failure keeps the error of one walk at its own level (fixed-sequence testing);
the level is ``delta`` divided by the number of walks (Bonferroni over strata and
signals), and the risk is divided by the number of signals, so that with confidence
1 - delta no stratum loses more than ``risk`` of its good documents to the method's
rules.  Among certified cutoffs the one with the best gain is taken: rejected bad
rows less ``good_cost`` times rejected good rows; without gain there is no rule.

The counts behind the tests are grouped sums over all distinct labelled texts (strata x
signals x grid x 2 numbers), never a sample: copies of one text are no new evidence.

Edge cases: a null or empty text has all counts 0 and fails the base rule; a null
stratum is a stratum of its own; a stratum without labels has no cutoffs, so only
the base rule applies; equal texts count once a stratum and are good if any label says
so (near copies still count one by one; ties do not change a cutoff: the mildest of
equal gain wins); empty tables
give empty results; columns of ``docs`` other than the named ones pass through
``features`` only if listed in ``keep``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .text import SEPARATOR, mix, slices, window_hashes

BASE_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE_COUNTS = ["n_chars_total", "n_upper", "n_letters", "n_pipes", "n_bangs"]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True

#: signal -> (numerator, denominator); a document is rejected at or above a cutoff.
SIGNALS = {
    "symbols_per_char": ("n_symbols", "n_chars_total"),
    "dup_line_words": ("n_dup_lines", "n_words"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "upper_letters": ("n_upper", "n_letters"),
    "bangs_per_word": ("n_bangs", "n_words"),
    "pipes_per_word": ("n_pipes", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
}
#: Strict to mild cutoffs of a signal: ratios between 0.01 and 1, and word lengths.
RATIO_GRID = [round(0.01 * 1.25 ** i, 4) for i in range(21)]
GRID = {s: RATIO_GRID for s in SIGNALS} | {"chars_per_word": [float(x) for x in range(6, 31)]}


def _count(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key, whether it occurs twice or more, and whether an earlier one is equal."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def measure(column: pa.Array) -> pd.DataFrame:
    """The counts of every text of a batch."""
    parts = []
    for t in slices(column):
        start, end, woff = t.words()
        n_words = np.diff(woff)
        points = (t.buf & 0xC0) != 0x80
        salt = mix(np.arange(t.n, dtype=np.uint64) + np.uint64(1))
        windows, offsets = window_hashes(t.span_hashes(start, end), woff, 3)
        twice, _ = _repeats(windows ^ np.repeat(salt, np.diff(offsets)))
        covered = np.zeros(len(start) + 3, bool)
        first = np.repeat(woff[:-1] - offsets[:-1], np.diff(offsets)) + np.arange(len(windows))
        for j in range(3):
            covered[first[twice] + j] = True
        # lines: split at \n and at the ends of documents, with at least one word
        breaks = np.flatnonzero(t.buf == 10)
        line_start = np.union1d(t.off[:-1], breaks + 1)
        line_start = line_start[line_start < len(t.buf)]
        line_end = np.append(line_start, len(t.buf))[1:]
        stop = line_end - (t.buf[line_end - 1] == 10)
        doc = np.searchsorted(t.off, line_start, "right") - 1
        words_in = np.searchsorted(start, stop) - np.searchsorted(start, line_start)
        line_start, stop, doc = (x[words_in > 0] for x in (line_start, stop, doc))
        _, later = _repeats(t.span_hashes(line_start, stop) ^ salt[doc])
        parts.append(pd.DataFrame({
            "n_words": n_words,
            "word_chars": _count(points & ~SEPARATOR[t.buf], t.off),
            "n_symbols": _count(SYMBOLS[t.buf], t.off),
            "n_dup_lines": np.bincount(doc[later], minlength=t.n),
            "n_repeat_words": _count(covered[: len(start)], woff),
            "n_chars_total": _count(points, t.off),
            "n_upper": _count(UPPER[t.buf], t.off),
            "n_letters": _count(LETTER[t.buf], t.off),
            "n_pipes": _count(t.buf == 124, t.off),
            "n_bangs": _count(t.buf == 33, t.off),
        }))
    return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in BASE_COUNTS + MORE_COUNTS})


def features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``__digest`` (64 bits of the text) and the counts of every whole text."""
    cols = BASE_COUNTS + MORE_COUNTS
    own = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
                      F.xxhash64(text_col).alias(f"k{len(keep)}"), F.col(text_col).alias("t"))
    keep = [*keep, "__digest"]

    def run(batches):
        for b in batches:
            m = measure(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], *[pa.array(m[c].to_numpy(np.int64)) for c in cols]],
                names=[*[f"k{i}" for i in range(len(keep))], *cols])

    kinds = ", ".join([*[f"k{i} {own.schema[i].dataType.simpleString()}" for i in range(len(keep))],
                       *[f"{c} long" for c in cols]])
    out = own.mapInArrow(run, kinds)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *cols)


def base_failed(f: DataFrame) -> DataFrame:
    return f.withColumn("base_failed", (F.col("n_words") < 50)
                        | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _signal(name: str):
    num, den = SIGNALS[name]
    return F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(F.lit(0.0))


def _level(name: str):
    """How many cutoffs of the grid the signal reaches (0: none)."""
    return sum((_signal(name) >= F.lit(c)).cast("int") for c in GRID[name])


def _log_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
            + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certified(rejected: int, n: int, risk: float, level: float) -> bool:
    """Whether the Clopper-Pearson upper bound at ``level`` is at most ``risk``:
    ``rejected`` or fewer rejections would have a chance of at most ``level``."""
    if not n or rejected > risk * n:
        return False
    return _log_tail(rejected, n, risk) <= level


def walk(good: list[int], bad: list[int], n_good: int, risk: float, level: float,
         good_cost: float) -> int | None:
    """Index of the chosen cutoff; ``good[i]``: good rows at or above cutoff i, mild
    cutoffs last.  None: nothing certified has a gain."""
    best, gain = None, 0.0
    for i in reversed(range(len(good))):
        if not certified(good[i], n_good, risk, level):
            break
        if bad[i] - good_cost * good[i] > gain:
            best, gain = i, bad[i] - good_cost * good[i]
    return best


def choose_cutoffs(f: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   stratum: str = "lang", label_col: str = "quality", risk: float = 0.05,
                   delta: float = 0.05, good_cost: float = 20.0) -> DataFrame:
    """One row for each stratum and signal with a rule: ``stratum, signal, cutoff``.
    Calibrated on labelled rows that pass the base rule: the method's rules decide
    only those.  The bounds need independent rows, so a text counts once a stratum, however
    many ids or labels hold it (``__digest`` and all its counts name it); it is
    good if any of its labels is."""
    lab = labels.select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).alias("__good")) \
        .where("__good is not null")
    rows = f.where(~F.col("base_failed")).select(
        F.col(id_col).alias("__id"), F.col(stratum).cast("string").alias("stratum"), "__digest",
        *BASE_COUNTS, *MORE_COUNTS).join(lab, "__id") \
        .groupBy("stratum", "__digest", *BASE_COUNTS, *MORE_COUNTS).agg(F.max("__good").alias("__good")) \
        .select("stratum", "__good", *[_level(s).alias(s) for s in SIGNALS])
    counts = rows.select("stratum", "__good", F.explode(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(s).alias("level")) for s in SIGNALS])).alias("x")) \
        .groupBy("stratum", "x.signal", "x.level").agg(
            F.count_if("__good").alias("good"), F.count_if(~F.col("__good")).alias("bad"))
    counts = Scratch(f.sparkSession, "quality").put(counts, "counts")  # strata x signals x grid
    level = delta / len(SIGNALS) / max(1, counts.select("stratum").distinct().count())
    own_risk = risk / len(SIGNALS)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        signal, grid = pdf["signal"].iloc[0], GRID[pdf["signal"].iloc[0]]
        at = {c: np.bincount(pdf["level"], pdf[c], len(grid) + 1) for c in ("good", "bad")}
        reach = {c: np.cumsum(v[::-1])[::-1][1:].astype(int).tolist() for c, v in at.items()}
        i = walk(reach["good"], reach["bad"], int(at["good"].sum()), own_risk, level, good_cost)
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "signal": [signal],
                             "cutoff": [math.nan if i is None else grid[i]]})

    picked = counts.groupBy("stratum", "signal").applyInPandas(pick, "stratum string, signal string, cutoff double")
    return picked.where(F.col("cutoff").isNotNull() & ~F.isnan("cutoff"))


def judge(f: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``kept`` and ``rules`` (the signals that rejected the row)."""
    by = cutoffs.groupBy("stratum").agg(F.map_from_entries(
        F.collect_list(F.struct("signal", "cutoff"))).alias("__cut"))  # at most one entry a signal
    key = F.col(stratum).cast("string")
    out = f.join(by, key.eqNullSafe(by["stratum"]), "left").drop(by["stratum"])
    rules = F.filter(F.array(*[F.when(_signal(s) >= F.element_at("__cut", F.lit(s)), F.lit(s))
                               for s in SIGNALS]), lambda x: x.isNotNull())
    return out.withColumn("rules", rules) \
        .withColumn("kept", ~F.col("base_failed") & (F.size("rules") == 0)).drop("__cut")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            stratum: str = "lang", **options) -> DataFrame:
    """One row per row of ``docs``: id, counts, ``base_failed``, ``rules``, ``kept``."""
    f = base_failed(features(docs, [id_col, stratum], text_col))
    return judge(f, choose_cutoffs(f, labels, id_col, stratum, **options), stratum).drop("__digest")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stratum: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.  The decision is taken
    row by row beside the row's own columns, so texts are not shuffled."""
    base = [c for c in docs.columns]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in base]).alias("row"), F.col(id_col).alias("__id"),
                      F.col(stratum).alias("__stratum"), F.col(text_col).alias("__text"))
    counted = base_failed(features(own, ["__id", "__stratum"], "__text"))
    cutoffs = choose_cutoffs(counted, labels.select(F.col(id_col).alias("__id"), "quality"), "__id",
                             "__stratum", **options)
    f = base_failed(features(own, ["row", "__stratum"], "__text"))
    return judge(f, cutoffs, "__stratum").where("kept").select("row.*")
