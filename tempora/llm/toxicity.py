"""Toxicity by weak supervision.

Three steps.  (1) Voters: fixed lexicons and patterns, and lexicons mined from the
labelled learning rows - words and word beginnings, hashed to ``SLOTS`` slots, whose
odds of toxic rows are ``ODDS`` times the overall odds or more (an odds ratio, so that
signs pass at any overall share), dealt into ``MINED`` voters.  A
voter fires on a text or abstains; one more voter fires on texts without any mined
sign.  (2) A generative label model: latent class with one firing rate a voter and
class, fitted by expectation maximisation over the counts of firing patterns of all
learning rows, labelled rows being held to their label.  Voters that fire together
more often than their classes explain are discounted by the correlations found within
the classes.  (3) A linear classifier (logistic regression over the presence of mined
signs and fixed voters) is trained on the posterior labels of a bounded sample of
learning rows, about ``SAMPLE`` rows by hash of the id, and scores every whole text.

Learning rows are those with crc32(id as text) mod 3 not 1; labels of the others are
never read.  Statistics (sign counts, firing patterns) cover all learning rows; only
the classifier's fit is on a sample.  Labels, language, source and id are no inputs of
a score.

Scale: every step is one pass over the texts without a shuffle of texts; sign counts
are summed in a task before they are shuffled (``SLOTS`` rows a task at most); the
driver holds the signs that pass (``SLOTS`` at most), 2^(voters) patterns and the sample.  Labels are
broadcast up to ``LABEL_ROWS`` rows; beyond that the same join shuffles.

Edge cases: null and empty texts have no sign and get the score of a text without
any; a null or repeated id is scored like others (null: a learning row without a
label); conflicting labels of one id: any toxic one counts; without labels, or with
labels of one class only, no sign is mined and the fixed voters decide; empty tables
give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Texts, mix, slices
from .decontam import PUNCTUATION

SLOTS, MINED, SAMPLE, LABEL_ROWS = 1 << 21, 8, 8_000, 2_000_000
SUPPORT, Z_LEAST, ODDS = 4, 4.0, 3.0

# Insults, by kind.
LEXICONS = {
    "mind": "idiot idiots idiotic moron morons moronic stupid dumb imbecile fool fools dumbass retard retarded",
    "worth": "scum trash garbage worthless loser losers pathetic useless filth filthy disgusting vermin pig pigs",
    "mockery": "clown clowns joke jerk creep freak liar coward hypocrite ugly disgrace sucker",
    "german": "idiot idioten dumm dummkopf trottel arschloch abschaum versager schwein widerlich",
    "french": "imbécile crétin connard salaud abruti débile ordure minable nul dégoûtant raté",
    "spanish": "idiota imbécil estúpido estúpida basura escoria payaso patético asqueroso inútil perdedor",
}
PATTERNS = ["shouting", "exclaiming"]
FIXED = [*LEXICONS, *PATTERNS]
VOTERS = [*FIXED, *[f"mined{i}" for i in range(MINED)], "no_sign"]
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def _hashes(words: str) -> np.ndarray:
    t = next(slices(pa.array([words])))
    start, end, _ = t.words()
    return np.unique(t.span_hashes(start, end, lower=True))


LEXICON_HASHES = {k: _hashes(w) for k, w in LEXICONS.items()}


def _bare_words(t: Texts):
    """Words without outer punctuation: starts, ends, document of each."""
    start, end, woff = t.words()
    for _ in range(3):
        start = start + ((start < end) & PUNCTUATION[t.buf[np.minimum(start, max(len(t.buf) - 1, 0))]])
        end = end - ((start < end) & PUNCTUATION[t.buf[end - 1]])
    doc = np.repeat(np.arange(t.n), np.diff(woff))
    keep = end > start
    return start[keep], end[keep], doc[keep]


def _signs(t: Texts, start, end, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and slots of all words and of their beginnings of 4 to 6 bytes;
    and the hashes of whole words."""
    whole = t.span_hashes(start, end, lower=True)
    docs, slots = [doc], [mix(whole) & np.uint64(SLOTS - 1)]
    for size in (4, 5, 6):
        longer = end - start > size
        h = t.span_hashes(start[longer], start[longer] + size, lower=True)
        docs.append(doc[longer])
        slots.append(mix(h + np.uint64(size)) & np.uint64(SLOTS - 1))
    return np.concatenate(docs), np.concatenate(slots).astype(np.int64), whole


def _count_signs(batches):
    """(text, toxic) -> per slot: rows that hold it, toxic rows that hold it."""
    total = np.zeros((2, SLOTS), np.int32)
    for b in batches:
        toxic = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for t in slices(b.column(0)):
            doc, slot, _ = _signs(t, *_bare_words(t))
            key = np.unique(doc * SLOTS + slot)
            doc, slot = key // SLOTS, key % SLOTS
            total[0] += np.bincount(slot, minlength=SLOTS).astype(np.int32)
            total[1] += np.bincount(slot[toxic[doc + t.first]], minlength=SLOTS).astype(np.int32)
    slot = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[0, slot].astype(np.int64)),
                                      pa.array(total[1, slot].astype(np.int64))], names=["slot", "n", "toxic"])


def _firing(t: Texts, voter_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The firing pattern of every text as bits, and its mined signs as (document,
    slot) pairs.  ``voter_of``: slot -> 1 + mined voter, 0 for no sign."""
    start, end, doc = _bare_words(t)
    sdoc, slot, whole = _signs(t, start, end, doc)
    fires = np.zeros((t.n, len(VOTERS)), bool)
    for i, name in enumerate(LEXICONS):
        fires[doc[np.isin(whole, LEXICON_HASHES[name])], i] = True
    n_words = np.bincount(doc, minlength=t.n)
    up = np.concatenate([[0], np.cumsum(UPPER[t.buf])])
    loud = (up[end] - up[start] == end - start) & (end - start > 2)
    fires[:, len(LEXICONS)] = np.bincount(doc[loud], minlength=t.n) * 5 > n_words
    bangs = np.concatenate([[0], np.cumsum(t.buf == 33)])
    fires[:, len(LEXICONS) + 1] = (bangs[t.off[1:]] - bangs[t.off[:-1]]) * 20 > n_words
    hit = voter_of[slot] > 0
    key = np.unique(sdoc[hit] * SLOTS + slot[hit])
    sdoc, slot = key // SLOTS, key % SLOTS
    fires[sdoc, len(FIXED) + voter_of[slot] - 1] = True
    fires[:, -1] = ~fires[:, len(FIXED): -1].any(axis=1)
    return fires, sdoc, slot


class LabelModel:
    """Latent class model of binary voters with correlation-discounted weights."""

    def fit(self, patterns: np.ndarray, counts: np.ndarray, gold: np.ndarray, rounds: int = 60) -> LabelModel:
        """``patterns`` (rows x voters, 0/1), ``counts`` of rows, ``gold`` 1, 0 or -1
        (no label)."""
        known = gold >= 0
        prior = counts[gold == 1].sum() / max(1.0, counts[known].sum()) if known.any() else 0.1
        self.prior = float(np.clip(prior, 0.01, 0.99))
        m = patterns.shape[1]
        sign = np.where(np.arange(m) == m - 1, -1.0, 1.0)
        post = np.where(known, gold, np.clip(self.prior + 0.2 * (patterns * sign).sum(axis=1), 0.01, 0.99))
        for _ in range(rounds):
            self._rates(patterns, counts, post)
            self._correlations(patterns, counts, post)
            post = np.where(known, gold, self.posterior(patterns))
        return self

    def _rates(self, x, counts, post):
        w = np.stack([counts * (1 - post), counts * post])
        self.rate = np.clip((w @ x + 0.5) / (w.sum(axis=1, keepdims=True) + 1.0), 1e-4, 1 - 1e-4)

    def _correlations(self, x, counts, post):
        """Correlation of voters within the classes; a voter's weight is shared with
        those that fire along with it."""
        cov, var = 0.0, 0.0
        for c, w in enumerate((counts * (1 - post), counts * post)):
            d = x - self.rate[c]
            cov = cov + (d * w[:, None]).T @ d
            var = var + (d * d * w[:, None]).sum(axis=0)
        self.correlation = cov / np.sqrt(np.outer(var, var) + 1e-9)
        rho = np.clip(self.correlation, 0, 1) ** 2
        np.fill_diagonal(rho, 0)
        self.weight = 1 / (1 + rho.sum(axis=1))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        on = np.log(self.rate[1] / self.rate[0])
        off = np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        logit = np.log(self.prior / (1 - self.prior)) + (x * on + (1 - x) * off) @ self.weight
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _fit_linear(rows: list[np.ndarray], target: np.ndarray, width: int, l2: float = 0.3,
                rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression over present features, by full-batch gradient steps with
    momentum; ``target``: probabilities."""
    idx = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, v, b, bv = np.zeros(width), np.zeros(width), 0.0, 0.0
    n = max(1, len(rows))
    scale = np.sqrt(np.bincount(idx, minlength=width) + 1.0)
    for _ in range(rounds):
        z = np.bincount(row, w[idx], n)[: len(rows)] + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        v = 0.9 * v - 0.3 * (np.bincount(idx, g[row], width) + l2 * w) / scale
        bv = 0.9 * bv - 0.3 * g.sum() / n
        w, b = w + v, b + bv
    return w, b


class ToxicityModel:
    """Signs, label model and classifier; ``fit`` then ``score``."""

    def __init__(self, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
        self.id, self.text, self.label = id_col, text_col, label_col

    def _learning(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """Learning rows ``t, gold (1, 0, null), h``."""
        known = labels.where(F.col(self.label).isNotNull()).groupBy(F.col(self.id).alias("__id")).agg(
            F.max((F.col(self.label) > 0).cast("int")).alias("gold")).where(~held_out("__id"))
        if labels.count() <= LABEL_ROWS:
            known = F.broadcast(known)
        rows = docs.where(~F.coalesce(held_out(self.id), F.lit(False)))
        return rows.select(F.col(self.id).alias("__id"), F.col(self.text).alias("t")).join(known, "__id", "left") \
            .select("t", "gold", F.xxhash64(F.col("__id"), F.lit("sample")).alias("h"))

    def fit(self, docs: DataFrame, labels: DataFrame) -> ToxicityModel:
        spark = docs.sparkSession
        rows = self._learning(docs, labels)
        counted = rows.where("gold is not null").select("t", F.col("gold").cast("boolean")).mapInArrow(
            _count_signs, "slot long, n long, toxic long").groupBy("slot").agg(
                F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        size = rows.where("gold is not null").agg(F.count(F.lit(1)), F.sum("gold")).first()
        p = (size[1] or 0) / max(1, size[0])
        z = (F.col("toxic") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)) + 1e-9)
        odds = F.col("toxic") * (1 - p) >= ODDS * p * (F.col("n") - F.col("toxic"))
        best = counted.where((F.col("toxic") >= SUPPORT) & odds & F.lit(0 < p < 1)).where(z >= Z_LEAST) \
            .select("slot").toPandas()
        self.slots = np.sort(best["slot"].to_numpy(np.int64))
        voter_of = np.zeros(SLOTS, np.int8)
        voter_of[self.slots] = 1 + (mix(self.slots.astype(np.uint64)) % np.uint64(MINED)).astype(np.int8)
        self.shared = spark.sparkContext.broadcast((self.slots, voter_of[self.slots]))
        shared, bits = self.shared, 1 << np.arange(len(VOTERS))

        def patterns(batches):
            table = _table(shared)
            for b in batches:
                for t in slices(b.column(0)):
                    fires, _, _ = _firing(t, table)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((fires * bits).sum(axis=1)), b.column(1).slice(t.first, t.n)],
                        names=["pattern", "gold"])

        counts = rows.select("t", F.coalesce("gold", F.lit(-1)).alias("gold")).mapInArrow(
            patterns, "pattern long, gold int").groupBy("pattern", "gold").count().toPandas()
        x = ((counts["pattern"].to_numpy(np.int64)[:, None] & bits) > 0).astype(float)
        self.labels = LabelModel().fit(x, counts["count"].to_numpy(float), counts["gold"].to_numpy(np.int64))
        model = self.labels

        def examples(batches):
            table = _table(shared)
            for b in batches:
                gold = b.column(1).to_numpy(zero_copy_only=False)
                for t in slices(b.column(0)):
                    fires, doc, slot = _firing(t, table)
                    own = gold[t.first: t.first + t.n]
                    target = np.where(own >= 0, own, model.posterior(fires.astype(float)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(target.astype(float)), _lists(_features(fires, doc, slot, shared.value[0]))],
                        names=["target", "features"])

        share = SAMPLE / max(1, int(counts["count"].sum()))
        sample = rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).select(
            "t", F.coalesce("gold", F.lit(-1)).alias("gold"))
        fitted = sample.mapInArrow(examples, "target double, features array<int>").toPandas()
        self.weights, self.bias = _fit_linear(list(fitted["features"]), fitted["target"].to_numpy(float),
                                              len(FIXED) + len(self.slots))
        return self

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs``' ids with ``held_out``, ``score`` and ``predicted``."""
        shared, weights, bias = self.shared, docs.sparkSession.sparkContext.broadcast(self.weights), self.bias

        def run(batches):
            table = _table(shared)
            for b in batches:
                for t in slices(b.column(1)):
                    rows = _features(*_firing(t, table), shared.value[0])
                    z = np.array([weights.value[r].sum() for r in rows]) + bias
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(t.first, t.n), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                        names=["id", "score"])

        kind = docs.schema[self.id].dataType.simpleString()
        out = docs.select(self.id, self.text).mapInArrow(run, f"id {kind}, score double")
        return out.select(F.col("id").alias(self.id), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score",
                          (F.col("score") >= 0.7).cast("int").alias("predicted"))


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def _table(shared) -> np.ndarray:
    slots, voters = shared.value
    table = np.zeros(SLOTS, np.int8)
    table[slots] = voters
    return table


def _features(fires, doc, slot, slots) -> list[np.ndarray]:
    """Feature numbers of each text: fixed voters that fire, then mined signs."""
    fixed_doc, fixed = np.nonzero(fires[:, : len(FIXED)])
    docs = np.concatenate([fixed_doc, doc])
    numbers = np.concatenate([fixed, len(FIXED) + np.searchsorted(slots, slot)])
    order = np.argsort(docs, kind="stable")
    return np.split(numbers[order], np.searchsorted(docs[order], np.arange(1, len(fires))))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))
