"""Spelling variants: words that one code point keeps apart, by a frequency-vector trie.

A word is described by how often each of ``GROUPS`` letter groups occurs in it (a code
point's group is its value modulo ``GROUPS``).  Words are arranged in a trie by
successive counts.  One inserted code point is a surplus of one in one group, a
deleted one a deficit of one, a replaced one both (or neither, within a group): so a
word's near words are found by a depth-first search that may spend a surplus of one
and a deficit of one on its way down.  Words of the leaves it reaches are verified.

On Spark the trie's top is cut into nodes of at most ``NODE`` words, ``STEP`` groups at
a time: sizes of all prefixes are one grouped count, and the searches walk down through
nodes that are too large by joins with the nodes that exist.  Where a search ends, a
task searches the rest of the trie: the words of one node and the searches that
reached it, depth first, all searches together.  A node that is too large at the
lowest cut (many words with the same counts) is dealt out in blocks of ``NODE`` words,
and searches that meet in one node in parts of ``SEARCHES``; so no task holds more than
that, whatever the vocabulary.  Tasks give back one row a search, not pairs.

Edge cases: a null text has no words; a null id counts as the empty string in the hash
that deletes code points; repeated rows count again; texts of any length are read whole
(a long one in runs of ``RUNS`` words); ties of the form go to the smallest word in
code-point order; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch

LEAST_LENGTH, LEAST_COUNT, RATIO, ONE_IN = 5, 3, 2, 97
GROUPS, STEP, NODE, SEARCHES, LEAF = 16, 4, 20_000, 40_000, 24
RUNS, KEEP, WIDE, PAIRS = 100_000, 400_000, 32, 1 << 16
# U+00C0-U+00FF are the byte pairs C3 80 - C3 BF
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")


def _damaged(run: bytes, crc: int) -> bytes:
    s = run.decode()
    at = crc % len(s)
    return (s[:at] + s[at + 1:]).encode()


def _count(batches):
    """(id, text) -> partial counts (word, n) of whole texts."""
    total: Counter = Counter()

    def flush():
        words = [w.decode() for w in total]
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())],
                                         names=["word", "n"])
        total.clear()
        return out

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1)):
            raw = text.as_py()
            if not raw:
                continue
            start = zlib.crc32(b"%s:" % (b"" if key is None else str(key).encode()))
            raw = raw.encode().lower()  # bytes: only A-Z change
            found = (m[0] for m in _RUN.finditer(raw)) if len(raw) > RUNS else iter(_RUN.findall(raw))
            while runs := list(islice(found, RUNS)):
                cut = {w: _damaged(w, h) for w in set(runs) if not (h := zlib.crc32(w, start)) % ONE_IN}
                total.update([cut.get(w, w) for w in runs] if cut else runs)
            if len(total) > KEEP:
                yield flush()
    if total:
        yield flush()


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words of at least ``LEAST_LENGTH`` code points that occur
    ``LEAST_COUNT`` times or more."""
    own = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_count, "word string, n long")
    return own.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= LEAST_COUNT)


class _Words:
    """Words of one task: letter counts, and letters from either end."""

    def __init__(self, column):
        self.text = list(column)
        raw = [w.encode("latin-1") for w in self.text]
        self.size = np.array([len(w) for w in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        row = np.repeat(np.arange(len(raw)), self.size)
        #: groups x words; words of 127 letters or more need wider counts
        self.vec = np.ascontiguousarray(np.bincount(row * GROUPS + flat % GROUPS, minlength=len(raw) * GROUPS).reshape(
            -1, GROUPS).T.astype(np.int8 if self.size.max(initial=0) < 127 else np.int32))
        self.left = np.frombuffer(b"".join(w[:WIDE].ljust(WIDE, b"\0") for w in raw), np.uint8).reshape(-1, WIDE)
        self.right = np.frombuffer(b"".join(w[::-1][:WIDE].ljust(WIDE, b"\0") for w in raw), np.uint8).reshape(-1, WIDE)


def _near(a: _Words, i: np.ndarray, b: _Words, j: np.ndarray) -> np.ndarray:
    """Whether word i of ``a`` and word j of ``b`` differ by exactly one code point: the
    common letters at both ends leave at most one over."""
    x, y = a.size[i], b.size[j]
    short = np.minimum(x, y)

    def common(p, q):
        differ = p != q
        return np.where(differ.any(axis=1), differ.argmax(axis=1), WIDE)

    ends = np.minimum(common(a.left[i], b.left[j]), short) + np.minimum(common(a.right[i], b.right[j]), short)
    # equal words have twice their length in common: not near
    near = (np.abs(x - y) <= 1) & np.where(x == y, ends == short - 1, ends >= short)
    for k in np.flatnonzero((short >= WIDE) & (np.abs(x - y) <= 1)):
        p, q = a.text[i[k]], b.text[j[k]]
        ends = len(commonprefix([p, q])) + len(commonprefix([p[::-1], q[::-1]]))
        near[k] = p != q and (ends == short[k] - 1 if x[k] == y[k] else ends >= short[k])
    return near


class _Search:
    """All searches of one node, together: at each trie node the searches that got
    there go on to the children that their budgets reach."""

    def __init__(self, own: _Words, n_own: np.ndarray, asked: _Words, n_asked: np.ndarray):
        self.own, self.asked = own, asked
        # the node's words first, then the searches: what each has found
        self.text = np.array(own.text + asked.text, object)
        self.n = np.concatenate([n_own, n_asked])
        self.rank = np.unique(self.text, return_inverse=True)[1]  # latin-1: code-point order
        self.n_near = np.zeros(len(self.text), np.int64)
        self.best = np.full(len(self.text), -1, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def down(self, group: int, words: np.ndarray, queries: np.ndarray, surplus: np.ndarray, deficit: np.ndarray):
        if not len(words) or not len(queries):
            return
        if group == GROUPS or len(words) <= LEAF:
            for at in range(0, len(queries), PAIRS):  # long lists in parts
                q, s, d = queries[at: at + PAIRS], surplus[at: at + PAIRS], deficit[at: at + PAIRS]
                for w in range(0, len(words), LEAF):
                    self.leaf(group, words[w: w + LEAF], q, s, d)
            return
        counts = self.own.vec[group, words]
        order = np.argsort(counts, kind="stable")
        words, counts = words[order], counts[order]
        edges = np.concatenate([[0], np.flatnonzero(counts[1:] != counts[:-1]) + 1, [len(words)]])
        mine = self.asked.vec[group, queries]
        least = np.where(surplus > 0, 0, -deficit)  # the surplus is spent first
        for lo, hi in zip(edges[:-1], edges[1:]):
            more = counts[lo] - mine  # what the child has over the query
            go = (more >= least) & (more <= surplus)
            if go.any():
                more = more[go]
                self.down(group + 1, words[lo:hi], queries[go], surplus[go] - (more > 0), deficit[go] - (more < 0))

    def leaf(self, group, words, queries, surplus, deficit):
        # pairs whose lengths are too far apart, then group by group those out of budget
        left = self.own.size[words][None, :] - self.asked.size[queries][:, None]
        i, j = np.nonzero((left <= 1) & (left >= -1))
        s, d = surplus[i], deficit[i]
        for g in range(group, GROUPS):
            more = self.own.vec[g, words[j]] - self.asked.vec[g, queries[i]]
            ok = (more >= np.where(s > 0, 0, -d)) & (more <= s)
            i, j, s, d, more = i[ok], j[ok], s[ok], d[ok], more[ok]
            s, d = s - (more > 0), d - (more < 0)
        self.held.append((queries[i], words[j], s == 0))
        self.size += len(i)
        if self.size >= PAIRS:
            self.verify()

    def verify(self):
        if not self.size:
            return
        i, j, mutual = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        for at in range(0, len(i), PAIRS):
            q, w, both = i[at: at + PAIRS], j[at: at + PAIRS], mutual[at: at + PAIRS]
            ok = _near(self.asked, q, self.own, w)
            q, w, both = q[ok] + len(self.own.text), w[ok], both[ok]
            self.credit(np.concatenate([q, w[both]]), np.concatenate([w, q[both]]))

    def credit(self, word: np.ndarray, near: np.ndarray):
        """Counts ``near`` for ``word``, and keeps the most frequent one."""
        np.add.at(self.n_near, word, 1)
        old = self.best[word]
        word, near = np.concatenate([word, word[old >= 0]]), np.concatenate([near, old[old >= 0]])
        order = np.lexsort((self.rank[near], -self.n[near], word))
        word, near = word[order], near[order]
        first = np.ones(len(word), bool)
        first[1:] = word[1:] != word[:-1]
        self.best[word[first]] = near[first]


def _search(cell, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The words of one node against the searches that reached it: what both found."""
    words, n_near, near = (np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, object))
    near_n = n_near
    if len(own) and len(asked):
        run = _Search(_Words(own["word"]), own["n"].to_numpy(np.int64), _Words(asked["word"]), asked["n"].to_numpy(np.int64))
        run.down(int(own["depth"].iloc[0]) * STEP, np.arange(len(own)), np.arange(len(asked)),
                 asked["surplus"].to_numpy(np.int64), asked["deficit"].to_numpy(np.int64))
        run.verify()
        got = np.flatnonzero(run.n_near)
        best = run.best[got]
        words, n_near, near_n, near = run.text[got], run.n_near[got], run.n[best], run.text[best]
    return pd.DataFrame({"word": pd.Series(words, dtype=object), "n_near": n_near, "near_n": near_n,
                         "near": pd.Series(near, dtype=object)})


def _counts(batches):
    """Adds letter counts to (word, n)."""
    for b in batches:
        if b.num_rows:
            vec = np.ascontiguousarray(_Words(b.column(0).to_pylist()).vec.T.astype(np.int32))
            at = pa.array(np.arange(0, vec.size + 1, GROUPS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, pa.array(vec.ravel()))],
                                             names=["word", "n", "vec"])


def _steps():
    """All ways to spend at most one surplus and one deficit in ``STEP`` groups: what is
    spent, whether the surplus has to be spent before, and the change of each count."""
    moves = [[0] * STEP]
    for i in range(STEP):
        moves += [[int(k == i) for k in range(STEP)], [-int(k == i) for k in range(STEP)]]
        moves += [[int(k == i) - int(k == j) for k in range(STEP)] for j in range(STEP) if j != i]
    return F.array(*[F.struct(F.lit(m.count(1)).alias("s"), F.lit(m.count(-1)).alias("d"),
                              F.lit(-1 in m and 1 not in m[: m.index(-1)]).alias("late"),
                              *[F.lit(x).alias(f"by{k}") for k, x in enumerate(m)]) for m in moves])


ROOT = 0


def _child(node, depth: int, by: str | None = None):
    """The node below ``node`` (at cut ``depth``) on a word's way down: a hash of the
    counts so far (nodes are told apart by 64 bits; a clash would cost time only, as
    pairs are verified).  With ``by``, the counts are changed by a step."""
    counts = [F.get("vec", F.lit(depth * STEP + k)) for k in range(STEP)]
    return F.xxhash64(node, *[c if by is None else c + F.col(f"{by}.by{k}") for k, c in enumerate(counts)])


def near_words(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, n_near, near_n, near`` of all words with a near word in ``vocabulary (word,
    n)``: how many, and the most frequent one."""
    last = GROUPS // STEP
    vocabulary = vocabulary.mapInArrow(_counts, "word string, n long, vec array<int>")
    vocabulary = vocabulary.withColumn("node0", F.lit(ROOT).cast("long"))
    for depth in range(last):
        vocabulary = vocabulary.withColumn(f"node{depth + 1}", _child(F.col(f"node{depth}"), depth))
    vocabulary = scratch.put(vocabulary, "letters")
    way = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"node{d}").alias("node"))
                              for d in range(last + 1)])).alias("at")
    nodes = scratch.put(vocabulary.select(way).groupBy("at.depth", "at.node").agg(F.count(F.lit(1)).alias("size")), "nodes")
    ends = (F.col("size") <= NODE) | (F.col("depth") == last)
    # where each word is: the first node on its way down that is small enough
    placed, above = None, vocabulary
    # the searches walk down through the nodes that are too large
    front = vocabulary.select("word", "n", "vec", F.col("node0").alias("node"), F.lit(1).alias("surplus"), F.lit(1).alias("deficit"))
    reached = None
    for depth in range(last + 1):
        here = nodes.where(F.col("depth") == depth).select("node", "size", ends.alias("end"))
        level = above.join(here.withColumnRenamed("node", f"node{depth}"), f"node{depth}")
        mine = level.where("end").select("word", "n", F.lit(depth).alias("depth"), F.col(f"node{depth}").alias("node"), "size")
        placed = mine if placed is None else placed.unionByName(mine)
        above = level.where("not end").select(*vocabulary.columns)
        met = scratch.put(front.join(here, "node").withColumn("vec", F.when(~F.col("end"), F.col("vec"))), f"front{depth}")
        done = met.where("end").select("word", "n", F.lit(depth).alias("depth"), "node", "size", "surplus", "deficit")
        reached = done if reached is None else reached.unionByName(done)
        on = met.where("not end")
        if depth == last or on.isEmpty():
            break
        front = on.select("*", F.explode(_steps()).alias("m")) \
            .where(" and ".join(["m.s <= surplus", "m.d <= deficit", "(not m.late or surplus = 0)",
                                 *[f"vec[{depth * STEP + k}] + m.by{k} >= 0" for k in range(STEP)]])) \
            .select("word", "n", "vec", _child(F.col("node"), depth, "m").alias("node"),
                    (F.col("surplus") - F.col("m.s")).alias("surplus"), (F.col("deficit") - F.col("m.d")).alias("deficit"))
    # large nodes in blocks of words, many searches in parts
    parts = scratch.put(reached.groupBy("depth", "node").agg(
        F.ceil(F.count(F.lit(1)) / SEARCHES).cast("int").alias("parts")), "parts")
    blocks = F.ceil(F.col("size") / NODE).cast("int")
    own = placed.join(parts, ["depth", "node"]) \
        .withColumn("block", F.pmod(F.xxhash64("word"), blocks).cast("int")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = reached.join(parts, ["depth", "node"]) \
        .withColumn("part", F.pmod(F.xxhash64("word", F.lit("part")), F.col("parts")).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = ["depth", "node", "block", "part"]
    found = own.select(*cell, "word", "n").groupBy(*cell).cogroup(
        asked.select(*cell, "word", "n", "surplus", "deficit").groupBy(*cell)).applyInPandas(
        _search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best) \
        .select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` of all words with a form: forms are followed by doubling, so a chain
    of k forms takes log2(k) rounds."""
    at = scratch.put(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.put(at.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``."""
    scratch = Scratch(docs.sparkSession, "spelling")
    vocabulary = scratch.put(words(docs, id_col, text_col), "words")
    near = scratch.put(near_words(vocabulary, scratch), "near")
    known = vocabulary.join(near, "word", "left")
    more = F.col("near_n") >= RATIO * F.col("n")
    judged = scratch.put(known.select("word", F.when(more, F.col("near")).alias("form"), "n",
                                      F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                      F.when(more, F.col("near_n")).alias("form_n")), "forms")
    roots = _roots(judged.where("form is not null"), scratch)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
