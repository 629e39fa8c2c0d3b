"""URL filters by link-graph propagation, in DataFrame functions only.

Explicit rules (host and path prefix; the longest that fits wins) decide their own
urls, and make their hosts seeds: trusted seeds by their share of allowed pages,
blocked ones by their share of blocked pages.  Hosts are joined by edges: absolute
and protocol-relative links in the pages' markup, weighted by the number of pages,
and a host's tie with its parent domain.  Personalised PageRank spreads trust along
the edges from the trusted seeds, and distrust against them from the blocked seeds (a
host that links to a blocked one is suspect).  Seeds of either kind sum to 1, and so do
the ranks: mass that reaches a host without a way out returns to the seeds, which only
scales all ranks of a kind, so they are divided by their sum at the end.  Rounds go on
until no rank changes by more than ``TOLERANCE`` of itself; a host that is reached for
the first time is such a change, so every host that a seed can reach has a rank, however
long the chain.  A url that no rule fits is blocked if its host's share of distrust,
distrust / (trust + distrust), is at least ``threshold``; a host that nothing reaches is
allowed.

Scale: pages are reduced to host counts and host edges (partial sums) before any
join, so a host with a third of all pages is one row in the graph; each round joins
edges to ranks of the hosts (one row a key) and sums partially; every ``CUT`` rounds
the ranks are written to the shared folder, beside those of the round before, and the
largest change is read from there.  Rounds: the length of the longest chain, and about 43
more on cycles (0.85 ** 43 is 0.001).  Texts and markup are never shuffled.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule
and the verdict allow; null markup has no links; repeated pages count as often as
they occur; rules of one length that both fit: the first in the list; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch

TOLERANCE, CUT, DAMPING, PARENT_WEIGHT = 0.001, 4, 0.85, 0.25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def with_parts(pages: DataFrame, url_col: str) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``."""
    after = F.when(F.instr(F.col(url_col), "://") > 0,
                   F.substr(F.col(url_col), F.instr(F.col(url_col), "://") + 3))
    own = pages.withColumn("__after", F.coalesce(after, F.lit("")))
    return own.withColumn("host", F.translate(F.regexp_extract("__after", r"^([^/?#]*)", 1), UPPER, LOWER)) \
        .withColumn("path", F.regexp_extract("__after", r"^[^/?#]*([^?#]*)", 1)).drop("__after")


def rule_of(rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits ``host`` and ``path``."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        host, slash, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) \
            & F.startswith(F.col("path"), F.lit(slash + rest))
        out = F.coalesce(out, F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return out


def host_edges(pages: DataFrame, html_col: str) -> DataFrame:
    """``src, dst, w``: links between hosts by pages, and ties to parent domains."""
    linked = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)),
        lambda h: F.translate(h, UPPER, LOWER)))).alias("dst")).where("src <> '' and src <> dst")
    links = linked.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    hosts = pages.select("host").union(links.select("dst")).where("host <> ''").distinct()
    # parents of two labels or more: a.b.c -> b.c
    labels = F.split("host", r"\.")
    chain = hosts.withColumn("l", labels).where(F.size("l") > 2).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.struct(
            F.array_join(F.slice("l", i, F.size("l")), ".").alias("child"),
            F.array_join(F.slice("l", i + 1, F.size("l")), ".").alias("parent")))).alias("x")).select("x.*").distinct()
    up = chain.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(PARENT_WEIGHT).alias("w"))
    down = chain.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(PARENT_WEIGHT).alias("w"))
    return links.unionByName(up).unionByName(down).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def spread(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, trust, distrust`` by personalised PageRank from ``seeds (host, trust,
    distrust)``; trust follows the edges, distrust goes against them."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    out = both.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    graph = scratch.put(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("total"))
                                                               .alias("share")), "graph")
    start = scratch.put(_to_one(seeds.select("host", F.explode(F.create_map(
        F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "r"))
        .where("r > 0")), "seeds")
    base = start.withColumn("r", (1 - DAMPING) * F.col("r"))
    ranks = base
    while True:
        for _ in range(CUT):
            before = ranks
            moved = graph.join(before.select("kind", F.col("host").alias("src"), "r"), ["kind", "src"]) \
                .select("kind", F.col("dst").alias("host"), (DAMPING * F.col("share") * F.col("r")).alias("r"))
            ranks = moved.unionByName(base).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        step = scratch.put(ranks.join(before.withColumnRenamed("r", "old"), ["kind", "host"], "left"), "ranks")
        ranks = step.select("kind", "host", "r")
        if step.where(F.abs(F.col("r") - F.coalesce("old", F.lit(0.0))) > TOLERANCE * F.col("r")).isEmpty():
            break
    return _to_one(ranks).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("r")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("r")).otherwise(0.0)).alias("distrust"))


def _to_one(ranks: DataFrame) -> DataFrame:
    """``kind, host, r`` with each kind's ``r`` divided by its sum (two sums)."""
    sums = ranks.groupBy("kind").agg(F.sum("r").alias("sum"))
    return ranks.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("r") / F.col("sum")).alias("r"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.75, id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, ``host, path, rule, verdict, trust, distrust``."""
    scratch = Scratch(pages.sparkSession, "url-trust")
    own = with_parts(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"),
                                  F.col(html_col).alias("__html")), "__url")
    ruled = own.withColumn("__rule", rule_of(rules))
    counts = ruled.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("__rule.verdict") == "allow").alias("good"),
        F.count_if(F.col("__rule.verdict") == "block").alias("bad"))
    seeds = counts.select("host", (F.col("good") / F.col("n")).alias("trust"), (F.col("bad") / F.col("n")).alias("distrust"))
    scores = spread(host_edges(own, "__html"), seeds, scratch)
    out = ruled.drop("__html", "__url").join(scores, "host", "left")
    share = F.col("distrust") / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0))
    method = F.when(F.coalesce(share, F.lit(0.0)) >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("__id").alias(id_col), "host", "path", F.col("__rule.rule").alias("rule"),
                      F.coalesce(F.col("__rule.verdict"), method).alias("verdict"),
                      F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
