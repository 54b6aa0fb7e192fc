"""URL filter: host rules first, and for the rest trust and distrust spread over the host graph. DataFrames only.

Hosts are nodes; a page's absolute links to other hosts are edges, weighted by the number of pages that hold them. Trust is
PageRank personalised on the hosts whose pages rules allow; distrust is PageRank over the reversed edges personalised on
the hosts whose pages rules block (who links to bad hosts is suspect). A host is blocked where its distrust exceeds its
trust by more than a threshold. Edges and seeds are summed by host before anything is dealt out by host, so a host with a
third of all pages is one node like another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import stash

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*+=\s*+["']?\s*+((?:https?:)?//[^/?#"'\s<>]++)"""
#: Hosts with a rank that are sent to every executor at most (some 100 bytes each); more are joined by shuffle.
BROADCAST_HOSTS = 500_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?' or '#', ASCII capitals folded; empty for null or where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?' or '#'."""
    return F.coalesce(F.regexp_extract(_after(url), "(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does. Of equally long ones the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for _, r in sorted(enumerate(rules), key=lambda k: (len(k[1].text), -k[0])):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: pages of src with a link to dst, another host."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1)), lambda x: host_of(F.concat(F.lit("x:"), F.regexp_replace(x, "^(?i)https?:", "")))))
    rows = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def personalised(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """host, rank: PageRank that restarts at the seeds (host, weight > 0); rank without a way out goes to them as well.

    Ranks sum to 1; hosts that no seed reaches have no row; without seeds there are none. Rounds go on until a round changes
    ranks by less than ``tolerance`` in all (each changes at most ``damping`` times what the one before did) and reaches no
    new host, however far it is from the seeds.
    """
    total = F.lit(seeds.agg(F.coalesce(F.sum("weight"), F.lit(1.0))).first()[0])
    restart = stash(seeds.select("host", (F.col("weight") / total).alias("rank")))
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    steps = stash(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("p")))
    rank, known = restart, 0
    if not steps.limit(1).count() or not restart.limit(1).count():
        return rank
    while True:
        moved = rank.join(steps, F.col("host") == F.col("src")).groupBy("dst").agg((F.sum(F.col("rank") * F.col("p")) * damping).alias("rank")).withColumnRenamed("dst", "host")
        gone = F.lit(1.0 - (moved.agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]))
        new = stash(moved.unionByName(restart.select("host", (F.col("rank") * gone).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank")))
        change, reached = new.join(rank.withColumnRenamed("rank", "old"), "host", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))), F.count("rank")).first()
        rank = new
        if change < tolerance and reached == known:
            return rank
        known = reached


def judge(pages: DataFrame, rules: list[Rule], threshold: float = 0.0, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages with host, path, rule (null: none fits), verdict ('allow' or 'block'), trust and distrust of the host.

    Null urls and urls without '://' have an empty host and path, fit no rule and are allowed; hosts that neither trust nor
    distrust reaches are allowed. Null html has no links. All columns stay; columns of the new names give way.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "trust", "distrust")
    rows = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    rule, verdict = matched(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "__said": verdict})
    votes = stash(rows.where("host <> ''").groupBy("host").agg(F.count_if(F.col("__said") == "allow").alias("good"), F.count_if(F.col("__said") == "block").alias("bad")))
    edges = stash(host_edges(pages, url_col, html_col))
    good = votes.where("good > 0").select("host", F.col("good").cast("double").alias("weight"))
    bad = votes.where("bad > 0").select("host", F.col("bad").cast("double").alias("weight"))
    trust = personalised(edges, good).withColumnRenamed("rank", "trust")
    distrust = personalised(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), bad).withColumnRenamed("rank", "distrust")
    scores = stash(trust.join(distrust, "host", "full"))
    if scores.count() <= BROADCAST_HOSTS:
        out = rows.join(F.broadcast(scores), "host", "left")
    else:  # rows without a host have no partner; they stay out of the shuffle
        lone = rows.where("host = ''").withColumns({"trust": F.lit(None).cast("double"), "distrust": F.lit(None).cast("double")})
        out = rows.where("host <> ''").join(scores, "host", "left").unionByName(lone)
    out = out.withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    own = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return out.select(*pages.columns, "host", "path", "rule", F.coalesce("__said", own).alias("verdict"), "trust", "distrust")
