"""URL verdicts by rules and by trust and distrust over host links, with DataFrame functions only.

Rules judge the urls that they fit. Hosts with allowed urls are seeds of trust, which flows along
links; hosts with blocked urls are seeds of distrust, which flows against them, from a page that is linked to those
that link to it. Both are personalised PageRank. A url without a rule gets the verdict of its host:
block if the distrust is over the threshold times the trust.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

#: (verdict, host, path): the rules of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class RankConfig:
    damping: float = 0.85
    #: Steps end when the ranks of all hosts together change by less than this from one written state to the next.
    tolerance: float = 1e-6
    #: Steps after which ranks are written and read again.
    write_every: int = 4
    #: Distrust over this many times the trust blocks a host.
    threshold: float = 1.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or without `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, host: Column, html_column: str) -> DataFrame:
    """(src, dst, n): links between different hosts, counted before the exchange."""
    found = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_column).cast("string"), F.lit("")), F.lit(_LINK), 1)).alias("dst"))
    return found.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_rank(links: DataFrame, seeds: DataFrame, config: RankConfig = RankConfig()) -> DataFrame:
    """(host, rank) of hosts that the seeds' mass reaches; ranks sum to 1. links: (src, dst, n); seeds: (host, seed), whose sum is 1.

    A host passes its rank on in proportion to n, and one without links to the seeds. Giving that mass back to the seeds only scales
    all ranks by one factor, so it is left out of the steps, and the sum is put right at the end. Steps go on until nothing
    changes by more than the tolerance; the change shrinks by the damping factor with each.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    shares = written(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "shares")
    restart = seeds.select("host", ((1 - config.damping) * F.col("seed")).alias("rank"))
    ranks = written(restart, "ranks")
    change = 0.0 if shares.isEmpty() else math.inf
    while change > config.tolerance:
        last = ranks
        for _ in range(config.write_every):
            moved = ranks.join(shares, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (config.damping * F.col("rank") * F.col("share")).alias("rank"))
            ranks = moved.unionByName(restart).groupBy("host").agg(F.sum("rank").alias("rank"))
        ranks = written(ranks, "ranks")
        # ranks grow from step to step, so the sums' difference is the sum of all differences
        before, after = (df.agg(F.sum("rank")).first()[0] or 0.0 for df in (last, ranks))
        change = (after - before) / after if after else 0.0
    total = ranks.agg(F.sum("rank")).first()[0]
    return ranks.select("host", (F.col("rank") / F.lit(total or 1.0)).alias("rank"))


def judge(pages: DataFrame, config: RankConfig = RankConfig(), rules=RULES, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """id_column, host, path, rule, verdict, trust, distrust of every row of pages.

    A url that is null or without `://` has an empty host and path, fits no rule and is allowed, as is one whose
    host neither trust nor distrust reaches. Repeated rows stay. Links are read from whole pages; null pages have none.
    """
    shared_dir(pages.sparkSession)
    host, path = host_and_path(F.col(url_column))
    rows = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    marks = written(rows.where("host != ''").groupBy("host").agg(F.count("*").alias("rows"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")), "marks")
    total = marks.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("rows").alias("rows")).first()
    links = written(host_links(pages, host, html_column), "host-links")
    ranks = []
    for column, edges in (("good", links), ("bad", links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))):
        seeds = marks.where(F.col(column) > 0).select("host", (F.col(column) / F.lit(float(total[column] or 1))).alias("seed"))
        ranks.append(personalised_rank(edges, seeds, config))
    both = ranks[0].select("host", F.col("rank").alias("trust")).join(ranks[1].select("host", F.col("rank").alias("distrust")), "host", "full")
    both = written(both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "trust")
    # hosts with over a thousandth of the rows, a thousand at most, are broadcast, so that none of them is one task's
    hot = both.join(marks.where(F.col("rows") > (total["rows"] or 0) / 1000).select("host"), "host").withColumn("hot", F.lit(True))
    first = rows.join(F.broadcast(hot), "host", "left")
    own = first.where("hot").drop("hot").unionByName(first.where("hot is null").select(*rows.columns).join(both, "host", "left"))
    by_host = F.when(F.col("distrust") > config.threshold * F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    return own.select(F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
