"""URL verdicts: fixed host and path rules, and link-graph propagation for what no rule decides.

Pages that a rule allows make their hosts trusted seeds, pages that a rule blocks make them blocked
seeds, each weighted by the number of such pages.  Trust is personalised PageRank along the host edges
found in the pages' links; distrust is the same walk from blocked seeds along the reversed edges, so it
reaches hosts that link to blocked ones.  A host is blocked if its distrust is positive and, but for a
relative ``MARGIN``, at least ``RATIO`` times its trust; hosts that neither reaches are allowed, however
far the seeds are.  Both walks are one DataFrame loop of a join and an aggregate with map-side combine;
every round is written to the shared folder.  The loop ends when no new host was reached and no host's
mass grew by more than the share ``TOLERANCE``; no later round can make one grow by more.

Edge cases: trust and distrust that tie within ``MARGIN`` block; very long texts are read whole; a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; null
html has no links; links within a host and relative links are no edges; repeated rows are judged each
and count as often in the seeds' weights; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.session import written

#: (host, path, verdict): a rule fits its host and all subdomains; the longest wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING, RATIO = 0.85, 1.0
TOLERANCE, MARGIN = 1e-5, 1e-4
#: The mass of hosts so far from all seeds that doubles can't hold less.
_LEAST = 1e-300
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and by_rule; ``rules`` is a short list, tried from the longest."""
    host, path = host_and_path(F.col("url"))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct links between different hosts."""
    host, _ = host_and_path(F.col("url"))
    links = pages.filter(F.col("html").contains("//")).select(
        host.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))).alias("link"))
    to, _ = host_and_path(F.when(F.col("link").startswith("//"), F.concat(F.lit(":"), F.col("link"))).otherwise(F.col("link")))
    return links.select("src", to.alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, mass) of the walk from seeds (kind, host, weight), iterated until masses stand still.

    ``edges`` (src, dst) are followed by kind 'trust' and reversed for kind 'distrust'.
    """
    base = seeds.select("kind", "host", (F.col("weight") * (1 - DAMPING)).alias("mass"))
    both = (edges.select(F.lit("trust").alias("kind"), "src", "dst")
            .unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))))
    out_degree = both.groupBy("kind", "src").agg(F.count("*").alias("n"))
    both = written(both.join(out_degree, ["kind", "src"]), "host_edges")
    base = written(base, "seeds")
    if both.isEmpty():
        return base
    follow = both.withColumnRenamed("src", "host")
    now, grown = base, 1.0
    while grown > tolerance:
        moved = now.join(follow, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("mass") * DAMPING / F.col("n")).alias("mass"))
        before = now.select("kind", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("before"))
        rows = base.unionByName(moved).withColumn("before", F.lit(0.0)).unionByName(before)
        now = written(rows.groupBy("kind", "host").agg(F.greatest(F.sum("mass"), F.lit(_LEAST)).alias("mass"), F.sum("before").alias("before")), "mass")
        # A new host has no mass before and counts as grown by its whole mass.
        grown = now.agg(F.max(1 - F.col("before") / F.col("mass"))).first()[0] or 0.0
        now = now.select("kind", "host", "mass")
    return now


def verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    judged = written(ruled(pages, rules), "judged")
    kind = F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust")
    seeds = (judged.filter("by_rule IS NOT NULL AND host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").cast("double").alias("weight")))
    mass = propagate(seeds, host_edges(pages))
    side = lambda k: F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0))
    bad = (mass.groupBy("host").agg(side("trust").alias("trust"), side("distrust").alias("distrust"))
           .filter((F.col("distrust") > 0) & (F.col("distrust") >= RATIO * (1 - MARGIN) * F.col("trust"))).select("host", F.lit("block").alias("by_host")))
    return judged.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))
