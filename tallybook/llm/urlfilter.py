"""URL verdicts: rules by host and path, and trust and distrust that spread over links between hosts.

A page without a fitting rule is judged by its host. Hosts are joined by the absolute links of their pages (one edge per pair of hosts,
weighted by the number of links). Trust is a personalised PageRank from trusted hosts along the links; distrust is the same from
blocked hosts against the links, so that a host is charged for what it links to. A host is a trusted seed by the share of its pages that
rules allow, and a blocked seed when a rule blocks all its paths; callers may add seeds. A host is blocked when its distrust reaches
THRESHOLD and exceeds its trust. As a blocked host's distrust is shared by all who link to it, each host also has an exposure that no
number of other hosts makes smaller: 1 for a blocked seed, for others DAMPING times the mean exposure of what their links lead to.
A host is blocked too when its exposure reaches EXPOSURE and exceeds its trust, counted in trusted seeds. Links with and
without scheme (``//host/``) count.

Everything is DataFrame code; each round is kept as a table and only the largest change reaches the driver. Null urls and
urls without ``://`` have an empty host and path, no rule, and are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import keep

# Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
TOLERANCE = 1e-6
"""Rounds go on until no score changes by more. A change in all shrinks by DAMPING each round, so about 85 rounds are the most for
seeds of weight 1 in all, and 14 more for each tenfold weight."""
THRESHOLD = 0.1
EXPOSURE = 0.5
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?is)\shref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]*)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null when none fits. rules: a list given by the caller."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits is the longest
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def spread(edges: DataFrame, seeds: DataFrame, source: str, target: str, by: str | None = None) -> DataFrame:
    """(host, score): score = (1 - DAMPING) * seed + DAMPING * what flows in over edges from ``source`` to ``target``.

    An edge carries its part of all links of its ``source``, or of its host ``by``."""
    out = edges.groupBy(by or source).agg(F.sum("links").alias("all"))
    flow = keep(edges.join(out, by or source).select(F.col(source).alias("from"), F.col(target).alias("to"), (F.col("links") / F.col("all")).alias("part")), "flow")
    start = seeds.select("host", ((1 - DAMPING) * F.col("seed")).alias("start"))
    scores = keep(start.select("host", F.col("start").alias("score")), "scores")
    if flow.isEmpty():
        return scores
    while True:
        arriving = flow.join(scores, flow["from"] == scores.host).groupBy(F.col("to").alias("host")).agg(F.sum(F.col("part") * F.col("score")).alias("inflow"))
        step = (
            start.join(arriving, "host", "full")
            .join(scores.withColumnRenamed("score", "old"), "host", "left")
            .select(
                "host",
                (F.coalesce("start", F.lit(0.0)) + DAMPING * F.coalesce("inflow", F.lit(0.0))).alias("score"),
                F.coalesce("old", F.lit(0.0)).alias("old"),
            )
        )
        step = keep(step, "scores")
        change = step.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        scores = step.select("host", "score")
        if change < TOLERANCE:
            return scores


def url_verdicts(
    pages: DataFrame, rules=RULES, trusted: DataFrame | None = None, blocked: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) per row of pages. trusted, blocked: more seeds, tables with a column host."""
    url = F.col(url_col).cast("string")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    links = F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(_LINK), F.lit(1)), lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x)))
    judged = keep(
        pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), links.alias("links"))
        .withColumns({"rule": rule, "ruled": verdict}),
        "judged",
    )
    named = judged.where("host != ''")
    edges = keep(
        named.select("host", F.explode("links").alias("other")).where("other != '' and other != host").groupBy("host", "other").agg(F.count(F.lit(1)).alias("links")),
        "edges",
    )
    hosts = named.groupBy("host").agg(F.avg((F.coalesce("ruled", F.lit("")) == "allow").cast("int")).alias("allowed"))
    whole = F.coalesce(rule_of(F.col("host"), F.lit("/"), rules)[1] == "block", F.lit(False)).cast("double")
    hosts = hosts.withColumn("stopped", whole)

    def seeds(weight: str, more: DataFrame | None) -> DataFrame:
        own = hosts.select("host", F.col(weight).alias("seed"))
        own = own if more is None else own.union(more.select("host", F.lit(1.0)))
        return own.groupBy("host").agg(F.max("seed").alias("seed")).where("seed > 0")

    trust = spread(edges, keep(seeds("allowed", trusted), "trusted"), "host", "other").withColumnRenamed("score", "trust")
    stopped = keep(seeds("stopped", blocked), "blocked")
    distrust = spread(edges, stopped, "other", "host").withColumnRenamed("score", "distrust")
    exposure = spread(edges.join(stopped, "host", "left_anti"), stopped, "other", "host", by="host").withColumnRenamed("score", "exposure")
    whole = trust.join(distrust, "host", "full").join(exposure, "host", "full")
    scores = keep(whole.select("host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust", "exposure"))), "hosts")
    bad = ((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))) | (
        (F.col("exposure") >= (1 - DAMPING) * EXPOSURE) & (F.col("exposure") > F.col("trust"))  # both scores of a seed are 1 - DAMPING
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block"), F.lit("allow")).alias("verdict"), zero("trust"), zero("distrust")
    )
