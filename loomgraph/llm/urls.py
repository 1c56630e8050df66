"""URL verdicts from rules and, where none fits, from trust and distrust that spread over the links between hosts.

Host and path: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; then the path up to
``?``, ``#`` or the end. A rule (host and path prefix) fits its host and all subdomains; the longest that fits wins.

Method: a host's seeds are the shares of its pages that rules allow and block. Trust is personalised PageRank from the
allowed shares along links, ``t = (1 - d) * seed + d * sum(t(source) * links / links out of source)``; distrust runs the
other way, from the blocked shares against the links, since those who link to bad hosts are suspect. Both walks also carry
the rank that every host would have if all were seeds. A host's trust and distrust are the parts of that rank which come
from allowed and blocked pages; its own pages count towards it if rules judge any of them. So they are between 0 and 1
however many hosts share a blocked host's distrust, and a farm of thousands that link to it is as suspect as a single
linker. A host is blocked if its distrust is at least THRESHOLD and above its trust, so ties are allowed. A host's links to
itself, relative ones among them, say nothing of others and are left out. Walks go on until a round moves less than
TOLERANCE of all rank; as a round moves d of what the last one moved at most, that is bounded, too.

Links are summed up to one edge for a pair of hosts before anything else, and shares are summed up before the shuffle in
each round; ranks are joined by host, one row a host, so a host with a third of all links is split by Spark.

Cases: a url that is null or lacks ``://`` has an empty host and path, no rule, and the verdict allow; a null html has no
links; a html of any length is searched whole, in time in proportion to it; rows that repeat are judged alike, and their
links count each; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, materialize, narrow

# Host and path prefix, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-4, 0.5
CUT_EVERY = 4


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), ASCII_UPPER, ASCII_UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and said (the rule's verdict), both null where none fits. pages has host and path."""
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones come later and so win
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, said = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(said)
    return pages.withColumn("rule", rule).withColumn("said", said)


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, links); pages has host and html. Links that aren't http(s) or relative are left out."""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^<>]*?href\s*=\s*["']?([^\s"'<>]*)"""), F.lit(1))
    links = pages.filter("host <> ''").select(F.col("host").alias("source"), F.explode(hrefs).alias("href"))
    outside = F.regexp_extract("href", r"^(?i:https?:)?//([^/?#]+)", 1)
    links = links.filter((outside != "") | ~F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))
    target = F.when(outside != "", F.translate(outside, ASCII_UPPER, ASCII_UPPER.lower())).otherwise(F.col("source"))
    return links.groupBy("source", target.alias("target")).agg(F.count("*").alias("links"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust). seeds: (host, trusted, blocked) in 0..1; edges: (source, target, links). Both materialized.

    Rank that a host without links in the direction of a walk has doesn't move on.
    """
    edges = edges.filter("source <> target")
    out = edges.groupBy("source").agg(F.sum("links").alias("all"))
    into = edges.groupBy("target").agg(F.sum("links").alias("all"))
    steps = edges.join(out, "source").select(F.lit("t").alias("kind"), F.col("source").alias("from"), F.col("target").alias("host"), (F.col("links") / F.col("all")).alias("share"))
    steps = materialize(steps.unionByName(edges.join(into, "target").select(F.lit("d").alias("kind"), F.col("target").alias("from"), F.col("source").alias("host"), (F.col("links") / F.col("all")).alias("share"))), "steps")
    known = seeds.unionByName(edges.select(F.explode(F.array("source", "target")).alias("host")).distinct().select("host", F.lit(0.0).alias("trusted"), F.lit(0.0).alias("blocked")))
    known = known.groupBy("host").agg(F.max("trusted").alias("trusted"), F.max("blocked").alias("blocked"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("seed")) for k, c in (("t", "trusted"), ("d", "blocked"))))
    start = known.select("host", (F.col("trusted") + F.col("blocked") > 0).alias("judged"), F.explode(kinds).alias("k")).select("k.kind", "host", "judged", "k.seed")
    start = materialize(start, "seeds")
    rank = start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score"), F.lit(1 - damping).alias("base"))
    moving = not steps.isEmpty()
    while moving:
        last = rank
        for _ in range(CUT_EVERY):
            before = rank
            moved = steps.join(before.select("kind", F.col("host").alias("from"), "score", "base"), ["kind", "from"]).groupBy("kind", "host").agg(F.sum(F.col("score") * F.col("share")).alias("s"), F.sum(F.col("base") * F.col("share")).alias("b"))
            more = lambda c: damping * F.coalesce(c, F.lit(0.0))
            rank = start.join(moved, ["kind", "host"], "left").select("kind", "host", ((1 - damping) * F.col("seed") + more("s")).alias("score"), (1 - damping + more("b")).alias("base"))
        rank = materialize(rank, "ranks")
        # All the rounds of a cut together move more than its last one, so this is on the safe side.
        change = rank.join(last.select("kind", "host", F.col("base").alias("was")), ["kind", "host"]).agg(F.sum(F.col("base") - F.col("was")), F.sum("base")).first()
        moving = change[0] > tolerance * change[1]
    own = F.when(F.col("judged"), F.col("base")).otherwise(F.col("base") - (1 - damping))
    part = F.when(own > 1e-12, F.col("score") / own).otherwise(0.0)
    parts = rank.join(start.select("kind", "host", "judged"), ["kind", "host"]).withColumn("part", part)
    pick = lambda k: F.sum(F.when(F.col("kind") == k, F.col("part")))
    return parts.groupBy("host").agg(pick("t").alias("trust"), pick("d").alias("distrust"))


def judged(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of pages (page_id, url, html)."""
    ruled = with_rule(pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules)
    share = lambda v: F.avg((F.coalesce("said", F.lit("")) == v).cast("double"))
    seeds = ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    edges = materialize(host_edges(pages.select(host(F.col("url")).alias("host"), "html")), "edges")
    scores = narrow(materialize(spread(materialize(seeds, "shares"), edges), "trust"))
    method = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "trust", "distrust")


def query(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
