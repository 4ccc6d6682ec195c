"""URL filters by rules and by propagation over the link graph (operator 4).

A rule is a host and a path prefix; it fits the host and its subdomains, and the
longest fitting rule decides.  Pages without a rule are judged by their host:
hosts with allowed pages are trusted seeds and hosts with blocked pages distrusted
seeds, each kind with a mass of 1 shared by its pages; personalised PageRank carries
trust along host links and distrust against them, and a host is blocked if its distrust
exceeds ``threshold`` times its trust: at 1, if a walk from the blocked seeds is more
likely to be there than one from the trusted seeds.

Everything is DataFrame operations.  Links are summed to weighted host edges first,
so the iteration sees hosts, not pages.  Each round is written to the shared
folder, which cuts the lineage, until the scores have converged.  Mass at a host without links is not passed on.

A null url, or one without ``://``, has an empty host and path, fits no rule and is
judged as the host ``''``.  Pages without links, null pages, repeated rows and an
empty table need no special rule; very long pages are searched for links whole.  Equal
urls get equal verdicts, and equal scores are a tie that allows.  Extra columns are kept
by :func:`judge`; those named as the result's are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import LOWER, UPPER, free_name, remove, scratched, shared_path, staged

LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The fitting rule's text and verdict as a struct, or null.  ``rules`` is a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted over all pages."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))
    links = pages.select(host.alias("src"), F.explode(targets).alias("dst")).where("src <> dst AND src <> ''")
    return links.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Personalised PageRank of every kind at once.

    ``edges`` has (kind, src, dst, weight), ``seeds`` has (kind, host, mass).
    Returns (kind, host, score).  Scores only grow from round to round; stops when
    none grows by more than ``tolerance`` of itself, which no host does that was
    reached just now, or after ``rounds`` if given.
    """
    spark = edges.sparkSession
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    flow = staged(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total") * damping).alias("share")), "url-flow")
    base = staged(seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("score")), "url-seeds")
    score, path = base, None
    for _ in itertools.count() if rounds is None else range(rounds):
        moved = flow.join(score.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score"))
        new = shared_path(spark, "url-scores")
        base.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score")).write.parquet(new)
        after = spark.read.schema(base.schema).parquet(new)
        both = after.withColumnRenamed("score", "now").join(score, ["kind", "host"], "left")
        grows = both.agg(F.max(F.col("now") - F.coalesce("score", F.lit(0.0)) > F.lit(tolerance) * F.col("now"))).first()[0]
        if path:
            remove(spark, path)
        score, path = after, new
        if not grows:
            break
    return score


@scratched
def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html", threshold: float = 1.0, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust; columns with
    these names are replaced, and the html column is left out."""
    made = ["host", "path", "rule", "verdict", "trust", "distrust"]
    own = [c for c in pages.columns if c.lower() not in made and c != html]
    link = F.col(f"`{url}`").cast("string")
    found, key = free_name(pages, "__found"), free_name(pages, "__host")
    host, path = url_host(link), url_path(link)
    small = pages.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"), longest_rule(host, path, rules).alias(found))

    counted = staged(small.groupBy("host").agg(F.count_if(F.col(f"{found}.verdict") == "allow").alias("trust"), F.count_if(F.col(f"{found}.verdict") == "block").alias("distrust")), "url-hosts")
    totals = counted.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    seeds = counted.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "pages")).where("pages > 0")
    # Each kind's seeds share a mass of 1, so that its scores are a distribution and one kind's number of pages doesn't count.
    mass = F.when(F.col("kind") == "trust", F.lit(max(totals["trust"] or 0, 1))).otherwise(F.lit(max(totals["distrust"] or 0, 1)))
    seeds = seeds.select("kind", "host", (F.col("pages") / mass).alias("mass"))
    edges = staged(host_edges(pages, host, F.col(f"`{html}`").cast("string")), "url-edges")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    scores = propagate(both, seeds, damping, rounds)
    hosts = scores.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    hosts = hosts.select(F.col("host").alias(key), "trust", "distrust")
    joined = small.join(hosts, small["host"] == F.col(key), "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    by_host = F.when(F.col("distrust") > F.lit(threshold) * F.col("trust"), "block").otherwise("allow")
    return joined.select(
        *[F.col(f"`{c}`") for c in own],
        "host",
        "path",
        F.col(f"{found}.rule").alias("rule"),
        F.coalesce(F.col(f"{found}.verdict"), by_host).alias("verdict"),
        "trust",
        "distrust",
    )
