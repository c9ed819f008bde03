"""URL filters: rules by host and path, and trust propagated over the link graph.

Trust is a personalised PageRank from hosts that allow rules cover; distrust is one over reversed
links from hosts that block rules cover, since who links to bad hosts is suspect. Both run as one
iterated join over the pre-aggregated host edges and are thresholded per host. Only what a rule
doesn't decide is left to the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.shared import dropped, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links with a host of their own, from href attributes.
LINK = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'<>\s]+)"
DAMPING, ROUNDS, CLOSE = 0.85, 50, 1e-6
#: Labels that a host's name has at most.
MOST_LABELS = 127
#: A host is blocked if its distrust exceeds its trust and this: what a host has that is blocked by half, without any link.
LEAST = 0.5 * (1 - DAMPING)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(pages: DataFrame, rules: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """pages (host, path, ...) with rule and rule_verdict: the longest rule (host, path, verdict) that fits; and with the columns of scores (host, ...).

    A rule fits its host and all subdomains if the path starts with the rule's. Hosts are looked up
    by their suffixes, distinct hosts only, so the rules may be many; of two equal rules block wins.
    """
    hosts = pages.select("host").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    kept = rules.select(F.col("host").alias("suffix"), F.struct(F.length(F.concat("host", "path")).alias("size"), F.col("verdict"), F.concat("host", "path").alias("rule"), F.col("path").alias("start")).alias("one"))
    fits = hosts.withColumn("suffix", suffix).join(kept, "suffix").groupBy("host").agg(F.collect_list("one").alias("rules"))
    fits = fits if scores is None else written(fits.join(scores, "host", "full"))  # written: else the join can't split a hot host
    best = F.array_max(F.filter("rules", lambda r: F.startswith("path", r["start"])))
    return pages.join(fits, "host", "left").withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.verdict")).drop("rules", "best")


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """host, trust, distrust from seeds (host, trust, distrust: shares of 1) over edges (src, dst, links).

    score = (1 - damping) * seed + damping * sum of shares of the neighbours' scores, trust along
    links, distrust against them; repeated until nothing changes by more than close.
    """
    edges = edges.filter("src <> dst and src <> '' and dst <> ''")
    out, into = (edges.groupBy(side).agg(F.sum("links").alias(f"of_{side}")) for side in ("src", "dst"))
    edges = edges.join(out.hint("merge"), "src").join(into.hint("merge"), "dst").withColumn("forth", F.col("links") / F.col("of_src")).withColumn("back", F.col("links") / F.col("of_dst"))
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), F.col("forth").alias("part")).unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), F.col("back").alias("part"))
    )
    ways = written(ways)
    own = seeds.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(k) * (1 - damping)).alias("own")) for k in ("trust", "distrust")])).alias("s")).select("host", "s.*")
    own = written(own.filter("own > 0"))
    scores = own.withColumnRenamed("own", "score")
    if not ways.isEmpty():
        for _ in range(rounds):
            moved = ways.join(scores, ["host", "kind"]).groupBy(F.col("to").alias("host"), "kind").agg((F.sum(F.col("part") * F.col("score")) * damping).alias("got"))
            now = own.join(moved, ["host", "kind"], "full").select("host", "kind", (F.coalesce("own", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("score"))
            now = written(now)
            change = now.join(scores.withColumnRenamed("score", "was"), ["host", "kind"], "left").agg(F.max(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))))).first()[0]
            dropped(scores)
            scores = now
            if change is None or change <= close:
                break
    sums = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")}
    return scores.groupBy("host").agg(sums["trust"], sums["distrust"])


def family(parsed: DataFrame) -> DataFrame:
    """(src, dst) both ways between each host and its parent, that between its parent and the parent's, and so on, whether parents have pages or not.

    The last parent has two labels: a bare top-level domain has no owner. Addresses of digits, and hosts of more labels than
    names can have, have no parents.
    """
    labels = F.split("host", r"\.")
    hosts = parsed.select("host").distinct().filter((F.size(labels) <= MOST_LABELS) & ~F.col("host").rlike(r"^[0-9.]*$"))
    line = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.transform(F.slice("line", F.lit(2), F.size("line")), lambda up, i: F.struct(F.get("line", i).alias("src"), up.alias("dst")))
    up = hosts.filter(F.size(labels) > 2).withColumn("line", line).select(F.explode(steps).alias("e")).select("e.*").distinct()
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def judged(pages: DataFrame, rules: DataFrame, least: float = LEAST, families: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of pages (page_id, url, html).

    The verdict is that of the longest rule that fits, or the graph's: block if the host's distrust
    is above its trust and above least, else allow. Edges are the links between hosts, and with families
    one link each way between a host and the host it is a subdomain of, see family(). A host's seeds are the shares of its pages that
    rules allow and block. A null url, or one without ://, has an empty host and path, no links, and is allowed;
    null html has no links; repeated rows count as pages. An empty table gives an empty result.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = matched(parsed, rules)
    share = lambda v: (F.count_if(F.col("rule_verdict") == v) / F.count("*"))
    seeds = ruled.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")).filter("trust > 0 or distrust > 0")
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.unionByName(family(parsed)) if families else links
    edges = links.groupBy("src", F.translate("dst", UPPER, LOWER).alias("dst")).agg(F.count("*").alias("links"))
    scores = propagated(seeds, edges)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least)
    out = matched(parsed, rules, scores)  # one join of pages for both, so that a hot host can be split
    graph = F.when(bad & (F.col("host") != ""), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", graph).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


#: The rules of the contract, as host, path and verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op7_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages by the contract's rules and the graph. See judged() for every edge case; long pages are searched whole."""
    return judged(table(spark, sf_dir, "pages"), spark.sql("select * from values " + ", ".join(map(str, RULES)) + " as t(host, path, verdict)")).drop("trust", "distrust")
