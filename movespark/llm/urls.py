"""URL filters: rules by host and path, and link-graph propagation for the pages that no rule fits.

Hosts are joined by edges: the links of their pages to other hosts, and the step from a subdomain to the
domain it belongs to. Trust is a PageRank personalised on hosts by their allowed pages; distrust one on hosts by
their blocked pages over the reversed edges. A host whose distrust exceeds its trust is blocked. Everything is made
of DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lower_az, stage

#: (host and path, verdict): a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
STEPS, DAMPING = 8, 0.85
#: Steps between two looks at the masses, the largest relative change of one at which they stand, and what tells two apart.
LOOK, TOLERANCE, TIE = 4, 1e-7, 1e-6
#: More rules than this are joined by host suffix instead of being tried one after another.
INLINE = 64


def host_of(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    host, slash, rest = rule.partition("/")
    return host, slash + rest


def match_rules(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds rule and rule_verdict, null where no rule fits, to rows with host and path. The longest rule wins."""
    if len(rules) <= INLINE:
        rule = verdict = F.lit(None).cast("string")
        for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
            host, path = _split(text)
            fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
            rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
        return pages.withColumns({"rule": rule, "rule_verdict": verdict})
    known = pages.sparkSession.createDataFrame([(*_split(t), t, v) for t, v in rules], "r_host string, r_path string, r string, v string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    urls = pages.select("host", "path").distinct()
    fits = urls.withColumn("r_host", F.explode(suffixes)).join(known, "r_host").where(F.startswith("path", F.col("r_path")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("r").alias("n"), "r", "v")).alias("m"))
    best = best.select("host", "path", F.col("m.r").alias("rule"), F.col("m.v").alias("rule_verdict"))
    return pages.join(best, ["host", "path"], "left")


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct edges (src, dst, links) between different hosts, from rows with host and html."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""), F.lit(1))
    out = pages.where(F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(links).alias("url"))
    # a link that begins with // takes the scheme of its page
    url = F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    out = out.select("src", host_of(url).alias("dst"))
    up = pages.select("host").distinct().select(F.col("host").alias("src"), F.explode(_parents(F.col("host"))).alias("edge"))
    tree = up.select(F.col("edge.src").alias("src"), F.col("edge.dst").alias("dst"))
    both = out.unionByName(tree).where("src <> '' and dst <> '' and src <> dst")
    return both.groupBy("src", "dst").agg(F.count("*").alias("links"))


def _parents(host: Column) -> Column:
    """The steps from a host up to its domain of two labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    step = lambda k: F.struct(F.array_join(F.slice(labels, k, n), ".").alias("src"), F.array_join(F.slice(labels, k + 1, n), ".").alias("dst"))
    return F.when(n > 2, F.transform(F.sequence(F.lit(1), n - 2), step)).otherwise(F.array().cast("array<struct<src:string,dst:string>>"))


def personalised(seeds: DataFrame, edges: DataFrame, score: str, steps: int, damping: float) -> DataFrame:
    """Rows (host, score): mass of the seeds (host, weight) over edges (src, dst, links), after at least so many steps.

    Each step sends damping of a host's mass along its edges by their links, and returns the rest to the seeds.
    Steps go on until no host is new and no mass changes by more than a share of TOLERANCE. The sum of a host's incoming
    mass is aggregated before the shuffle; the lineage is cut at every look.
    """
    total = seeds.agg(F.sum("weight")).collect()[0][0] or 1.0
    start = stage(seeds.select("host", (F.col("weight") / total).alias("mass")), "seeds")
    degree = edges.groupBy("src").agg(F.sum("links").alias("degree"))
    flow = stage(edges.join(degree, "src").select("src", "dst", (damping * F.col("links") / F.col("degree")).alias("share")), "flow")
    old, done, change = start, 0, math.inf
    while done < steps or change > TOLERANCE:
        mass = old
        for _ in range(LOOK):
            sent = mass.join(flow, mass.host == flow.src).select(F.col("dst").alias("host"), (F.col("mass") * F.col("share")).alias("mass"))
            mass = sent.unionByName(start.select("host", ((1 - damping) * F.col("mass")).alias("mass"))).groupBy("host").agg(F.sum("mass").alias("mass"))
        mass, done = stage(mass, "mass"), done + LOOK
        both = mass.join(old.select("host", F.col("mass").alias("old")), "host", "left")
        change = both.agg(F.max(F.abs(F.col("mass") - F.coalesce("old", F.lit(0.0))) / F.col("mass"))).collect()[0][0] or 0.0
        if old is not start:
            discard(old)
        old = mass
    return old.select("host", F.col("mass").alias(score))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, trust, distrust), one for each row of pages (page_id, url, html).

    Null urls and those without :// have an empty host and path, fit no rule and are allowed. Null html has no
    links. A host that neither trust nor distrust reaches, and one with as much of both, is allowed. Other columns are
    ignored; repeated rows get equal verdicts and each counts as a seed; an empty table gives an empty one.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = match_rules(named, rules)
    # all that propagation needs, by host, aggregated before the shuffle
    seeds = ruled.where("rule is not null and host <> ''").groupBy("host", "rule_verdict").agg(F.count("*").cast("double").alias("weight"))
    seeds = stage(seeds, "ruled")
    edges = stage(host_edges(named), "edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    trust = personalised(seeds.where("rule_verdict = 'allow'").select("host", "weight"), edges, "trust", steps, damping)
    doubt = personalised(seeds.where("rule_verdict = 'block'").select("host", "weight"), back, "distrust", steps, damping)
    scores = stage(trust.join(doubt, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "scores")
    out = ruled.drop("html").join(scores, "host", "left")
    bad = F.coalesce(F.col("distrust") > F.col("trust") * (1 + TIE), F.lit(False))
    verdict = F.coalesce("rule_verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.withColumns({"trust": F.round("trust", 9), "distrust": F.round("distrust", 9)})
