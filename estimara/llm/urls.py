"""URL filters: longest-rule verdicts, and trust and distrust propagated over links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, stage

#: (allow or block, host and path) as text.
Rule = tuple[str, str]
#: Rules that are looked up in an expression; more are a table, joined.
MAX_RULES = 10_000
#: Rounds until what still flows is below the tolerance, even in a graph of cycles.
DAMPING, ROUNDS, TOLERANCE = 0.85, 130, 1e-9
#: A host is blocked if its distrust is above its trust by this: alone, if over half of its pages are blocked.
THRESHOLD = (1 - DAMPING) / 2
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; empty without a ://."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def endings(host: Column, most: int) -> Column:
    """The host's endings of 1 to ``most`` labels, none longer than the host; no rule is longer, so a host of very many labels costs no more."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda i: F.array_join(F.slice(labels, -i, i), "."))


def rules_joined(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """``parts`` (with host and path) with hit, as by ``rule_for``, for a table of any number of rules (rule, verdict).

    Each distinct (host, path) is joined by its endings once; the join back is by (host, path).
    """
    known = stage(rules.where("rule is not null").select(F.substring_index("rule", "/", 1).alias("rule_host"), F.length("rule").alias("size"), "rule", "verdict").distinct(), "rules")
    known = known.withColumn("path", F.substring("rule", F.length("rule_host") + 1, F.col("size")))
    n, most = known.agg(F.count("*"), F.max(F.size(F.split("rule_host", r"\.")))).first()
    asked = parts.select("host", F.col("path").alias("own_path")).distinct().select("host", "own_path", F.explode(F.array_distinct(endings(F.col("host"), most or 1))).alias("rule_host"))
    fits = asked.join(small(known, n), "rule_host").where(F.startswith("own_path", F.col("path")))
    best = fits.groupBy("host", F.col("own_path").alias("path")).agg(F.max(F.struct("size", "rule", "verdict", "path")).alias("hit"))
    return parts.join(best, ["host", "path"], "left")


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(size, rule, verdict, path) of the longest rule that fits, or null: the host's endings are looked up in a map of the rules."""
    by_host: dict[str, list[Rule]] = {}
    for verdict, rule in rules:
        by_host.setdefault(rule.partition("/")[0], []).append((verdict, rule))
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string,path:string>")
    entry = lambda v, r: F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r[len(r.partition("/")[0]) :]).alias("path"))
    known = F.create_map(*(x for h, own in sorted(by_host.items()) for x in (F.lit(h), F.array(*(entry(v, r) for v, r in own)))))
    most = max(h.count(".") + 1 for h in by_host)
    there = F.flatten(F.filter(F.transform(endings(host, most), lambda e: F.try_element_at(known, e)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(there, lambda r: F.startswith(path, r["path"])))


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, share): links between different hosts, each page's host sharing itself out by its links."""
    found = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), 1)).alias("dst")).select("src", lowered("dst").alias("dst"))
    counted = found.where("src <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return counted.join(counted.groupBy("src").agg(F.sum("n").alias("all")), "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: (host, value) with value = (1 - damping) seed + damping * the sum over edges (src, dst, share) into the host."""
    start = stage(seeds.where("seed > 0").select("host", ((1 - damping) * F.col("seed")).alias("value")), "seeds")
    now = flow = start
    for _ in range(rounds):
        # What flows on in a round is what came in the round before.
        flow = stage(flow.join(edges, flow["host"] == edges["src"]).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("value") * F.col("share"))).alias("value")), "flow")
        if (flow.agg(F.max("value")).first()[0] or 0) < tolerance:
            break
        now = stage(now.unionByName(flow).groupBy("host").agg(F.sum("value").alias("value")), "rank")
    return now


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] | DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict, a row for each row of ``pages``.

    The longest rule that fits decides. Else the host does: trust flows along
    links from hosts with allowed pages, distrust against them from hosts with
    blocked pages (each seed is the share of the host's pages); where distrust
    exceeds trust by ``threshold``, block, else allow. A null url, or one without
    ://, has an empty host and path, fits no rule and is allowed; a null html has
    no links. Repeated rows stay repeated and count each time. Of rules of one
    text, block counts. A table of rules (rule, verdict) may have any number. An
    empty table of pages gives an empty result; other columns aren't looked at.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    parts = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not isinstance(rules, DataFrame) and len(rules) > MAX_RULES:
        rules = pages.sparkSession.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")
    fitted = rules_joined(parts, rules) if isinstance(rules, DataFrame) else parts.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    judged = stage(fitted.select("page_id", "host", "path", "hit.rule", F.col("hit.verdict").alias("by_rule")), "urls")
    share = lambda v: F.avg(F.coalesce((F.col("by_rule") == v).cast("double"), F.lit(0.0))).alias(v)
    seeds = stage(judged.where("host <> ''").groupBy("host").agg(share("allow"), share("block")), "host-seeds")
    links = stage(host_links(rows), "links")
    trust = propagated(seeds.select("host", F.col("allow").alias("seed")), links)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share")
    given = back.groupBy("src").agg(F.sum("share").alias("all"))
    distrust = propagated(seeds.select("host", F.col("block").alias("seed")), back.join(given, "src").select("src", "dst", (F.col("share") / F.col("all")).alias("share")))
    both = trust.select("host", F.col("value").alias("trust")).join(distrust.select("host", F.col("value").alias("distrust")), "host", "full_outer")
    scores = both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    bad = scores.where(F.col("distrust") - F.col("trust") > threshold).select("host", F.lit(True).alias("bad"))
    verdict = F.coalesce("by_rule", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.join(bad, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
