"""URL filters: rules by host and path, and trust and distrust that spread over links between hosts.  DataFrame only."""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fits_broadcast, written

#: (verdict, host/path) rules of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Up to so many rules are literals of the plan; more become a table that hosts' domains are joined to.
MAX_RULES = 200


@dataclass(frozen=True)
class Options:
    """damping of the propagation, which ends when all that is still under way is no more than ``still`` of all trust and distrust,
    or after ``rounds`` if that is set.  seed_share: share of a host's pages under one verdict from which the host is a seed.  margin: distrust that
    blocks a host, as a multiple of the even share 1/hosts, if it is also more than the host's trust."""

    damping: float = 0.85
    rounds: int | None = None
    still: float = 1e-6
    seed_share: float = 0.5
    margin: float = 0.1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased; path: then up to ? # or end; both empty if there is none."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, pattern, 2)


def domains_of(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def with_rule(rows: DataFrame, rules=RULES, most_literals: int = MAX_RULES) -> DataFrame:
    """``rows`` (host, path, more) with fit, the rule of matching_rule."""
    if len(rules) <= most_literals:
        return rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    parts = [(rule.partition("/")[0], "/" + rule.partition("/")[2], len(rule), rule, verdict) for verdict, rule in rules]
    table = rows.sparkSession.createDataFrame(parts, "domain string, start string, n int, rule string, verdict string")
    keys = rows.select("host", "path").distinct().withColumn("domain", F.explode(domains_of(F.col("host"))))
    fits = keys.join(table, "domain").where(F.startswith("path", F.col("start")))
    fit = F.max(F.struct("n", "rule", "verdict", F.col("start").alias("path"))).alias("fit")
    return rows.join(fits.groupBy("host", "path").agg(fit), ["host", "path"], "left")


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (n, rule, verdict) of the longest rule that fits the host or a parent domain and the path's start, else null."""
    by_host: dict[str, list[tuple[int, str, str, str]]] = {}
    for verdict, rule in rules:
        domain, _, rest = rule.partition("/")
        by_host.setdefault(domain, []).append((len(rule), rule, verdict, "/" + rest))
    if not by_host:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string,path:string>")
    row = lambda r: F.struct(F.lit(r[0]).alias("n"), F.lit(r[1]).alias("rule"), F.lit(r[2]).alias("verdict"), F.lit(r[3]).alias("path"))
    table = F.create_map(*[x for d, rs in by_host.items() for x in (F.lit(d), F.array(*map(row, rs)))])
    fits = F.flatten(F.filter(F.transform(domains_of(host), lambda d: table[d]), lambda rs: rs.isNotNull()))
    return F.array_max(F.filter(fits, lambda r: F.startswith(path, r["path"])))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of a host to pages of another, from absolute href attributes."""
    pattern = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("to"))
    links = links.select("src", F.translate("to", string.ascii_uppercase, string.ascii_lowercase).alias("dst"))
    return links.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, options: Options = Options()) -> DataFrame:
    """(host, trust, distrust) from links (src, dst, n) and seeds (host, trusted, blocked), weights of each summing to 1.

    Personalised PageRank carries trust along links, in shares of each host's links; distrust goes the other way,
    from a host to those that link to it, in shares of its incoming links.  Both walk in one pass over the edges;
    every round is written to the shared folder, so its lineage stays short and a lost executor costs one round.
    Hosts with very many links meet them without a shuffle, and flows are added up before theirs.
    """
    d = options.damping
    out_of = links.groupBy("src").agg(F.sum("n").alias("out_n"))
    into = links.groupBy("dst").agg(F.sum("n").alias("in_n"))
    edges = links.join(out_of, "src").join(into, "dst")
    forward = edges.select(F.col("src").alias("giver"), F.col("dst").alias("taker"), (F.col("n") / F.col("out_n")).alias("t"), F.lit(0.0).alias("b"))
    backward = edges.select(F.col("dst").alias("giver"), F.col("src").alias("taker"), F.lit(0.0).alias("t"), (F.col("n") / F.col("in_n")).alias("b"))
    shares = written(forward.unionByName(backward).groupBy("giver", "taker").agg(F.sum("t").alias("t"), F.sum("b").alias("b")))
    fan = written(shares.groupBy(F.col("giver").alias("host")).agg(F.count(F.lit(1)).alias("n")))
    start = seeds.select("host", ((1 - d) * F.col("trusted")).alias("trust"), ((1 - d) * F.col("blocked")).alias("distrust"))
    kept = [F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")]
    scores = start = written(start.groupBy("host").agg(*kept))
    if not shares.head(1):
        return scores
    links_of = shares.withColumnRenamed("giver", "host")
    line = max(1_000, (fan.agg(F.sum("n")).first()[0] or 0) // 100_000)
    hubs = fan.where(F.col("n") > line).select("host")  # no more than 100,000, by the share of all links that each has
    has_hubs = bool(hubs.head(1))
    few = F.broadcast(hubs)
    of_hubs, of_others = (written(links_of.join(few, "host")), written(links_of.join(few, "host", "left_anti"))) if has_hubs else (None, links_of)
    # a round passes on d of what the round before passed on, so after k rounds d**k of all is still under way
    most = options.rounds if options.rounds is not None else math.ceil(math.log(options.still) / math.log(d))
    for k in range(1, most + 1):
        met = of_others.join(scores, "host")
        if has_hubs:
            met = met.unionByName(of_hubs.join(F.broadcast(scores.join(few, "host", "left_semi")), "host"))
        flow = met.select(F.col("taker").alias("host"), (d * F.col("t") * F.col("trust")).alias("trust"), (d * F.col("b") * F.col("distrust")).alias("distrust"))
        before, scores = scores, written(start.unionByName(flow).groupBy("host").agg(*kept))
        ends = False
        if k % 5 == 0:  # what moved in this round bounds what will: all mass may have left the graph by dead ends
            moved = scores.unionByName(before.select("host", (-F.col("trust")).alias("trust"), (-F.col("distrust")).alias("distrust")))
            moved = moved.groupBy("host").agg(F.sum("trust").alias("t"), F.sum("distrust").alias("b"))
            ends = (moved.agg(F.sum(F.abs("t") + F.abs("b"))).first()[0] or 0.0) * d / (1 - d) <= options.still
        if before is not start:
            discard(before)
        if ends:
            break
    return scores


def judge(pages: DataFrame, *, rules=RULES, id_col: str = "page_id", options: Options = Options()) -> DataFrame:
    """Verdict on every url: id, host, path, rule, verdict, trust, distrust.

    The longest fitting rule decides; without one the host's propagated scores do.  Hosts most of whose pages a
    block (allow) rule decides are the seeds.  A host that no score reaches is allowed, and so is a url without a
    host.  Null html has no links; a very long html is read whole; repeated rows count as pages of their own; a null id stays null;
    an empty table gives an empty table; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), "url", "html").withColumn("host", host).withColumn("path", path)
    rows = with_rule(rows, rules)
    verdict = F.col("fit.verdict")
    hosts = rows.where(F.col("host") != "").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum((verdict == "allow").cast("long")).alias("a"), F.sum((verdict == "block").cast("long")).alias("b")
    )
    weigh = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) >= options.seed_share * F.col("n"), F.coalesce(F.col(c), F.lit(0)) / F.col("n")).otherwise(0.0)
    seeds = written(hosts.select("host", weigh("a").alias("trusted"), weigh("b").alias("blocked")))
    total = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b"), F.count(F.lit(1)).alias("n")).first()
    even = seeds.select("host", (F.col("trusted") / F.lit(total["t"] or 1.0)).alias("trusted"), (F.col("blocked") / F.lit(total["b"] or 1.0)).alias("blocked"))
    scores = propagate(host_links(rows.select("host", "html")), even, options)
    scores = scores.select(F.col("host").alias("h"), "trust", "distrust")
    known = scores.count()
    if fits_broadcast(known, 120):
        scores = F.broadcast(scores)
    joined = rows.drop("url", "html").join(scores, F.col("host") == F.col("h"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad = (distrust > trust) & (distrust >= F.lit(options.margin * (1 - options.damping) / max(known, 1)))
    return joined.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
