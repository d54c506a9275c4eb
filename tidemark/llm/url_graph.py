"""URL filter: allow and block rules, and for hosts without a rule the link graph.

Rules name a host and the beginning of a path and hold for the host and its subdomains; the
longest that fits decides. Everything else is judged by its host. Trust spreads from hosts
whose pages are allowed along links (personalised PageRank), distrust from hosts whose pages
are blocked against the links: who links to a blocked host is distrusted. A seed weighs the
share of its pages that rules allow or block, so a rule for one section does not condemn a
host. A host is blocked where distrust exceeds trust by more than ``MARGIN``, half the weight
of a host that is a seed with all its pages.

DataFrame functions only. Pages meet the table of hosts in a broadcast join for hosts that hold
more than a hundredth of all pages (a hundred at most) and in a shuffled one for the rest;
arcs of a host with many neighbours are salted.

Null urls and urls without ``://`` have an empty host and path. Null pages (html) have no links.
Repeated rows are judged alike. Links are the absolute href of a and area tags, wherever they
stand; links within a host do not count. Weights are those of a restart of one, so they do not
depend on the number of hosts.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import empty_if_null, stored

DAMPING = 0.85
# A round passes on 0.85 of what is on its way: after 40 rounds 0.0015 of it is left.
ROUNDS = 40
SETTLED = 1e-7
MARGIN = 0.5
# Sums of doubles differ in the last places with the order of rows.
NOISE = 1e-9
# A host of more than 1 / HOT of all pages is joined by broadcast.
HOT = 100
ARCS_A_SALT = 50_000

LINK = (
    r"(?i)<a(?:rea)?(?:[\x09-\x0D\x20]|[\x09-\x0D\x20][^<>]*?[\x09-\x0D\x20\x22'])href[\x09-\x0D\x20]*="
    r"[\x09-\x0D\x20]*[\x22']?[\x09-\x0D\x20]*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\x22'<>\x09-\x0D\x20]+)"
)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of ``url``; both empty without ``://``."""
    at = F.instr(empty_if_null(url), "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    return (
        lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """``rule_host``, ``rule_path``, ``rule``, ``judgement`` from pairs like ("block", "net/")."""
    rows = []
    for judgement, rule in rules:
        if judgement not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {judgement!r}")
        host, slash, path = rule.partition("/")
        texts = (host.lower(), slash + path, rule, judgement)
        names = ("rule_host", "rule_path", "rule", "judgement")
        rows.append(F.struct(*[F.lit(t).alias(n) for t, n in zip(texts, names)]))
    if not rows:
        return spark.range(0).selectExpr(*["'' AS " + n for n in ("rule_host", "rule_path", "rule", "judgement")])
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def with_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts`` with ``rules``: those of the host and its parents, the deciding one first.

    Longest first; of equal length block before allow, then by text.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )
    met = hosts.select("host", F.explode(parents).alias("rule_host")).join(rules, "rule_host")
    one = F.struct(
        (-F.length("rule")).alias("order"),
        F.when(F.col("judgement") == "block", 0).otherwise(1).alias("side"),
        "rule",
        "rule_path",
        "judgement",
    )
    lists = met.groupBy("host").agg(F.sort_array(F.collect_set(one)).alias("rules"))
    return hosts.join(lists, "host", "left")


def deciding(rules: Column, path: Column) -> Column:
    """The first of ``rules`` whose path begins ``path``; null without one."""
    return F.get(F.filter(rules, lambda r: F.startswith(path, r["rule_path"])), F.lit(0))


def join_hosts(rows: DataFrame, hosts: DataFrame, pages: int) -> DataFrame:
    """``rows`` with the columns of their host; ``hosts`` has one row a host and counts ``n``.

    At most ``HOT`` hosts hold more than 1 / ``HOT`` of ``pages``: these are broadcast, so that
    no task of the shuffled join holds more of one host than that.
    """
    hot = F.coalesce("n", F.lit(0)) * HOT > pages
    few, rest = hosts.filter(hot).drop("n"), hosts.filter(~hot).drop("n")
    return rows.join(F.broadcast(few), "host").unionByName(
        rows.join(F.broadcast(few.select("host")), "host", "left_anti").join(rest, "host")
    )


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct ``src`` and ``dst`` hosts of links between different hosts (url, html)."""
    linked = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lowered))
    links = pages.select(url_parts(F.col("url"))[0].alias("src"), F.explode(linked).alias("dst"))
    return links.filter("src != dst AND src != ''").distinct()


def propagated(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host``, ``trust``, ``distrust`` of every host in ``seeds`` (host, allowed, blocked).

    Each round every host gives ``damping`` of its trust to the hosts it links to and of its
    distrust to those that link to it, in equal parts. Rounds end when no weight moves by more
    than ``SETTLED``; one number a round reaches the driver.
    """
    ranks = seeds.select("host", "allowed", "blocked", F.col("allowed").alias("trust"), F.col("blocked").alias("distrust"))
    forth = links.select("src", "dst", F.lit(True).alias("trusts"))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(False).alias("trusts"))
    arcs = forth.union(back)
    degrees = arcs.groupBy("src").agg(
        F.count(F.when(F.col("trusts"), 1)).alias("out_links"), F.count(F.when(~F.col("trusts"), 1)).alias("in_links")
    )
    degrees = degrees.withColumn("salts", F.ceil((F.col("out_links") + F.col("in_links")) / ARCS_A_SALT).cast("int"))
    drawn = F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int")
    arcs = stored(arcs.join(degrees, "src").select("src", drawn.alias("salt"), "dst", "trusts"), "arcs")
    if arcs.isEmpty():
        return ranks.select("host", "trust", "distrust")
    salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    parts = stored(seeds.join(degrees.withColumnRenamed("src", "host"), "host", "left"), "nodes")
    ranks = parts.select("*", F.col("allowed").alias("trust"), F.col("blocked").alias("distrust"))
    for _ in range(rounds):
        given = ranks.filter("salts IS NOT NULL").select(
            F.col("host").alias("src"),
            F.explode(salts).alias("salt"),
            F.try_divide(damping * F.col("trust"), F.col("out_links")).alias("trust_given"),
            F.try_divide(damping * F.col("distrust"), F.col("in_links")).alias("distrust_given"),
        )
        got = (
            arcs.join(given, ["src", "salt"])
            .groupBy(F.col("dst").alias("host"))
            .agg(
                F.sum(F.when(F.col("trusts"), F.col("trust_given"))).alias("trust_got"),
                F.sum(F.when(~F.col("trusts"), F.col("distrust_given"))).alias("distrust_got"),
            )
        )
        trust = F.col("allowed") + F.coalesce("trust_got", F.lit(0.0))
        distrust = F.col("blocked") + F.coalesce("distrust_got", F.lit(0.0))
        moved = F.greatest(F.abs(trust - F.col("trust")), F.abs(distrust - F.col("distrust")))
        ranks = stored(
            ranks.drop("moved").join(got, "host", "left").select(
                *parts.columns, trust.alias("trust"), distrust.alias("distrust"), moved.alias("moved")
            ),
            "ranks",
        )
        if ranks.agg(F.max("moved")).first()[0] <= SETTLED:
            break
    return ranks.select("host", "trust", "distrust")


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", margin: float = MARGIN) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (null without one) and ``verdict`` of every page.

    ``pages`` needs ``key``, ``url`` and ``html``; ``rules`` is a ``rule_table``. The rules of one
    host and its parents are one value: the list of rules bounds it, not the pages.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    links = stored(host_links(pages), "links")
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    met = links.select(F.col("src").alias("host")).union(links.select("dst")).distinct()
    hosts = counts.join(met, "host", "full_outer")
    hosts = stored(with_rules(hosts, rules), "hosts")
    count = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    with_pages = hosts.filter("n IS NOT NULL")
    rule = deciding(F.col("rules"), F.col("path"))
    ruled = join_hosts(rows, with_pages, count).select("key", "host", "path", rule.alias("r"))
    ruled = stored(ruled.select("key", "host", "path", "r.rule", "r.judgement"), "ruled")
    share = lambda side: F.coalesce(F.avg((F.col("judgement").eqNullSafe(side)).cast("double")), F.lit(0.0))
    seen = ruled.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    # A host known from links only is a seed where a rule holds for its root.
    root = deciding(F.col("rules"), F.lit("/"))["judgement"]
    unseen = hosts.filter("n IS NULL").select(
        "host",
        root.eqNullSafe("allow").cast("double").alias("allowed"),
        root.eqNullSafe("block").cast("double").alias("blocked"),
    )
    ranks = propagated(links, seen.unionByName(unseen))
    verdicts = with_pages.select("host", "n").join(ranks, "host").select(
        "host", "n", F.when(F.col("distrust") - F.col("trust") > margin + NOISE, "block").otherwise("allow").alias("by_links")
    )
    return join_hosts(ruled, verdicts, count).select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("judgement", "by_links").alias("verdict")
    )
