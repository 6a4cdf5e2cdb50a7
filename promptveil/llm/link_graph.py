"""URL filter: rules by host and path, and for the rest trust and distrust propagated over the links between hosts.

A rule fits a url whose host is the rule's or a subdomain of it and whose path starts with the rule's; the longest rule
wins (host and path together, then the host alone). Up to ``IN_PLAN`` rules are one expression; more are joined by
(host suffix, start of the path), and both forms agree.

A host is trusted where rules allow over half of its pages, and blocked where they block over half. Trust spreads from
the trusted hosts along links, distrust from the blocked ones against them: personalised PageRank, ``ROUNDS`` rounds, a
host keeping 15 hundredths of what arrives and dealing 85 evenly to its neighbours (a host without any deals nothing).
Amounts are whole numbers, ``MASS`` in all for each kind, so results don't depend on the order of sums. A host is blocked
by the method if its distrust is above its trust and is at least the share that an average host would have.

Links are the hosts of absolute and protocol-relative ``href`` values; links within a host don't count, nor how often a
host links to another. All steps are joins and sums over (host, part) rows: a host's links are dealt over ``PARTS`` parts,
so no host with many links is one key.

Null urls and urls without ``://`` have empty host and path, no rule, and are allowed, as an empty host is in no graph.
A null page counts as one without links. Repeated rows count each time and are all returned. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptveil.session import read_bounded, written

#: (host, path, verdict), fixed values of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
IN_PLAN = 200
ROUNDS = 20
MASS = 10 ** 16
PASSED = 85
PARTS = 64
HREF = r"""(?i)\bhref[ \t\r\n]*=[ \t\r\n]*["']?[ \t\r\n]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<> \t\r\n]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _place(rule: Sequence[str]) -> tuple:
    return -len(rule[0]) - len(rule[1]), -len(rule[0]), *rule


def rule_in_plan(host: Column, path: Column, rules: Sequence[Sequence[str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for own, start, verdict in sorted(rules, key=_place, reverse=True):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ruled_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, found) for the (host, path) of ``urls`` that a rule fits; ``rules`` is any number of (host, path,
    verdict). Only suffixes as long as a rule's host and starts as long as a path of that host's rules are looked up."""
    known = rules.select(F.col("host").alias("own"), F.col("path").alias("start"), "verdict")
    longest = known.agg(F.max(F.size(F.split("own", r"\."))).alias("n")).head()["n"] or 0
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, longest)))),
                           lambda n: F.array_join(F.slice(labels, -n, n), "."))
    lengths = known.groupBy("own").agg(F.collect_set(F.length("start")).alias("sizes"))
    asked = (urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("own")).join(lengths, "own")
             .select("host", "path", "own", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n"))
             .select("host", "path", "own", F.expr("substr(path, 1, n)").alias("start")))
    rank = F.struct(F.length("own") + F.length("start"), F.length("own"))
    order = Window.partitionBy("own", "start").orderBy("verdict")  # allow before block where a rule is given twice
    once = known.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return asked.join(once, ["own", "start"]).groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("own", "start").alias("rule"), "verdict"), rank).alias("found"))


def ruled(pages: DataFrame, rules: Sequence[Sequence[str]] | DataFrame = RULES, page_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, html, host, path, found) for every row; found is struct(rule, verdict) or null."""
    rows = pages.select(F.col(page_col).alias("page"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    if isinstance(rules, DataFrame):
        few = read_bounded(rules.select("host", "path", "verdict").distinct(), IN_PLAN)
        if few is None:
            hits = ruled_join(rows, rules).withColumnsRenamed({"host": "of", "path": "at"})
            return rows.join(hits, (F.col("host") == F.col("of")) & (F.col("path") == F.col("at")), "left").drop("of", "at")
        rules = [tuple(r) for r in few]
    return rows.withColumn("found", rule_in_plan(F.col("host"), F.col("path"), rules))


def host_links(rows: DataFrame) -> DataFrame:
    """Distinct (src, dst) of rows (host, html)."""
    named = F.explode(F.regexp_extract_all("html", F.lit(HREF), 1))
    return (rows.where("host <> ''").select(F.col("host").alias("src"), named.alias("name"))
            .select("src", F.translate("name", _UPPER, _LOWER).alias("dst")).where("src <> dst").distinct())


def seeds(hosts: DataFrame, mass: int = MASS) -> DataFrame:
    """(kind, host, fresh): the trusted and the blocked hosts of (host, n, n_allow, n_block), with equal amounts."""
    kind = F.when(F.expr("2 * n_allow > n"), "trust").when(F.expr("2 * n_block > n"), "distrust")
    chosen = hosts.select(kind.alias("kind"), "host").where("kind IS NOT NULL")
    return chosen.join(chosen.groupBy("kind").agg(F.count("*").alias("of")), "kind").select(
        "kind", "host", F.expr(f"{mass} div of").alias("fresh"))


def propagated(links: DataFrame, start: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, mass) from links (src, dst) and amounts (kind, host, fresh). Trust follows links, distrust runs
    against them. Every round is one stored table of a row for each host reached."""
    both = links.select(F.lit("trust").alias("kind"), "src", "dst").unionAll(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = written(both.withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(PARTS))), "link-edges")
    degrees = written(edges.groupBy("kind", "src", "part").agg(F.count("*").alias("n")).groupBy("kind", "src")
                      .agg(F.sum("n").alias("out"), F.collect_list("part").alias("parts"))
                      .withColumnRenamed("src", "host"), "link-degrees")

    def kept(fresh: str) -> Column:
        return F.expr(f"{fresh} * {100 - PASSED} div 100").alias("mass")

    state = written(start.select("kind", "host", "fresh", kept("fresh")), "link-state")
    for _ in range(rounds):
        dealt = (state.where("fresh > 0").join(degrees, ["kind", "host"])
                 .select("kind", F.col("host").alias("src"), F.expr(f"fresh * {PASSED} div (100 * out)").alias("each"),
                         F.explode("parts").alias("part")).where("each > 0"))
        came = written(dealt.join(edges, ["kind", "src", "part"]).groupBy("kind", F.col("dst").alias("host"))
                       .agg(F.sum("each").alias("fresh")), "link-came")
        if came.isEmpty():
            break
        state = written(state.select("kind", "host", F.lit(0).cast("bigint").alias("fresh"), "mass")
                        .unionAll(came.select("kind", "host", "fresh", kept("fresh")))
                        .groupBy("kind", "host").agg(F.sum("fresh").alias("fresh"), F.sum("mass").alias("mass")), "link-state")
    return state.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def blocked_hosts(masses: DataFrame, n_hosts: int, mass: int = MASS) -> DataFrame:
    """(host, trust, distrust) of the hosts that the method blocks."""
    both = masses.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(k)
                                        for k in ("trust", "distrust")])
    return both.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= mass // max(1, n_hosts)))


def judged(pages: DataFrame, rules: Sequence[Sequence[str]] | DataFrame = RULES, page_col: str = "page_id",
           url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, host, path, rule, verdict) for every row of ``pages``."""
    rows = ruled(pages, rules, page_col, url_col, html_col)
    narrow = written(rows.drop("html"), "link-pages")
    hosts = written(narrow.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("found.verdict") == "allow").alias("n_allow"),
        F.count_if(F.col("found.verdict") == "block").alias("n_block")), "link-hosts")
    links = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    masses = propagated(written(host_links(links), "link-pairs"), seeds(hosts))
    blocked = (blocked_hosts(masses, hosts.count()).join(hosts.select("host"), "host", "left_semi")
               .select(F.col("host").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("share")))
    part = F.pmod(F.xxhash64("page", "path"), F.lit(PARTS))  # a host's pages are dealt over its shares
    return (narrow.withColumn("part", part).join(blocked, (F.col("host") == F.col("of")) & (F.col("part") == F.col("share")), "left")
            .select(F.col("page").alias(page_col), "host", "path", F.col("found.rule").alias("rule"),
                    F.coalesce("found.verdict", F.when(F.col("of").isNotNull(), "block").otherwise("allow")).alias("verdict")))
