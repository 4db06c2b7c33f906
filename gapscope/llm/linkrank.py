"""URL filters: rules by host and path, and link-graph propagation for the pages that no rule names.

A rule names a host and the beginning of a path; it fits that host and every host below it, and
the longest rule that fits decides. Rules are looked up by equality: a url asks for the ends of
its host (no more labels than the rules have) and for the beginnings of its path in the lengths
that rules of that host have, so many rules cost no more than few.

Hosts that rules judge are the seeds: trust of a host is the share of its pages that rules allow,
distrust the share that they block. Trust follows links from host to host as in personalised
PageRank, distrust follows them backwards: who links to blocked hosts is distrusted. Both are sums
of a series in whole units (a billion for one host), so they do not depend on the order of rows:
each round passes on ``DAMPING`` hundredths of what arrived in the round before, in parts of the
links' weights, from the hosts where it was ``LEAST`` units at least; the rounds end when no host
has so much left. A host is blocked when its distrust is above its trust and at least what a host
has of which half the pages are blocked by rules.

A link is an absolute or protocol-relative address of an ``a`` or ``area`` tag; its weight is the
number of pages that hold it, and links within a host carry nothing. Everything is DataFrame
functions; rounds are tables in the shared folder and hold one row per host.

Null urls, and those without ``://``, have an empty host and path and are allowed, as no rule and
no link names them. A null html has no links. Rows of one page_id are judged one by one; rules
that are repeated count once, and of an allow and a block rule of one host and path the block
rule counts. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscope.llm.common import cut, drop_table

UNIT = 1_000_000_000
#: Hundredths that a host passes on; the rest stays with it.
DAMPING = 85
#: What is passed on at least, and the distrust of a blocked host, in units.
LEAST, THRESHOLD = UNIT // 10_000, (100 - DAMPING) * UNIT // 100 // 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<(?:a|area)[ \t\n\f\r][^<>]*?href[ \t\n\f\r]*=[ \t\n\f\r]*["']?[ \t\n\f\r]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"' \t\n\f\r>]+)"""


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lowered), and the path up to ``?`` or ``#``; empty where there is none."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    return lowered(F.regexp_extract(after, r"\A([^/?#]*)", 1)), F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)


def host_ends(host: Column, most: int) -> Column:
    """The last 1, 2, ... labels of a host, ``most`` at most; none of an empty host."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    ends = F.transform(F.sequence(F.lit(1), F.least(labels, F.lit(max(most, 1)))), lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(ends)


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, ruled) of the distinct ``urls`` (host, path) that a rule (host, path, verdict) fits."""
    rules = rules.select(lowered(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").where("rule_host <> '' and rule_path is not null")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    most = rules.agg(F.max(F.length("rule_host") - F.length(F.replace("rule_host", F.lit("."), F.lit(""))) + 1)).first()[0] or 0
    lengths = rules.select("rule_host", F.length("rule_path").alias("n")).distinct()
    asked = (
        urls.select("host", "path", F.explode(host_ends(F.col("host"), most)).alias("rule_host")).join(lengths, "rule_host")
        .where(F.length("path") >= F.col("n")).select("host", "path", "rule_host", F.expr("left(path, n)").alias("rule_path"))
    )
    found = asked.join(rules, ["rule_host", "rule_path"]).withColumn("rule", F.concat("rule_host", "rule_path"))
    best = F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "verdict"))
    return found.groupBy("host", "path").agg(best.alias("b")).select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """(a, b, w): pages of host a that link to the other host b. ``pages`` has host and html."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)), lowered))
    links = pages.where("host <> ''").select(F.col("host").alias("a"), F.explode(targets).alias("b"))
    return links.where("a <> b and b <> ''").groupBy("a", "b").agg(F.count("*").alias("w"))


def propagate(seeds: DataFrame, links: DataFrame, damping: int = DAMPING, least: int = LEAST) -> DataFrame:
    """(host, score) in units: what ``seeds`` (host, seed) hold and pass along ``links`` (a, b, w)."""
    spark = seeds.sparkSession
    whole = links.groupBy("a").agg(F.sum("w").alias("whole"))
    # Of what a host passes on, each link carries w / whole; products may pass 64 bits.
    parts = cut(links.join(whole, "a").select("a", "b", "w", "whole"))
    share = f"CAST((CAST(mass AS DECIMAL(19,0)) * CAST({damping} * w AS DECIMAL(19,0))) div CAST(100 * whole AS DECIMAL(21,0)) AS BIGINT)"
    now = cut(seeds.select("host", F.expr(f"CAST(seed AS BIGINT) * {100 - damping} div 100").alias("mass")).where("mass > 0"))
    rounds = [now]
    while True:
        moved = now.where(F.col("mass") >= least).join(parts, F.col("host") == F.col("a")).select(F.col("b").alias("host"), F.expr(share).alias("mass"))
        now = cut(moved.where("mass > 0").groupBy("host").agg(F.sum("mass").alias("mass")))
        if now.isEmpty():
            break
        rounds.append(now)
        if len(rounds) > 8:  # few tables are open at a time; the last one is the next round's start
            sums = cut(unioned(rounds[:-1]))
            drop_table(spark, *rounds[:-1])
            rounds = [sums, now]
    scores = cut(unioned(rounds).withColumnRenamed("mass", "score"))
    drop_table(spark, parts, now, *rounds)
    return scores


def unioned(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out.groupBy("host").agg(F.sum("mass").alias("mass"))


def host_scores(judged: DataFrame, links: DataFrame) -> DataFrame:
    """(host, trust, distrust) in units; ``judged`` has host and ruled, a row per page."""
    ruled = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")
    )
    # A third of all rows times a billion may pass 64 bits.
    part = lambda name: F.expr(f"CAST(CAST({name} AS DECIMAL(19,0)) * {UNIT} div CAST(n AS DECIMAL(19,0)) AS BIGINT)").alias("seed")
    ruled = cut(ruled)
    trust = propagate(ruled.where("allowed > 0").select("host", part("allowed")), links)
    distrust = propagate(ruled.where("blocked > 0").select("host", part("blocked")), links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    both = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    return both.select("host", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict per row of ``pages`` (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    links = cut(host_links(named))
    plain = named.select("page_id", "host", "path")
    judged = cut(plain.join(fitting_rules(plain.select("host", "path").distinct(), rules), ["host", "path"], "left"))
    scores = host_scores(judged, links)
    blocked = scores.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= THRESHOLD)).select("host", F.lit("block").alias("found"))
    rest = judged.where("ruled is null").join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("found", F.lit("allow")).alias("verdict"))
    return judged.where("ruled is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict")).unionByName(rest)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of rules as the table that ``judge`` takes."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("host", "path", "verdict"), rule)]) for rule in rules])))


#: Rules (host, path, verdict) that ``op11_linkrank`` applies.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_SERIES = """{name} AS (
    SELECT 0 AS k, host, mass FROM (SELECT host, ((({part} * 1000000000::HUGEINT) // n) * 15) // 100 AS mass FROM ruled) s WHERE mass > 0
    UNION ALL
    SELECT k + 1, host, mass FROM (
        SELECT r.k, l.{to} AS host, sum((r.mass * 85 * l.w) // (100 * l.{whole})) AS mass
        FROM {name} r JOIN weighed l ON l.{at} = r.host WHERE r.mass >= 100000 GROUP BY r.k, l.{to}
    ) m WHERE mass > 0
)"""
SQL = f"""WITH RECURSIVE named AS (
    SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages
), parsed AS (
    SELECT page_id, html, translate(regexp_extract(after, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
           regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM named
), rules(h, p, verdict) AS (VALUES {", ".join(map(str, RULES))}
), fits AS (
    SELECT host, path, max(struct_pack(n := length(h || p), hn := length(h), rule := h || p, verdict := verdict)) AS b
    FROM (SELECT DISTINCT host, path FROM parsed) u, rules
    WHERE (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY host, path
), judged AS (
    SELECT page_id, host, path, b.rule AS rule, b.verdict AS ruled FROM parsed LEFT JOIN fits USING (host, path)
), ruled AS (
    SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked
    FROM judged WHERE host <> '' GROUP BY host
), links AS (
    SELECT a, b, count(*) AS w FROM (
        SELECT host AS a, unnest(list_distinct(regexp_extract_all(translate(html, '{UPPER}', '{LOWER}'), '{LINK.replace("'", "''")}', 1))) AS b
        FROM parsed WHERE host <> ''
    ) e WHERE a <> b AND b <> '' GROUP BY a, b
), weighed AS (
    SELECT a, b, w, sum(w) OVER (PARTITION BY a) AS out_whole, sum(w) OVER (PARTITION BY b) AS in_whole FROM links
), {_SERIES.format(name="trusted", part="allowed", at="a", to="b", whole="out_whole")},
{_SERIES.format(name="distrusted", part="blocked", at="b", to="a", whole="in_whole")},
scores AS (
    SELECT host, sum(t) AS trust, sum(d) AS distrust
    FROM (SELECT host, mass AS t, 0 AS d FROM trusted UNION ALL SELECT host, 0, mass FROM distrusted) s GROUP BY host
)
SELECT page_id, j.host AS host, path, rule,
       coalesce(ruled, CASE WHEN distrust > trust AND distrust >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN scores s ON s.host = j.host"""
