"""URL filters: rules by host and path, and trust that spreads over the links between hosts.

Trust is a personalised PageRank from hosts that rules allow, along links: a host's trust is split over its links.
Distrust starts at hosts that rules block and goes against links: a host takes the distrust of those it links to, in
proportion to its links, whoever else links there. Both run in Spark over host edges that are aggregated from page
links, in fixed-point integers, so that sums do not depend on their order, and from below, so that scores only
grow; rounds end when no score changes. A page that no rule fits gets its host's verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, table, written

#: One unit of trust, and the share of it that follows a link, in hundredths.
UNIT, FOLLOW = 1_000_000_000, 85
#: Rounds between two comparisons, each with a written table: a lost executor costs no more than these.
ROUNDS_AT_ONCE = 4
#: A host is blocked from this much distrust on, if it has more distrust than trust: where about three in five of its
#: links lead to hosts that are blocked throughout.
BLOCK_FROM = UNIT * (100 - FOLLOW) // 100 // 2
#: More rules than these are joined on the host's suffixes instead of being tried in turn; the results are the same.
RULES_IN_TURN = 100


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """From behind the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ordered(rules: tuple[UrlRule, ...]) -> list[UrlRule]:
    return sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict))


def fitting_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null where none does. Equal lengths: the first by name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(_ordered(rules)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def with_rule(seen: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """seen(host, path, ...) with the column fit, as fitting_rule() has it, for any number of rules.

    Many rules are met by an equal join of the distinct hosts' suffixes with the rules' hosts; a host's rules, in
    order, then come to its pages, of which each takes the first whose path it begins with.
    """
    if len(rules) <= RULES_IN_TURN:
        return seen.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = [(k, r.host, r.path, r.name, r.verdict) for k, r in enumerate(_ordered(rules))]
    listed = seen.sparkSession.createDataFrame(rows, "place int, suffix string, start string, rule string, verdict string")
    parts = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = seen.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(listed, "suffix")
    own = met.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "start", "rule", "verdict"))).alias("rules"))
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["start"])), F.lit(0))
    fit = F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))
    return seen.join(own, "host", "left").withColumn("fit", fit).drop("rules")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, pages): how many pages of one host link to another. Relative links stay on the host and are no edge."""
    hrefs = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit("(?i)\\shref\\s*=\\s*[\"']?([^\"'\\s>]+)"), F.lit(1))
    outside = F.filter(hrefs, lambda x: x.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    targets = F.array_distinct(F.transform(outside, lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("x:"), x)).otherwise(x))))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst"))
    return links.filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages"))


def propagated(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, host, score) when nothing changes any more. seeds: (kind, host, score), kind trust or distrust.

    A round is a join on the host and a sum by target, which Spark combines before the shuffle. Scores begin with the
    seeds' own share and can only grow, in whole numbers below a bound: some 130 rounds at most change anything, and
    links without a cycle need no more than their longest path.
    """
    base = written(seeds.withColumn("score", F.expr(f"score * {100 - FOLLOW} div 100")).filter("score > 0"), "host-seeds")
    total = edges.groupBy("src").agg(F.sum("pages").alias("out"))
    shares = edges.join(total, "src")
    both = shares.select(F.lit("trust").alias("kind"), "src", F.col("dst").alias("to"), "pages", "out").unionByName(
        shares.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("to"), "pages", "out"))
    flows = written(both.withColumn("own", F.lit(0).cast("long")), "host-links")
    if flows.isEmpty():
        return base
    # a seed's own share comes to it by a link of its own
    flows = written(flows.unionByName(base.select("kind", F.col("host").alias("src"), F.col("host").alias("to"), F.lit(0).cast("long").alias("pages"), F.lit(1).cast("long").alias("out"), F.col("score").alias("own"))), "host-flows")
    scores, state = base, None
    while True:
        for _ in range(ROUNDS_AT_ONCE):
            moved = flows.join(scores.withColumnRenamed("host", "src"), ["kind", "src"])
            scores = moved.select("kind", F.col("to").alias("host"), F.expr(f"score * {FOLLOW} * pages div (100 * out) + own").alias("score")).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        before, scores = (scores_before if state is not None else None), written(scores, "host-scores")
        # as no score ever falls, equal sums mean equal scores
        now = tuple(scores.agg(F.count(F.lit(1)), F.sum(F.col("score").cast("decimal(38,0)"))).first())
        if before is not None:
            discard(before)
        if now == state:
            return scores
        state, scores_before = now, scores


def judged(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url, html); other columns, whatever their
    names, are ignored.

    Null or malformed urls have an empty host and path, fit no rule and are allowed; a null html has no links. Repeated
    rows are judged each and each counts with its links. Very long urls and pages are taken whole. Of rules that fit
    and are equally long the first by name holds. An empty table gives an empty one.
    """
    pages = pages.select("page_id", "url", "html")
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = with_rule(seen, rules)
    by_host = seen.filter("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("fit.verdict") == "allow").cast("long")).alias("allowed"),
        F.sum((F.col("fit.verdict") == "block").cast("long")).alias("blocked"))
    seeds = written(by_host.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.expr(f"{UNIT} * coalesce(allowed, 0) div n").alias("score")),
        F.struct(F.lit("distrust").alias("kind"), F.expr(f"{UNIT} * coalesce(blocked, 0) div n").alias("score")))).alias("s"))
        .select("s.kind", "host", "s.score").filter("score > 0"), "host-judged")
    scores = propagated(seeds, host_edges(pages))
    blocked = scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0)).alias("distrust"),
    ).filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= BLOCK_FROM)).select("host", F.lit(True).alias("bad"))
    blocked = written(blocked, "hosts-blocked")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return seen.join(blocked, "host", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _oracle(rules: tuple[UrlRule, ...] = RULES, rounds: int = 140) -> str:
    fits = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in _ordered(rules)}
    rule = " ".join(f"WHEN {x} THEN '{r.name}'" for r, x in fits.items())
    verdict = " ".join(f"WHEN {x} THEN '{r.verdict}'" for r, x in fits.items())
    host = lambda x: f"translate(regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html, coalesce({host('url')}, '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS MATERIALIZED (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS v FROM p),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE v = 'allow') AS a, count(*) FILTER (WHERE v = 'block') AS b FROM j WHERE host <> '' GROUP BY host),
s0 AS (SELECT 'trust' AS kind, host, ({UNIT} * a // n)::BIGINT AS score FROM h UNION ALL SELECT 'distrust', host, ({UNIT} * b // n)::BIGINT FROM h),
base AS MATERIALIZED (SELECT kind, host, score * {100 - FOLLOW} // 100 AS score FROM s0 WHERE score * {100 - FOLLOW} // 100 > 0),
l AS (SELECT DISTINCT r, host AS src, x FROM (SELECT r, host, unnest(regexp_extract_all(html, '(?i)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS x FROM p)
      WHERE regexp_matches(x, '^([A-Za-z][A-Za-z0-9+.-]*:)?//')),
e AS (SELECT src, dst, count(DISTINCT r) AS pages FROM (SELECT r, src, {host("CASE WHEN starts_with(x, '//') THEN 'x:' || x ELSE x END")} AS dst FROM l)
      WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
o AS (SELECT *, sum(pages) OVER (PARTITION BY src)::BIGINT AS out FROM e),
flow AS MATERIALIZED (SELECT 'trust' AS kind, src, dst AS "to", pages, out, 0::BIGINT AS own FROM o UNION ALL SELECT 'distrust', dst, src, pages, out, 0 FROM o
      UNION ALL SELECT kind, host, host, 0, 1, score FROM base),
s(k, kind, host, score) AS (SELECT 0, kind, host, score FROM base UNION ALL
      SELECT s.k + 1, f.kind, f."to", sum(s.score * {FOLLOW} * f.pages // (100 * f.out) + f.own)::BIGINT FROM s JOIN flow f ON f.kind = s.kind AND f.src = s.host WHERE s.k < {rounds} GROUP BY s.k, f.kind, f."to"),
bad AS (SELECT host FROM s WHERE k = {rounds} GROUP BY host
        HAVING sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) > sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END)
           AND sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) >= {BLOCK_FROM})
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""


ORACLE = _oracle()
