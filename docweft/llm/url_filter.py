"""URL filters: rules first, then link-graph propagation over hosts.

Host edges come from the pages' absolute links, one edge for each two hosts. Trust spreads along links by personalised
PageRank from hosts with pages that rules allow; distrust spreads against them from hosts with pages that rules block, to
those that link there; each seed counts by the part of its pages. A host is blocked if its distrust is above LEAST times
an even spread's and over RATIO times its trust, else allowed. A page's own longest fitting rule decides before its host.

Each round is one equi-join of edges with the ranks of both kinds and one sum with map-side combining; ranks are written
to the shared folder after each round. Rules meet distinct hosts, never pages; the pages of hot hosts meet what is known
of these by broadcast, all others the table of hosts (common.with_hot_keys).

Defined results: a null url, or one without `://`, has an empty host and path, no rule and the verdict `allow`. An
unfinished or odd link counts for nothing; null html has no links. Of equally long fitting rules the first in code-point
order counts. Null ids and repeated rows are judged like any row; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored, with_hot_keys

#: Rules of the registered query: (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, ROUNDS, LEAST, RATIO = 0.85, 10, 1.0, 1.0

_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_edges(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Distinct (src, dst) host pairs that links go between, without a host's links to itself."""
    links = df.select(host(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1))).alias("dst"))
    return links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and src <> dst").distinct()


def suffixes(h: Column) -> Column:
    """A host and its parent domains."""
    labels = F.split(h, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_table(df: DataFrame, rules) -> DataFrame:
    rows = [(r, v, r.split("/", 1)[0], "/" + r.split("/", 1)[1] if "/" in r else "") for v, r in rules]
    return df.sparkSession.createDataFrame(rows, "rule string, rule_verdict string, rule_host string, rule_path string")


def ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, kind, value) after some rounds of personalised PageRank.

    edges(src, dst); seeds(host, kind, seed) with kinds trust (spreads along links) and distrust (against them).
    """
    out, into = (edges.groupBy(c).agg(F.count("*").alias("n")) for c in ("src", "dst"))
    along = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), (1 / F.col("n")).alias("share"))
    against = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), (1 / F.col("n")).alias("share"))
    shares = stored(along.unionByName(against), "shares")
    seeds = stored(seeds, "seeds")
    value = seeds.select("host", "kind", F.col("seed").alias("value"))
    if shares.isEmpty():
        return value
    for _ in range(rounds):
        moved = shares.join(value.withColumnRenamed("host", "from"), ["from", "kind"]).groupBy(F.col("to").alias("host"), "kind").agg(F.sum(F.col("value") * F.col("share") * damping).alias("value"))
        value = moved.unionByName(seeds.select("host", "kind", (F.col("seed") * (1 - damping)).alias("value"))).groupBy("host", "kind").agg(F.sum("value").alias("value"))
        value = stored(value, "ranks")
    return value


def judge(df: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """df's id with host, path, rule, verdict, trust and distrust of every row."""
    pages = stored(df.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path")), "pages")
    counts = stored(pages.groupBy("host").agg(F.count("*").alias("n")), "counts")
    total = pages.count()
    edges = stored(host_edges(df, url_col, html_col), "edges")
    hosts = stored(counts.select("host").unionByName(edges.select(F.col("dst").alias("host"))).where("host <> ''").distinct(), "hosts")
    fitting = hosts.withColumn("rule_host", F.explode(suffixes(F.col("host")))).join(rule_table(df, rules), "rule_host")
    of_host = fitting.groupBy("host").agg(F.collect_list(F.struct("rule", "rule_verdict", "rule_path")).alias("rules"))
    best = F.array_sort(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), lambda a, b: F.when(F.length(a["rule"]) != F.length(b["rule"]), F.length(b["rule"]) - F.length(a["rule"])).when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0))
    ruled = with_hot_keys(pages, stored(of_host, "rules"), "host", counts, total).withColumn("best", F.get(best, F.lit(0)))
    ruled = stored(ruled.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("by_rule")), "ruled")
    # Seeds: each host by the part of its pages that rules allow, or block.
    part = {"trust": "allow", "distrust": "block"}
    decided = ruled.where("host <> ''").groupBy("host").agg(*(F.avg(F.coalesce((F.col("by_rule") == v).cast("double"), F.lit(0.0))).alias(k) for k, v in part.items()))
    kinds = decided.select("host", F.explode(F.create_map(*[x for k in part for x in (F.lit(k), F.col(k))])).alias("kind", "seed")).where("seed > 0")
    kinds = stored(kinds, "decided")
    value = ranks(edges, kinds.join(kinds.groupBy("kind").agg(F.sum("seed").alias("all")), "kind").select("host", "kind", (F.col("seed") / F.col("all")).alias("seed")))
    # Ranks are shares of one; times the number of hosts they are in units of an even spread.
    n = hosts.count()
    value = value.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0.0)).alias(k) for k in part))
    value = stored(value.select("host", *((F.col(k) * n).alias(k) for k in part)), "values")
    found = with_hot_keys(ruled, value, "host", counts, total)
    trust, distrust = (F.coalesce(k, F.lit(0.0)) for k in part)
    method = F.when((distrust > LEAST) & (distrust > RATIO * trust), "block").otherwise("allow")
    return found.select(id_col, "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def keep_allowed(df: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The rows of df with verdict allow, by url; df's columns."""
    name = free_name(df, "_url")
    verdicts = judge(df, rules, id_col, url_col, html_col).where("verdict = 'block'").select("host", "path").distinct()
    rows = df.withColumns({name + "h": host(F.col(url_col)), name + "p": path(F.col(url_col))})
    return rows.join(verdicts, (rows[name + "h"] == verdicts["host"]) & (rows[name + "p"] == verdicts["path"]), "left_anti").select(df.columns)
