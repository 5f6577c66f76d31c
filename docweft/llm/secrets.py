"""Secret scans: patterns, and corpus-wide ownership frequency of what they find. DataFrame functions only.

Base patterns find assignments, access keys and hex runs. A wider pattern finds long tokens that mix letters and digits.
Every candidate's hash is counted over the whole corpus: in how many repositories, and of how many owners. One that
COPIED or more owners or COPIED_REPOS or more repositories have is a widely copied example, even if all of these are one
owner's. Any other of a single owner looks live, and one of several owners is shared. Live-looking wide tokens that no
base span overlaps are added as `owned` spans; base spans always stay. Both are counted by their standing.

Positions: the text split by a pattern gives the gaps between its matches; running sums of the lengths of gaps and
matches, by a window over a text's matches, are code points. What overlaps is told by running maxima in both directions,
by windows too, so time grows in proportion to the matches (but for their sort). Counting is one aggregation by
(candidate, owner, repository) with map-side combining, so a hot candidate shrinks before it shuffles, and its rows meet
its standing by broadcast; texts never shuffle.

Defined results: a null text counts as empty and has no spans. Null owners count as one owner, apart from the empty name; so do null repositories. Rows that
repeat id and text are one repository and have the same spans. Matches of one kind never overlap; those of several kinds
may. Texts of any length are scanned whole; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_of, with_hot_keys

# The base patterns of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Wide candidates: long tokens; kept if they have letters and digits.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
PATTERNS = (ASSIGN, ACCESS, HEX, TOKEN)
COPIED, COPIED_REPOS = 3, 10
#: Standings that are counted, by prefix: base spans, then wide tokens.
STANDINGS = (("", "live"), ("", "shared"), ("", "copied"), ("wide_", "shared"), ("wide_", "copied"))

_MATCH = "array<struct<gap:int,hit:string>>"
_SPAN = "array<struct<start:int,kind:int,end:int,hash:bigint>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches with the gaps before them: array of (gap, hit); behind the last match there is a gap alone."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(hits, F.split(text, pattern, -1), lambda hit, gap: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    return F.when(F.rlike(text, F.lit(pattern)), pairs).otherwise(F.array().cast(_MATCH))


def spans(found: DataFrame) -> DataFrame:
    """(key, s): spans of found(key, kinds), where kinds are the matches of each of PATTERNS; keys are distinct."""
    kind, hit = F.col("kind"), F.col("hit")
    each = found.select("key", F.posexplode("kinds").alias("kind", "found")).select("key", "kind", F.posexplode("found").alias("number", "m")).select("key", "kind", "number", "m.*").where("hit is not null")
    end = F.sum(F.col("gap") + F.length(hit)).over(W.partitionBy("key", "kind").orderBy("number").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    secret = F.regexp_extract(hit, ASSIGN, 2)
    kept = F.when(kind == 0, F.length(secret) >= 6).when(kind == 3, hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")).otherwise(True)
    each = each.withColumn("end", end).where(kept)
    return each.select("key", F.struct((F.col("end") - F.length(hit)).alias("start"), "kind", "end", F.xxhash64(F.when(kind == 0, secret).otherwise(hit)).alias("hash")).alias("s"))


def apart(each: DataFrame) -> DataFrame:
    """(key, s) without the wide tokens that a base span overlaps: neither one that begins before (or with) it and ends within, nor one that begins within."""
    base = F.col("s.kind") < 3
    before = W.partitionBy("key").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("key").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(base, F.col("s.end"))).over(before), F.lit(0))
    following = F.coalesce(F.min(F.when(base, F.col("s.start"))).over(after), F.lit(2**31 - 1))
    rows = each.withColumn("reach", reach).withColumn("following", following)
    return rows.where(base | ((F.col("reach") <= F.col("s.start")) & (F.col("following") >= F.col("s.end")))).select("key", "s")


def scan(df: DataFrame, id_col: str, owner_col: str, text_col: str, repo_col: str) -> DataFrame:
    """doc, row key, repository, owner, base spans (sorted) and wide candidates of every row; written once."""
    t = text_of(text_col)
    rows = df.select(F.col(id_col).alias("doc"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), t.alias("text"))
    kinds = F.array(*(matches(F.col("text"), p) for p in PATTERNS))
    rows = stored(rows.select("doc", F.xxhash64("doc", "text").alias("key"), "repo", "owner", kinds.alias("kinds")), "matches")
    some = F.exists("kinds", lambda k: F.size(k) > 0)
    each = apart(spans(rows.where(some).select("key", "kinds").dropDuplicates(["key"])))
    of = lambda wide: F.array_sort(F.collect_list(F.when((F.col("s.kind") == 3) == F.lit(wide), F.col("s"))))
    gathered = each.groupBy("key").agg(of(False).alias("base"), of(True).alias("wide"))
    none = F.array().cast(_SPAN)
    rows = rows.withColumn("some", some).drop("kinds")
    loud = rows.where("some").join(gathered, "key", "left").select("doc", "key", "repo", "owner", F.coalesce("base", none).alias("base"), F.coalesce("wide", none).alias("wide"))
    return stored(rows.where("not some").select("doc", "key", "repo", "owner", none.alias("base"), none.alias("wide")).unionByName(loud), "spans")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repos): of how many distinct owners and repositories each candidate is."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  null is one owner, '' another
    one = found.select(F.explode(F.concat("base", "wide")).alias("s"), known("owner").alias("owner"), known("repo").alias("repo")).select("s.hash", "owner", "repo").distinct()
    return one.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))


def standing() -> Column:
    """live, shared or copied, of a candidate with owners and repos."""
    copied = (F.col("owners") >= COPIED) | (F.col("repos") >= COPIED_REPOS)
    return F.when(copied, "copied").when(F.col("owners") > 1, "shared").otherwise("live")


def find(df: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", repo_col: str = "doc_id") -> DataFrame:
    """doc, base, spans (arrays of start, kind, end, hash), and counts by standing of every row: n_live, n_shared and n_copied of base spans, n_wide_shared and n_wide_copied of wide tokens (live ones are spans)."""
    found = scan(df, id_col, owner_col, text_col, repo_col)
    counts = stored(ownership(found), "owners")
    each = found.where(F.size("base") + F.size("wide") > 0).select("key", F.explode(F.concat("base", "wide")).alias("s")).distinct()
    each = stored(each.withColumn("hash", F.col("s.hash")), "each")
    numbers = stored(each.groupBy("hash").agg(F.count("*").alias("n")), "numbers")
    judged = with_hot_keys(each, counts, "hash", numbers, each.count()).withColumn("standing", standing())
    base = F.col("s.kind") < 3
    owned = F.collect_list(F.when(~base & (F.col("standing") == "live"), F.col("s"))).alias("owned")
    marks = judged.groupBy("key").agg(owned, *[F.sum(((~base if prefix else base) & (F.col("standing") == name)).cast("long")).alias(f"n_{prefix}{name}") for prefix, name in STANDINGS])
    numbers = [f"n_{prefix}{name}" for prefix, name in STANDINGS]
    quiet = found.where(F.size("base") + F.size("wide") == 0).select("doc", "base", F.col("base").alias("spans"), *[F.lit(0).cast("long").alias(n) for n in numbers])
    loud = found.where(F.size("base") + F.size("wide") > 0).join(marks, "key", "left")
    loud = loud.select("doc", "base", F.array_sort(F.concat("base", F.coalesce("owned", F.array().cast(_SPAN)))).alias("spans"), *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers])
    return quiet.unionByName(loud)


def named(column: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count(column: str, kind: int) -> Column:
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")
