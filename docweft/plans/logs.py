"""Queries over logs whose rows count in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acceptance
from ..session import table
from .checks import name, no_rows
from .registry import query

#: Nodes of a paper in ordered_acceptance, their first version, and the nodes with a foreign hash.
NODES, PAPERS = 9, 5


@query(f"""with recursive r as (
        select c_nationkey % {PAPERS} as p, o_orderkey as place, row_number() over (partition by c_nationkey % {PAPERS} order by o_orderkey) as k, o_orderpriority[1] as kind, (o_custkey % {NODES})::int as x, (o_custkey // {NODES} % {NODES})::int as y,
            1 + day(o_orderdate) % 4 as seen, case o_orderstatus when 'F' then 'VERIFIED' when 'O' then 'REJECTED' else 'DISPUTED' end as decision, o_orderkey % 11 <> 0 as fresh
        from orders join customer on o_custkey = c_custkey),
    s as (select distinct p, 0::bigint as k, [1 for i in range({NODES})] as versions, []::int[] as before, 0::bigint as place, '' as reason, 0 as version from r
        union all
        select p, k, case when reason is null and kind in ('4', '5') then [case when i = x + 1 then seen + 1 else versions[i] end for i in range(1, {NODES + 1})] else versions end,
            case when reason is null and kind in ('1', '2') then list_distinct(list_concat(before, flatten([[i * {NODES} + j for j in range({NODES}) if j = b or list_contains(before, b * {NODES} + j)] for i in range({NODES}) if i = a or list_contains(before, i * {NODES} + a)]))) else before end,
            place, reason, case when reason is null then case when kind in ('4', '5') then seen + 1 else 1 end end
        from (select s.p, r.k, versions, before, r.place, kind, x, seen, a, b,
                case when kind in ('4', '5') then case when not fresh or seen <> versions[x + 1] then 'Stale source hash or object version' end
                    when x = y then 'Self relations are not permitted' when kind in ('1', '2') and list_contains(before, b * {NODES} + a) then 'Prerequisites would form a cycle' end as reason
            from s join (select *, case when kind = '2' then y else x end as a, case when kind = '2' then x else y end as b from r) r on r.p = s.p and r.k = s.k + 1))
    select p::varchar as paper_id, place, reason is null as accepted, coalesce(reason, '') as reason, version::bigint as new_version from s where k > 0""")
def ordered_acceptance(spark, sf_dir):
    """Orders as requests of a few papers: by priority prerequisites, dependencies, uses, and reviews of a node that has been seen in some version."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % PAPERS).cast("string").alias("paper_id")), "o_custkey")
    kind, x, y = F.substring("o_orderpriority", 1, 1), F.col("o_custkey") % NODES, F.floor(F.col("o_custkey") / NODES) % NODES
    of = lambda n: F.concat_ws(":", F.col("paper_id"), n.cast("string"))
    review = kind.isin("4", "5")
    requests = o.select(
        "paper_id", F.col("o_orderkey").alias("place"), F.when(review, "review").otherwise("edge").alias("op"), F.when(review, of(x)).otherwise(name("e", "o_orderkey")).alias("object_id"), F.lit("node").alias("kind"),
        of(x).alias("source_node_id"), of(y).alias("target_node_id"), F.when(kind == "1", "PREREQUISITE_OF").when(kind == "2", "DEPENDS_ON").otherwise("USES").alias("relation_type"), F.array(F.lit("a")).alias("provenance"), F.when(F.col("o_orderkey") % 11 != 0, "h").otherwise("old").alias("source_hash"),
        (1 + F.dayofmonth("o_orderdate") % 4).alias("expected_version"), F.when(F.col("o_orderstatus") == "F", "VERIFIED").when(F.col("o_orderstatus") == "O", "REJECTED").otherwise("DISPUTED").alias("decision"), F.lit("SCIENTIFIC_VALIDITY").alias("scope"),
    )
    papers = spark.range(PAPERS).select(F.col("id").cast("string").alias("id"), F.lit("h").alias("source_hash"))
    nodes = papers.select(F.col("id").alias("paper_id"), F.explode(F.sequence(F.lit(0), F.lit(NODES - 1))).alias("n")).select(of(F.col("n")).alias("id"), "paper_id", F.lit("METHOD").alias("type"), F.lit("UNVERIFIED").alias("epistemic_status"), F.lit("t").alias("text"), F.array(F.lit("a")).alias("provenance"), F.lit(1).alias("version"), F.lit("CANDIDATE").alias("verification_status"))
    edges = no_rows(spark, "id string, paper_id string, source_node_id string, target_node_id string, relation_type string, provenance array<string>, version int, verification_status string")
    out = acceptance.outcomes(requests, papers, nodes, edges, no_rows(spark, "id string, text string"))
    return out.select("paper_id", "place", "accepted", F.coalesce("reason", F.lit("")).alias("reason"), "new_version")
