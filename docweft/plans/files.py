"""Queries that write files and read them again, and that read structured texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import anchors, yaml
from ..session import new_path, table
from ..sources import markdown, publish
from .checks import name
from .registry import query

#: A supplier's card; what varies comes from its row.
CARD = "{front}id: s{k}\nname: '{name}'\naddress:\n  nation: {nation}  # its number\n  lines:\n  - first\n  - {{street: {street}, no: {no}}}\nnote: |\n  balance\n    {balance}\n\nlist: [a, {nation}, {street}]\n"
PATHS = ("address.lines[1].street", "name", "note", "list[1]", "address.nation.deeper", "list[3]", "address")


@query("""select s_suppkey, case s_suppkey % 7 when 0 then 'st' || s_suppkey when 1 then s_name || ', it''s' when 2 then 'balance' || chr(10) || '  ' || (round(s_acctbal)::int)::varchar || chr(10) when 3 then s_nationkey::varchar
        when 6 then '{"nation": ' || s_nationkey || ', "lines": ["first", {"street": "st' || s_suppkey || '", "no": ' || s_suppkey % 10 || '}]}' end as value,
    case s_suppkey % 7 when 4 then 'missing address.nation.deeper' when 5 then 'missing list[3]' end as fault from supplier""")
def yaml_anchors(spark, sf_dir):
    """Anchors like a.b[2].c into cards written of each supplier's row; two in seven lead nowhere."""
    s, m = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 7
    card = F.lit(CARD)
    values = {"front": F.when(F.col("s_suppkey") % 2 == 0, "---\n").otherwise(""), "k": F.col("s_suppkey"), "name": F.concat("s_name", F.lit(", it''s")), "nation": F.col("s_nationkey"), "street": name("st", "s_suppkey"), "no": F.col("s_suppkey") % 10, "balance": F.round("s_acctbal").cast("int")}
    for key, value in values.items():
        card = F.replace(card, F.lit("{" + key + "}"), value.cast("string"))
    card = F.replace(F.replace(card, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    found = yaml.found(card, F.element_at(F.array(*map(F.lit, PATHS)), (m + 1).cast("int")))
    return s.select("s_suppkey", found.alias("f")).select("s_suppkey", "f.value", "f.fault")


@query("""with r as (select n_name as section, c_name as item, c_acctbal as value from customer join nation on c_nationkey = n_nationkey where n_nationkey < 5),
    l as (select *, row_number() over (partition by section order by value desc, item) - 1 as k from r), p as (select section, k // 20 as part, count(*) as n, arg_min(item, k) as first from l group by 1, 2)
    select 'nations/' || section || case when part > 0 then '-' || (part + 1) else '' end || '.md' as path, n, first from p union all select 'INDEX.md', count(*), min('nations/' || section || '.md') from p""")
def published_files(spark, sf_dir):
    """Customers by nation as a report of Markdown files with an index, published all or none, and read again."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey < 5")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("section"), F.col("c_name").alias("item"), F.col("c_acctbal").alias("value"))
    names = tuple(sorted(r.n_name for r in nation.select("n_name").collect()))
    at = new_path(spark, "published")
    publish.publish(markdown.report_files(rows, "nations", names, 20), at)
    back = spark.read.text(at, wholetext=True, recursiveFileLookup=True).select(F.regexp_extract(F.col("_metadata.file_path"), "/published/(.*)$", 1).alias("path"), F.col("value"))
    lines = F.filter(F.split("value", "\n"), lambda x: x.startswith("- "))
    first = F.regexp_extract(F.get(lines, F.lit(0)), r"^- \[?([^\]:]*)", 1)
    return back.select("path", F.size(lines).cast("long").alias("n"), first.alias("first"))


@query("""with a as (select s_suppkey as k, s_suppkey % 6 as m, '# Card ' || s_suppkey || chr(10) || (round(s_acctbal)::int)::varchar || chr(10) || '## Of ' || s_name || '!' || chr(10) || 'nation ' || s_nationkey || chr(10) || '### More' || chr(10) || 'x' || chr(10) || '## Other' || chr(10) || 'y' as t from supplier)
    select k as s_suppkey, case m when 0 then '## Of ' || s_name || '!' || chr(10) || 'nation ' || s_nationkey || chr(10) || '### More' || chr(10) || 'x' || chr(10) when 1 then '### More' || chr(10) || 'x' || chr(10)
        when 2 then (round(s_acctbal)::int)::varchar || chr(10) || '## Of ' || s_name || '!' when 3 then t end as value, case m when 4 then 'no lines L7-9' when 5 then 'no anchor of-supplier' end as fault from a join supplier on k = s_suppkey""")
def note_anchors(spark, sf_dir):
    """Anchors into notes written of each supplier's row: a label, a slug, lines, none, lines beyond the end, and a heading that is not there."""
    s, line = table(spark, sf_dir, "supplier"), lambda *parts: F.concat(*parts, F.lit("\n"))
    note = F.concat(line(name("# Card ", "s_suppkey")), line(F.round("s_acctbal").cast("int").cast("string")), line(name("## Of ", "s_name"), F.lit("!")), line(name("nation ", "s_nationkey")), F.lit("### More\nx\n## Other\ny"))
    anchor = F.element_at(F.array(F.concat(name("Of ", "s_name"), F.lit("!")), F.lit("#more"), F.lit("L2-3"), F.lit(""), F.lit("L7-9"), F.lit("of-supplier")), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return s.select("s_suppkey", anchors.select_anchor(note, anchor).alias("f")).select("s_suppkey", "f.value", "f.fault")


@query("""select o_orderkey as id, case when o_custkey % 4 = 3 then 'no file' when o_orderkey % 7 >= 5 then 'no anchor lines[' || o_orderkey % 7 || ']' end as fault from orders where o_custkey % 4 = 3 or o_orderkey % 7 >= 5""")
def dangling_references(spark, sf_dir):
    """Orders refer to a list's places in cards of their customers: cards have five lines, and a quarter of the customers none."""
    cards = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 3").select(name("c", "c_custkey").alias("path"), F.concat(F.lit("name: '"), "c_name", F.lit("'\nlines:\n- a\n- b\n- c: 1\n- d\n- "), F.col("c_nationkey").cast("string"), F.lit("\n")).alias("content"))
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), name("c", "o_custkey").alias("path"), F.concat(F.lit("lines["), (F.col("o_orderkey") % 7).cast("string"), F.lit("]")).alias("anchor"))
    return anchors.reference_faults(refs, cards)
