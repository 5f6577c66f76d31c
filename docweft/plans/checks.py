"""Queries for stores, integrity, reviews, the artifact index, bibliography sync and evaluation, over planted cases.

A case is planted by a key's remainder; the SQL states what must come out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, evaluate, graph, history, integrity, layout, resolve, search, segments, similarity
from ..session import new_path, scratch, table, written
from ..sources import bibliography, json_items, markdown, store
from .graph import EDGES_SQL, ID, NODES_SQL, edges, nodes
from .registry import query

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(*at: float | Column) -> Column:
    return F.struct(*((x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias(k) for x, k in zip(at, ("x0", "y0", "x1", "y1"), strict=True)))


def name(prefix: str, column: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


def nth(m: Column, *values: object) -> Column:
    """The value at place m, from 0."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (m + 1).cast("int"))


def no_rows(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


# --- stores and sources


@query("""with u as (select doc_id as position, sha256(text) as source_hash from documents), s as (select distinct source_hash from u where position % 10 = 0), f as (select source_hash, min(position) as first from u group by 1)
    select position, u.source_hash, position > first or u.source_hash in (from s) as deduplicated from u join f using (source_hash)""")
def upload_dedup(spark, sf_dir):
    uploads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.col("text").alias("content"))
    stored = uploads.where("position % 10 = 0").select(F.sha2("content", 256).alias("source_hash"))
    return store.unique_uploads(uploads, stored).select("position", "source_hash", "deduplicated")


@query("select sha256(text) as source_hash, min(doc_id) % 7 <> 0 as intact, min(doc_id) % 3 = 0 as safe from documents group by 1")
def stored_contents(spark, sf_dir):
    """Puts each content once, changes a seventh behind the store's back, and reads all again with their hashes verified."""
    first = store.distinct_contents(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = first.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("first"), "text"), "first")
    changed = F.when(F.col("first") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    path = new_path(spark, "store")
    store.write_store(rows.select("source_hash", "first", changed.alias("content")), path)
    read = store.verified(spark.read.parquet(path))
    return read.select("source_hash", "intact", store.safe_relative(nth(F.col("first") % 3, "a/b.txt", "../b", "/etc/b")).alias("safe"))


@query("select c_custkey, c_name, c_nationkey from customer where c_custkey = 7")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey = 7").select("c_custkey", "c_name", "c_nationkey")


@query("select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) as place from orders")
def newest_first(spark, sf_dir):
    return catalog.newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "place")


@query("""with b as (select p_partkey, p_partkey % 4 * 90 as r, (p_size)::double as x0, 20.0::double as y0, (p_size + 10)::double as x1, 50.0::double as y1 from part)
    select p_partkey, case r when 90 then 800 - y1 when 180 then 600 - x1 when 270 then y0 else x0 end as x0, case r when 90 then x0 when 180 then 800 - y1 when 270 then 600 - x1 else y0 end as y0,
        case r when 90 then 800 - y0 when 180 then 600 - x0 when 270 then y1 else x1 end as x1, case r when 90 then x1 when 180 then 800 - y0 when 270 then 600 - x0 else y1 end as y1 from b""")
def displayed_boxes(spark, sf_dir):
    size = F.col("p_size")
    shown = layout.displayed_box(box(size, 20, size + 10, 50), F.lit(600.0), F.lit(800.0), F.col("p_partkey") % 4 * 90)
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("b")).select("p_partkey", "b.*")


@query("""select 'I' || s_suppkey as item_key, case when s_suppkey % 3 = 0 then 'cite' || s_suppkey else 'zotero-I' || s_suppkey end as cite_key, s_name as title, (1990 + s_nationkey)::int as year, '10.1/' || s_suppkey as doi_key, 'a' || s_suppkey || '.pdf' as files, false as bad from supplier where s_suppkey % 5 <> 4
    union all select null, null, null, null, null, null, true from supplier where s_suppkey % 5 = 4""")
def bibliography_export(spark, sf_dir):
    """Writes suppliers as a JSON export of items with attachments, a fifth of them without a title, and reads it."""
    k, m = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 5
    item = F.struct(F.lit("journalArticle").alias("itemType"), name("I", "s_suppkey").alias("key"), F.when(m != 4, F.col("s_name")).alias("title"), F.concat(F.lit("https://doi.org/10.1/"), k).alias("DOI"), F.concat(F.lit("spring "), (F.col("s_nationkey") + 1990).cast("string")).alias("date"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Citation Key: cite"), k)).alias("extra"))
    file = F.struct(F.lit("attachment").alias("itemType"), name("A", "s_suppkey").alias("key"), name("I", "s_suppkey").alias("parentItem"), F.concat(F.lit("a"), k, F.lit(".pdf")).alias("path"))
    lines = table(spark, sf_dir, "supplier").select(F.explode(F.array(F.to_json(item), F.to_json(file))).alias("j"))
    path = new_path(spark, "export")
    json_items.write(lines, path)
    records, errors = bibliography.read(spark, path)
    good = records.select("item_key", "cite_key", "title", "year", "doi_key", F.array_join("attachment_paths", ",").alias("files"), F.lit(False).alias("bad"))
    return good.unionByName(errors.select(F.lit(True).alias("bad")), allowMissingColumns=True)


@query("select '| ' || s_suppkey || ' | ' || s_name || '\\|x<br>y |' as line from supplier")
def markdown_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit("|x\ny")).alias("title"))
    path = new_path(spark, "map")
    markdown.write_lines(rows, path, "s_suppkey", "title")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("select s_suppkey, 'T ' || s_name as title, s_suppkey % 2 = 0 as valid, case when s_suppkey % 2 = 0 then 'a,b c' else '' end as tags from supplier")
def front_matter(spark, sf_dir):
    text = F.concat(F.lit('---\nname: "T '), F.col("s_name"), F.lit("\"\ntags:\n  - a\n  - 'b c'\n"), F.when(F.col("s_suppkey") % 2 == 0, "---\nbody").otherwise("body"))
    front = F.regexp_extract(text, markdown.FRONT, 1)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", front.alias("front"), text.alias("text"), F.rlike(text, F.lit(markdown.FRONT)).alias("valid"))
    return rows.select("s_suppkey", F.coalesce(markdown.field(F.col("front"), "name"), markdown.field(F.col("text"), "name")).alias("title"), "valid", F.array_join(markdown.list_field(F.col("front"), "tags"), ",").alias("tags"))


@query("select 'c' || s_suppkey as path, case s_suppkey % 5 when 0 then null when 1 then '' when 4 then 'same' else 'id' || s_suppkey end as id, case s_suppkey % 5 when 0 then 'no front matter' when 1 then 'missing id' when 2 then 'missing title' when 4 then case when 'c' || s_suppkey > (select min('c' || x.s_suppkey) from supplier x where x.s_suppkey % 5 = 4) then 'repeated id' end end as fault from supplier")
def scanned_cards(spark, sf_dir):
    """Cards without front matter, without an id, without a title, sound ones, and ones that share an id."""
    m, k = F.col("s_suppkey") % 5, F.col("s_suppkey").cast("string")
    front = F.concat(F.lit("id: "), nth(m, "x", "", F.concat(F.lit("id"), k), F.concat(F.lit("id"), k), "same"), F.lit("\ntitle: "), F.when(m == 2, " ").otherwise("A title"))
    cards = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), k).alias("path"), F.when(m == 0, "").otherwise(front).alias("front"), (m != 0).alias("valid"))
    return markdown.scanned(cards, ("title",)).select("path", "id", "fault")


# --- search and graph


@query("""with n as (select p_partkey, p_name, case p_partkey % 3 when 0 then p_name when 1 then p_name || ' of steel' else 'steel' end as text from part),
    w as (select *, list_has_all(string_split(text, ' '), ['red', 'bolt']) as nhit, list_has_all(string_split(p_name, ' '), ['red', 'bolt']) as ahit from n),
    h as (select (case when contains(text, 'red bolt') then 2 else 1 end)::int as score, (p_partkey % 5)::int as page_number, 'a' || p_partkey as anchor_id, 'n' || p_partkey as node_id, 'CLAIM' as kind from w where nhit and ahit
        union all select (case when contains(p_name, 'red bolt') then 2 else 1 end)::int, (p_partkey % 5)::int, 'a' || p_partkey, null, 'SOURCE_SPAN' from w where ahit and not nhit)
    select * from h order by score desc, page_number, anchor_id, coalesce(node_id, '') limit 50""")
def ranked_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    anchors = part.select(name("a", "p_partkey").alias("id"), (F.col("p_partkey") % 5).cast("int").alias("page_number"), F.col("p_name").alias("text"))
    text = nth(F.col("p_partkey") % 3, F.col("p_name"), F.concat("p_name", F.lit(" of steel")), "steel")
    found = part.select(name("n", "p_partkey").alias("id"), text.alias("text"), F.lit("CLAIM").alias("type"), F.array(F.lit("none"), name("a", "p_partkey")).alias("provenance"))
    return search.search(found, anchors, "red bolt", 50, unicode=False).select("score", "page_number", "anchor_id", "node_id", "kind")


AUDITED = "licensed|released|password|token"


@query(f"""with l as (select doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as ord from documents),
    m as (select *, len(regexp_extract_all(line, '(?i)({AUDITED})')) as n from l) select case when doc_id % 3 = 0 then 'EVEN' when doc_id % 3 = 1 then 'LEGACY' else 'OTHER' end as class, sum(n)::bigint as hits, count(*) as lines from m where n > 0 group by 1""")
def audit_classes(spark, sf_dir):
    rows = layout.blocks_of_text(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("path", F.concat(nth(F.col("doc_id") % 3, "docs/even/", "old/legacy/", "src/"), F.col("doc_id").cast("string")))
    hits = search.lexical_audit(rows, AUDITED, [("EVEN", "^docs/"), ("LEGACY", "legacy")], "OTHER", "path", "ord")
    return search.audit_counts(hits)


@query(f"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as ord from documents),
    s as (select doc_id, ord, line, regexp_split_to_array(line, '(?i)({AUDITED})') as gaps, regexp_extract_all(line, '(?i)({AUDITED})') as hits from l),
    h as (select doc_id, ord, line, hits, gaps, unnest(generate_series(1, len(hits))) as i from s where len(hits) > 0)
    select doc_id, ord::int as line, (i - 1)::int as hit, lower(hits[i]) as term, (octet_length(encode(array_to_string(gaps[1:i], ''))) + coalesce(octet_length(encode(array_to_string(hits[1:i - 1], ''))), 0) + 1)::int as byte_column, sha256(line) as line_sha256 from h""")
def lexical_hits(spark, sf_dir):
    rows = layout.blocks_of_text(table(spark, sf_dir, "documents"))
    return search.lexical_audit(rows, AUDITED, [], "ALL", "doc_id", "ord").select(F.col("path").alias("doc_id"), "line", "hit", "term", "byte_column", "line_sha256")


@query("""select 'order:' || l_orderkey as node_id, count(*) as anchors, string_agg(p_size || '/part:' || l_partkey || '/' || (l_partkey in (select x.l_partkey from lineitem x where x.l_orderkey = lineitem.l_orderkey and x.l_linenumber % 2 = 1)), ';' order by p_size, 'part:' || l_partkey) as bundle from lineitem join part on l_partkey = p_partkey group by l_orderkey""")
def evidence_bundle(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    evidence = li.select(ID("order", "l_orderkey").alias("supports_object_id"), ID("part", "l_partkey").alias("anchor_id"))
    n = li.groupBy(ID("order", "l_orderkey").alias("id")).agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, ID("part", "l_partkey"))).alias("provenance"))
    anchors = table(spark, sf_dir, "part").select(ID("part", "p_partkey").alias("id"), F.col("p_size").alias("page_number"), F.col("p_name").alias("text"))
    shown = F.transform("anchors", lambda a: F.concat_ws("/", a["page_number"], a["anchor_id"], a["named"].cast("string")))
    return graph.evidence_bundle(n, evidence, anchors).select("node_id", F.size("anchors").cast("long").alias("anchors"), F.array_join(shown, ";").alias("bundle"))


@query("select distinct 'order:' || l_orderkey as node_id from lineitem where l_partkey = 7")
def reverse_lookup(spark, sf_dir):
    evidence = table(spark, sf_dir, "lineitem").select(ID("order", "l_orderkey").alias("supports_object_id"), ID("part", "l_partkey").alias("anchor_id"))
    return graph.anchor_nodes(evidence, "part:7")


@query("select p_partkey, case when p_partkey % 4 = 0 then '2-4' when p_partkey % 4 = 1 then '' when p_partkey % 4 = 2 then '2-4,5-6' else '5-6' end as notes from part")
def anchor_contracts(spark, sf_dir):
    """Notes at 12-14 and 15-16 of a span, clipped to four ranges from 10 on and counted from their start."""
    note = lambda a, b: F.struct(F.lit(a).alias("start_char"), F.lit(b).alias("end_char"))
    m = F.col("p_partkey") % 4
    clipped = graph.anchor_notation(F.array(note(12, 14), note(15, 16)), nth(m, 10, 13, 10, 10), nth(m, 15, 15, 20, 16))
    kept = F.when(m == 3, F.filter(clipped, lambda n: n["start_char"] > 2)).otherwise(clipped)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(kept, lambda n: F.concat_ws("-", n["start_char"], n["end_char"])), ",").alias("notes"))


@query("""select 'n' || p_partkey as node_id, case p_partkey % 4 when 0 then 'claims' when 1 then 'figures' else 'equations' end as subtype, case p_partkey % 4 when 1 then 'S' || p_size when 2 then p_size || 'b' end as number, case p_partkey % 4 when 0 then 'RESULT' end as claim_type from part where p_partkey % 4 < 3 and p_partkey % 8 < 4""")
def created_subtypes(spark, sf_dir):
    m, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    rows = table(spark, sf_dir, "part").select(name("n", "p_partkey").alias("id"), nth(m, "RESULT", "FIGURE", "EQUATION", "TABLE").alias("type"), nth(m, "x", F.concat(F.lit("Figure S"), size), F.concat(F.lit("a = b\n("), size, F.lit("b)")), "t").alias("text"), "p_partkey")
    present = rows.where("p_partkey % 8 >= 4").select(F.col("id").alias("node_id"))
    return integrity.created_subtypes(rows, present)


@query("""select p_partkey, case p_partkey % 8 when 0 then 'Id is taken' when 1 then 'A document''s root is not a candidate' when 2 then 'Type and layer do not go together' when 3 then 'No source provenance' when 4 then 'Evidence must refer to this paper' when 5 then 'Confidence must lie between 0 and 1' when 6 then 'Attributed text does not match its source' end as reason from part""")
def candidate_nodes(spark, sf_dir):
    part, m = table(spark, sf_dir, "part"), F.col("p_partkey") % 8
    anchors = part.select(name("a", "p_partkey").alias("id"), F.when(m == 4, "q").otherwise("p").alias("paper_id"), F.concat(F.lit("the "), F.col("p_name")).alias("text"))
    requests = part.select(
        "p_partkey", name("n", "p_partkey").alias("id"), F.lit("p").alias("paper_id"), F.when(m == 1, "PAPER").otherwise("CLAIM").alias("type"), F.when(m == 2, "SOURCE").when(m == 1, "SOURCE").otherwise("ARGUMENT").alias("layer"),
        F.when(m == 3, F.array().cast("array<string>")).otherwise(F.array(name("a", "p_partkey"))).alias("provenance"), F.when(m == 5, 1.5).otherwise(0.5).alias("confidence"), F.lit("AUTHOR_CLAIM").alias("epistemic_status"), F.when(m == 6, "other").otherwise(F.col("p_name")).alias("text"),
    )
    return integrity.validated_nodes(requests, requests.where("p_partkey % 8 = 0").select("id"), anchors).select("p_partkey", "reason")


@query("""select p_partkey, case p_partkey % 5 when 0 then 'Self relations are not permitted' when 1 then 'Unknown relation' when 2 then 'EVIDENCE_FOR must target CLAIM or RESULT or CONCLUSION or HYPOTHESIS' when 3 then 'Prerequisites would form a cycle' end as reason from part""")
def candidate_edges(spark, sf_dir):
    """A node of each part and one beside it: loops, unknown relations, wrong targets, prerequisites against a stored one, and sound ones."""
    part, m = table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    n = part.select(F.explode(F.array(name("n", "p_partkey"), name("m", "p_partkey"))).alias("id"), F.lit("p").alias("paper_id"), F.lit("METHOD").alias("type"))
    stored = part.where("p_partkey % 5 = 3").select(name("s", "p_partkey").alias("id"), name("m", "p_partkey").alias("source_node_id"), name("n", "p_partkey").alias("target_node_id"), F.lit("PREREQUISITE_OF").alias("relation_type"), F.lit("SUPPORTED").alias("verification_status"))
    requests = part.select("p_partkey", name("r", "p_partkey").alias("id"), F.lit("p").alias("paper_id"), name("n", "p_partkey").alias("source_node_id"), F.when(m == 0, name("n", "p_partkey")).otherwise(name("m", "p_partkey")).alias("target_node_id"), nth(m, "USES", "LIKES", "EVIDENCE_FOR", "PREREQUISITE_OF", "PREREQUISITE_OF").alias("relation_type"))
    return integrity.validated_edges(requests, stored, n).select("p_partkey", "reason")


@query(f"""with {NODES_SQL}, {EDGES_SQL}, top as (select id from nodes order by type <> 'PAPER', id limit 20), b as (select source_node_id as a, target_node_id as b from edges union all select target_node_id, source_node_id from edges),
    near as (select 'supplier:3' as id union all (select distinct b from b where a = 'supplier:3' and b <> 'supplier:3' order by 1 limit 119)) from top union select id from near""")
def restored_selection(spark, sf_dir):
    return graph.restored(nodes(spark, sf_dir).withColumn("created_at", F.lit(0)), edges(spark, sf_dir), "supplier:3", 20)


@query(f"with {NODES_SQL} select id, type from nodes where id = 'customer:1'")
def preferred_node(spark, sf_dir):
    return graph.preferred(nodes(spark, sf_dir), "nothing", "customer:1").select("id", "type")


@query("select o_orderkey, o_orderkey % 4 in (0, 2) as tentative from orders")
def tentative_nodes(spark, sf_dir):
    """Candidates, reviewed ones whose review is current or not, and supported ones."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), nth(F.col("o_orderkey") % 4, "CANDIDATE", "VERIFIED", "VERIFIED", "SUPPORTED").alias("verification_status"))
    current = rows.where("verification_status = 'VERIFIED'").select("id", (F.col("id") % 4 == 1).alias("current"))
    return graph.tentative(rows, current).select(F.col("id").alias("o_orderkey"), "tentative")


# --- integrity


ANCHOR_FAULTS = ("Evidence source hash is stale", "Evidence span ownership is invalid", "Evidence page ownership is invalid", "Evidence page is outside the parsed document", "Evidence text does not match its source range", "Evidence coordinates do not match the source block", "Source notation does not match its span", "Evidence bounding box is invalid or outside its page")
NOTES = f"array<struct<start_char:int,end_char:int,raw:string,bbox:{BOX}>>"


def sources(spark, sf_dir) -> dict[str, DataFrame]:
    """A paper with a page, a span and an anchor for each supplier; a tenth each has one of eight faults, a tenth none of a paper."""
    s, m = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 10
    papers = spark.createDataFrame([("p", "h", 5)], "id string, source_hash string, page_count int")
    number = F.when(m == 4, 6).otherwise((F.col("s_suppkey") % 5 + 1).cast("int"))
    pages = s.select(name("g", "s_suppkey").alias("id"), F.when(m == 3, "q").otherwise("p").alias("paper_id"), number.alias("number"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), (F.col("s_suppkey") % 2 * 90).cast("int").alias("rotation"))
    at = F.when(m == 8, box(10, 10, 900, 30)).otherwise(box(10, 10, 200, 30))
    note = F.array(F.struct(F.lit(0).alias("start_char"), F.lit(3).alias("end_char"), F.when(m == 7, "xxx").otherwise("Sup").alias("raw"), box(20, 12, 30, 20).alias("bbox")))
    spans = s.select(name("s", "s_suppkey").alias("id"), F.when(m == 2, "q").otherwise("p").alias("paper_id"), name("g", "s_suppkey").alias("page_id"), number.alias("page_number"), F.concat("s_name", F.lit(" and more")).alias("text"), at.alias("bbox"), note.cast(NOTES).alias("notation"), F.array("s_name").alias("section_titles"))
    anchors = s.select(
        name("a", "s_suppkey").alias("id"), F.when(m == 0, "none").otherwise("p").alias("paper_id"), F.when(m == 1, "old").otherwise("h").alias("source_hash"), name("s", "s_suppkey").alias("span_id"), number.alias("page_number"),
        F.lit(0).alias("start_char"), F.length("s_name").alias("end_char"), F.when(m == 5, "else").otherwise(F.col("s_name")).alias("text"), F.when(m == 6, box(1, 1, 2, 2)).otherwise(at).alias("bbox"),
    )
    return {"papers": papers, "pages": pages, "spans": spans, "anchors": anchors}


_FAULT_SQL = "case s_suppkey % 10 when 0 then 'Evidence must refer to this paper' " + " ".join(f"when {i} then '{f}'" for i, f in enumerate(ANCHOR_FAULTS, 1)) + " end"


@query(f"select 'a' || s_suppkey as id, {_FAULT_SQL} as fault from supplier")
def anchor_validation(spark, sf_dir):
    t = sources(spark, sf_dir)
    return integrity.anchor_faults(t["anchors"], t["spans"], t["pages"], t["papers"]).select("id", "fault")


@query("select p_partkey, case when p_partkey % 6 between 1 and 4 then 'Notation does not match its span' when p_partkey % 6 = 5 then 'A section title is not part of its block' end as fault from part")
def notation_validation(spark, sf_dir):
    """Planted notes: sound, on other text, overlapping, out of the text, out of the box; and a strange title."""
    m = F.col("p_partkey") % 6
    note = lambda a, b, raw, x1=30.0: F.struct(F.lit(a).alias("start_char"), F.lit(b).alias("end_char"), F.lit(raw).alias("raw"), box(20, 12, x1, 20).alias("bbox"))
    good = [note(0, 2, "ab"), note(3, 4, "d")]
    notes = nth(m, *(F.array(*x) for x in (good, [good[0], note(3, 4, "x")], [note(0, 2, "ab"), note(1, 3, "bc")], [good[0], note(5, 9, "f")], [good[0], note(3, 4, "d", 999.0)], good)))
    fault = integrity.notation_fault(F.lit("abcdef"), box(10, 10, 100, 30), notes, F.when(m == 5, F.array(F.lit("zz"))).otherwise(F.array(F.lit("cd"))))
    return table(spark, sf_dir, "part").select("p_partkey", fault.alias("fault"))


def evidence_graph(spark, sf_dir) -> dict[str, DataFrame]:
    """The planted sources, and the star schema's nodes and edges on them: each node cites the anchor of a supplier; a node in 13 is reviewed, half of these with a fitting review."""
    t = sources(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier").count()
    n = nodes(spark, sf_dir).withColumn("_k", F.regexp_extract("id", r"\d+$", 0).cast("long"))
    reviewed = (F.col("type") == "CLAIM") & (F.col("_k") % 13 == 0)
    n = n.select(
        "id", F.lit("p").alias("paper_id"), "type", "layer", F.col("label").alias("text"), F.lit("BACKGROUND_KNOWLEDGE").alias("epistemic_status"), F.when(reviewed, "VERIFIED").otherwise("CANDIDATE").alias("verification_status"),
        F.when(reviewed, "SCIENTIFIC_VALIDITY").when((F.col("type") == "EVIDENCE") & (F.col("_k") % 11 == 0), "SOURCE_ATTRIBUTION").alias("verification_scope"), F.when(F.col("type") == "PAPER", F.array().cast("array<string>")).otherwise(F.array(name("a", F.col("_k") % suppliers))).alias("provenance"), F.lit(2).alias("version"), "_k",
    )
    # Dealt by source: the first join of the edges' check needs no other shuffle of them.
    e = edges(spark, sf_dir).repartition("source_node_id").distinct().select(F.concat_ws(">", "source_node_id", "target_node_id").alias("id"), F.lit("p").alias("paper_id"), "source_node_id", "target_node_id", "relation_type", F.lit("SUPPORTED").alias("verification_status"), F.lit(None).cast("string").alias("verification_scope"), F.array(F.lit("a9")).alias("provenance"), F.lit(1).alias("version"))
    evidence = n.where("type = 'CLAIM'").select(F.concat(F.lit("ev:"), F.col("id")).alias("id"), F.col("id").alias("supports_object_id"), F.when(F.col("_k") % 17 == 0, "a0").otherwise(name("a", F.col("_k") % suppliers)).alias("anchor_id"), "_k")
    verified = n.where("verification_status = 'VERIFIED'")
    prints = integrity.fingerprints(verified.select("id", "provenance", *(F.col(c) if c in n.columns else F.lit(None).cast("string").alias(c) for c in integrity.PRINTED)), t["anchors"], integrity.PRINTED)
    reviews = verified.join(prints, "id").select(
        F.concat(F.lit("r:"), F.col("id")).alias("id"), F.col("id").alias("object_id"), F.lit("node").alias("object_kind"), F.lit(1).alias("object_version"), F.lit("p").alias("paper_id"), F.lit("h").alias("source_hash"), F.lit("VERIFIED").alias("decision"), F.lit("SCIENTIFIC_VALIDITY").alias("scope"),
        F.lit("me").alias("reviewer"), F.lit("it is well founded").alias("reason"), F.lit("theory").alias("scientific_basis"), F.when(F.col("_k") % 26 == 0, F.col("fingerprint")).otherwise("stale").alias("evidence_fingerprint"),
    )
    return t | {"nodes": n.drop("_k"), "edges": e, "evidence": evidence.drop("_k"), "reviews": reviews}


@query(f"""with {NODES_SQL}, {EDGES_SQL}, k as (select *, regexp_extract(id, '\\d+$')::bigint as k, (select count(*) from supplier) as ns from nodes), ends as (select source_node_id as id from edges union select target_node_id from edges),
    d as (select id, lag(id) over (partition by type, lower(trim(label)) order by id) as previous from nodes), u as (select distinct source_node_id || '>' || target_node_id as id, target_node_id, relation_type from edges),
    i as (select 'ORPHAN_NODE' as code, id from nodes where type <> 'PAPER' and id not in (from ends)
        union all select 'DUPLICATE_CANDIDATE', id from d where previous is not null
        union all select 'INVALID_EDGE', u.id from u join nodes t on target_node_id = t.id where relation_type = 'EVIDENCE_FOR' and t.type not in ('CLAIM', 'RESULT', 'CONCLUSION', 'HYPOTHESIS')
        union all select 'INVALID_NODE', id from k where type <> 'PAPER' and k % ns % 10 <> 9
        union all select 'CONFLICTING_VERIFICATION', id from k where type = 'EVIDENCE' and k % 11 = 0 union all select 'CONFLICTING_VERIFICATION', id from k where type = 'CLAIM' and k % 13 = 0 and k % 26 <> 0
        union all select 'INVALID_ANCHOR', 'a' || s_suppkey from supplier where s_suppkey % 10 <> 9
        union all select 'INVALID_EVIDENCE', 'ev:' || id from k where type = 'CLAIM' and k % 17 = 0 and k % ns <> 0)
    select code, count(*) as n, min(id) as first from i group by 1""")
def integrity_report(spark, sf_dir):
    """The whole report over all nodes and edges: each code with its number of issues."""
    t = evidence_graph(spark, sf_dir)
    found = integrity.report(**t)
    return found.select("code", "object_id").groupBy("code").agg(F.count("*").alias("n"), F.min("object_id").alias("first"))


@query("select 'planted' as graph, false as structurally_valid union all select 'sound', true")
def structural_validity(spark, sf_dir):
    """The planted graph, and what is left of it without faulty anchors, what cites them, reviews, and evidence edges: its issues are warnings."""
    t = evidence_graph(spark, sf_dir)
    sound = F.regexp_extract("id", r"\d+$", 0).cast("long") % 10 == 9
    anchors = t["anchors"].where(sound)
    cited = t["nodes"].where("verification_status = 'CANDIDATE' and verification_scope is null").withColumn("_a", F.get("provenance", F.lit(0)))
    own = cited.join(anchors.select(F.col("id").alias("_a")), "_a", "left_semi").drop("_a")
    kept = own.unionByName(t["nodes"].where("type = 'PAPER'"))
    ends = [kept.select(F.col("id").alias(end)) for end in ("source_node_id", "target_node_id")]
    links = t["edges"].where("relation_type <> 'EVIDENCE_FOR'").join(ends[0], "source_node_id", "left_semi").join(ends[1], "target_node_id", "left_semi")
    rest = t | {"anchors": anchors, "spans": t["spans"].join(anchors.select(F.col("span_id").alias("id")), "id", "left_semi"), "nodes": kept, "edges": links, "evidence": t["evidence"].where("false"), "reviews": t["reviews"].where("false")}

    def one(name_: str, tables: dict[str, DataFrame]) -> DataFrame:
        """A graph's verdict, written: its report's steps and shuffles are deleted before the next graph's begins."""
        with scratch(spark) as keep:
            keep.append(written(integrity.structurally_valid(integrity.report(**tables)).select(F.lit(name_).alias("graph"), "structurally_valid"), "verdict"))
        return keep[0]

    return one("planted", t).unionByName(one("sound", rest))


@query("select 's' || s_suppkey as id from supplier where s_suppkey % 3 = 0")
def unanchored_spans(spark, sf_dir):
    t = sources(spark, sf_dir)
    return integrity.unanchored(t["spans"], t["anchors"].where("cast(substring(id, 2) as int) % 3 <> 0")).select("id")


@query("""with l as (select l_orderkey, l_partkey, p_name, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as pos, p_size from lineitem join part on l_partkey = p_partkey),
    a as (select l_orderkey, string_agg('{"pos":' || pos || ',"anchor_id":"a' || l_partkey || '","a":{"page_number":' || p_size || ',"text":"' || p_name || '"}}', ',' order by pos) as anchors from l group by 1)
    select o_orderkey, sha256('{"o":{"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' || case when anchors is null then '' else ',"anchors":[' || anchors || ']' end || '}') as fingerprint from orders left join a on o_orderkey = l_orderkey""")
def fingerprint(spark, sf_dir):
    anchors = table(spark, sf_dir, "part").select(name("a", "p_partkey").alias("id"), F.col("p_size").alias("page_number"), F.col("p_name").alias("text"))
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: name("a", x["l_partkey"])).alias("provenance"))
    objects = table(spark, sf_dir, "orders").join(own, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority", "provenance")
    return integrity.fingerprints(objects, anchors, ["o_orderstatus", "o_orderpriority"]).select(F.col("id").alias("o_orderkey"), "fingerprint")


@query("""select o_orderkey, case o_orderkey % 7 when 0 then 'Object not found' when 1 then 'Stale source hash or object version' when 2 then 'Verification needs evidence' when 3 then 'Paper identity is not a claim' when 4 then 'Source review verifies literal attribution only' end as fault, case when o_orderkey % 7 > 4 then 4 end::int as new_version from orders""")
def review_requests(spark, sf_dir):
    o, m = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 7
    objects = o.where("o_orderkey % 7 > 0").select(name("n", "o_orderkey").alias("id"), F.lit(3).alias("version"), F.lit("h").alias("source_hash"), F.when(m == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("provenance"), F.lit("node").alias("kind"), F.when(m == 3, "PAPER").otherwise("CLAIM").alias("type"), F.when(m == 4, "AI_INTERPRETATION").otherwise("AUTHOR_CLAIM").alias("epistemic_status"))
    requests = o.select("o_orderkey", name("n", "o_orderkey").alias("object_id"), F.when(m == 1, 2).otherwise(3).alias("expected_version"), F.lit("h").alias("source_hash"), F.lit("VERIFIED").alias("decision"), F.when(m == 6, "SCIENTIFIC_VALIDITY").otherwise("SOURCE_ATTRIBUTION").alias("scope"))
    return integrity.review_outcomes(requests, objects).select("o_orderkey", "fault", "new_version")


@query("select 'e' || p_partkey as id from part where p_partkey % 6 = 5")
def eligible_edges(spark, sf_dir):
    """Edges of a part's two nodes: inactive, invalid, without evidence, on a cycle (two), and sound."""
    part, m = table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    n = part.select(F.explode(F.array(name("n", "p_partkey"), name("m", "p_partkey"))).alias("id"), F.lit("p").alias("paper_id"), F.lit("METHOD").alias("type"), F.lit("VERIFIED").alias("verification_status"))
    one = lambda prefix, turned: part.where("p_partkey % 6 in (3, 4)" if turned else "true").select(name(prefix, "p_partkey").alias("id"), F.lit("p").alias("paper_id"), name("m" if turned else "n", "p_partkey").alias("source_node_id"), name("n" if turned else "m", "p_partkey").alias("target_node_id"), F.when(m.isin(3, 4), "PREREQUISITE_OF").when(m == 1, "NONE").otherwise("USES").alias("relation_type"), F.when(m == 0, "REJECTED").otherwise("VERIFIED").alias("verification_status"), F.when(m == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("provenance"))
    e = one("e", False).unionByName(one("back", True))
    current = e.select("id", F.lit(True).alias("current")).unionByName(n.select("id", F.lit(True).alias("current")))
    return integrity.path_edges(e, n, current).select("id")


@query("select 'l' || l_orderkey as link from lineitem group by l_orderkey having count(*) filter (l_returnflag = 'R') > 0")
def lapsed_reviews(spark, sf_dir):
    """Links whose dependencies are an order's lines; a returned line has another hash in the new build."""
    li = table(spark, sf_dir, "lineitem")
    rows = lambda changed: li.select(name("l", "l_orderkey").alias("link"), F.concat_ws("/", "l_linenumber", "l_partkey").alias("path"), F.concat(F.col("l_partkey").cast("string"), F.when(F.lit(changed) & (F.col("l_returnflag") == "R"), "x").otherwise("")).alias("hash"))
    return catalog.lapsed(rows(False), rows(True), "link")


@query("""select p_partkey, field, fault from (select p_partkey, case p_partkey % 9 when 0 then '*' when 1 then 'name' when 2 then 'size' when 3 then 'kind' when 4 then 'tags' when 5 then 'size' when 6 then 'name' when 7 then 'tags' end as field,
    case p_partkey % 9 when 0 then 'no object' when 1 then 'missing' when 2 then 'type' when 3 then 'enum' when 4 then 'items' when 5 then 'range' when 6 then 'range' when 7 then 'type' end as fault from part) where field is not null""")
def contract_validation(spark, sf_dir):
    m, size = F.col("p_partkey") % 9, F.col("p_size").cast("string")
    title = F.when(m == 1, "null").when(m == 6, '""').otherwise(F.concat(F.lit('"'), F.col("p_name"), F.lit('"')))
    json = F.concat(F.lit('{"name": '), title, F.lit(', "size": '), F.when(m == 2, F.concat(F.lit('"'), size, F.lit('"'))).when(m == 5, "99").otherwise(size), F.lit(', "kind": "'), F.when(m == 3, "z").otherwise("a"), F.lit('", "tags": '), F.when(m == 4, '["x", 1]').when(m == 7, '"x"').otherwise('["x"]'), F.lit("}"))
    fields = {"name": {"type": "string", "required": True, "min": 1}, "size": {"type": "number", "min": 1, "max": 50}, "kind": {"type": "string", "enum": ("a", "b")}, "tags": {"type": "array", "items": "string", "max": 3}, "note": {"type": "string"}}
    return integrity.contract_faults(table(spark, sf_dir, "part").select("p_partkey", F.when(m == 0, "[1").otherwise(json).alias("j")), "p_partkey", "j", fields)


@query("""select o_orderkey, 'customer' as field, (o_custkey + 5)::varchar as value from orders where o_custkey + 5 not in (select c_custkey from customer)
    union all select o_orderkey, 'parts', x::varchar from (select o_orderkey, unnest([o_orderkey % 3000, o_orderkey % 7]) as x from orders) where x not in (select p_partkey from part)""")
def reference_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 5).alias("customer"), F.array(F.col("o_orderkey") % 3000, F.col("o_orderkey") % 7).alias("parts"))
    return integrity.reference_faults(rows, "o_orderkey", {"customer": (table(spark, sf_dir, "customer"), "c_custkey"), "parts": (table(spark, sf_dir, "part"), "p_partkey")})


# --- the knowledge graph and the artifact index


@query("""with t as (select p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) as a, list_distinct(regexp_extract_all(lower(p_brand || ' ' || p_name), '[a-z0-9]+')) as b from part)
    select p_partkey, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 9) as score from t""")
def set_jaccard(spark, sf_dir):
    a, b = (tx.token_set(F.concat_ws(" ", *c)) for c in (("p_name", "p_type"), ("p_brand", "p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(tx.jaccard(a, b), 9).alias("score"))


@query("with p as (select distinct l_orderkey as paper, l_partkey as concept from lineitem where l_partkey % 10 = 0) select x.paper as source, count(*) as partners from (select distinct x.paper, y.paper as other from p x join p y on x.concept = y.concept and x.paper < y.paper) x group by 1")
def shared_principles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_partkey % 10 = 0").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("concept"))
    pairs = similarity.shared_principles(rows)
    return pairs.groupBy(F.col(pairs.columns[0]).alias("source")).agg(F.count("*").alias("partners"))


@query("""with c as (select n_nationkey as k from nation) select 'concept:' || ((k + 1) % 25) as source, 'concept:' || k as target, 'prerequisite' as type from c union all select 'concept:' || k, 'concept:' || ((k + 2) % 25), 'related' from c union all select 'concept:' || k, 'concept:' || ((k + 3) % 25), 'extends' from c where k % 2 = 0""")
def concept_cards(spark, sf_dir):
    at = lambda n: ((F.col("n_nationkey") + n) % 25).cast("string")
    none = F.array().cast("array<string>")
    cards = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.array(at(1)).alias("prerequisites"), F.array(at(2), at(0)).alias("related"), none.alias("contrasts"), F.when(F.col("n_nationkey") % 2 == 0, F.array(at(3))).otherwise(none).alias("extends"), none.alias("replaces"))
    return catalog.card_edges(cards)


@query("select c_custkey, case c_custkey % 5 when 0 then 'introduces' when 1 then 'uses' when 2 then 'contrasts' when 3 then 'extends' else 'uses' end as relation from customer")
def role_relations(spark, sf_dir):
    role = nth(F.col("c_custkey") % 5, "introduced", "used", "compared", "extended", "other")
    return table(spark, sf_dir, "customer").select("c_custkey", catalog.role_relation(role).alias("relation"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'verified' when 1 then 'candidate' when 2 then 'candidate' else 'auto' end as status, p_partkey % 4 in (1, 2) as lapsed, case when p_partkey % 4 < 3 then 'me' end as reviewer from part")
def carried_reviews(spark, sf_dir):
    """Verified links: unchanged, with new evidence, of another weight; and one never reviewed."""
    part, m = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    base = [F.col("p_partkey"), F.array(F.lit("i")).alias("inputs")]
    old = part.select(*base, F.array(F.lit("e")).alias("evidence"), F.lit(0.5).alias("weight"), F.when(m < 3, "verified").otherwise("auto").alias("status"), F.when(m < 3, "me").alias("reviewer"))
    new = part.select(*base, F.when(m == 1, F.array(F.lit("f"))).otherwise(F.array(F.lit("e"))).alias("evidence"), F.when(m == 2, 0.6).otherwise(0.5).alias("weight"), F.lit("auto").alias("status"))
    return catalog.carried_reviews(old, new, ["p_partkey"]).select("p_partkey", "status", "lapsed", "reviewer")


def planted_links(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between parts, aliases of two steps and one to nothing, and the parts' records; five of eight links have a fault."""
    part, m = table(spark, sf_dir, "part"), F.col("p_partkey") % 8
    records = part.select(name("r", "p_partkey").alias("id"), name("p/", "p_partkey").alias("path"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("content_hash"))
    aliases = part.where("p_partkey % 8 = 1").select(F.explode(F.array(F.struct(name("x", "p_partkey").alias("alias"), name("y", "p_partkey").alias("id")), F.struct(name("y", "p_partkey").alias("alias"), name("r", "p_partkey").alias("id")))).alias("a")).select("a.*")
    links = part.select(
        "p_partkey", F.when(m == 1, name("x", "p_partkey")).when(m == 2, name("none", "p_partkey")).otherwise(name("r", "p_partkey")).alias("source"), F.when(m == 3, "gone").otherwise("r0").alias("target"), F.when(m == 7, "similar-text").otherwise("uses").alias("rel"),
        F.when(m == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("evidence"), F.when(m == 6, float("nan")).when(m == 0, 1.5).otherwise(0.5).alias("weight"), F.when(m == 5, "odd").otherwise("auto").alias("status"),
    )
    return links, aliases, records


@query("""select p_partkey, 'r' || p_partkey as source, 'r0' as target, case when p_partkey % 8 = 7 then 'candidate' else 'auto' end as status, null::varchar as fault from part where p_partkey % 8 in (1, 7)
    union all select p_partkey, case when p_partkey % 8 = 2 then 'none' else 'r' end || p_partkey, case when p_partkey % 8 = 3 then 'gone' else 'r0' end, case when p_partkey % 8 = 5 then 'odd' else 'auto' end, case p_partkey % 8 when 0 then 'bad weight' when 2 then 'dangling source' when 3 then 'dangling target' when 4 then 'no evidence' when 5 then 'bad status' else 'bad weight' end from part where p_partkey % 8 not in (1, 7)""")
def canonical_links(spark, sf_dir):
    good, bad = catalog.canonical_links(*planted_links(spark, sf_dir))
    return good.select("p_partkey", "source", "target", "status", F.lit(None).cast("string").alias("fault")).unionByName(bad.select("p_partkey", "source", "target", "status", "fault"))


@query("""select object, fault from (select case when p_partkey % 8 = 1 then 'x' when p_partkey % 8 = 2 then 'none' else 'r' end || p_partkey || '>' || case when p_partkey % 8 = 3 then 'gone' else 'r0' end as object,
    unnest(case p_partkey % 8 when 1 then ['dangling source'] when 2 then ['dangling source'] when 3 then ['dangling target'] when 4 then ['no evidence'] when 0 then ['bad weight'] when 6 then ['bad weight'] else [] end) as fault from part)""")
def index_validation(spark, sf_dir):
    links, aliases, records = planted_links(spark, sf_dir)
    return catalog.index_faults(records, links.withColumn("weight", F.when(F.isnan("weight"), -1.0).otherwise(F.col("weight"))), aliases)


@query("select 'r' || p_partkey || '>r0' as object, case p_partkey % 8 when 4 then 'no evidence' else 'bad weight' end as fault from part where p_partkey % 8 in (0, 4, 6) union all select 'none' || p_partkey || '>r0', 'no source' from part where p_partkey % 8 = 2 union all select 'x' || p_partkey || '>r0', 'no source' from part where p_partkey % 8 = 1 union all select 'r' || p_partkey || '>gone', 'no target' from part where p_partkey % 8 = 3")
def graph_validation(spark, sf_dir):
    links, _, records = planted_links(spark, sf_dir)
    return catalog.graph_faults(records.select("id"), links)


@query("select case when p_partkey % 8 = 1 then 'x' when p_partkey % 8 = 2 then 'none' else 'r' end || p_partkey as asked, case when p_partkey % 8 = 2 then 'none' else 'r' end || p_partkey as id, case when p_partkey % 8 = 2 then 'unknown' when p_partkey % 8 = 3 then 'changed' end as fault from part")
def artifact_lookup(spark, sf_dir):
    links, aliases, records = planted_links(spark, sf_dir)
    asked = links.select(F.col("source").alias("asked"), F.when(F.col("p_partkey") % 8 == 3, "other").when(F.col("p_partkey") % 8 == 4, F.sha2(F.col("p_partkey").cast("string"), 256)).alias("expected_hash"))
    return catalog.lookup(asked, aliases, records).select("asked", "id", "fault")


@query("""select 'records' as part, count(*) as n from part union all select 'repeats', count(*) from part where p_partkey % 9 = 0 union all select 'aliases', 2 * count(*) from part where p_partkey % 8 = 1 union all select 'links', count(*) from part where p_partkey % 8 in (1, 7)
    union all select 'manual', count(*) from part where p_partkey % 8 = 7 union all select 'tasks', count(*) from part where p_partkey % 5 > 0
    union all select 'issues', (select count(*) from part where p_partkey % 9 = 0) + (select count(*) from part where p_partkey % 8 not in (1, 7)) + (select count(*) from part where p_partkey % 5 = 0) + (select count(*) from part where p_partkey % 6 = 0)""")
def artifact_index_build(spark, sf_dir):
    """The whole index: a ninth of the ids at two paths, manual links beside inferred ones, tasks on records that are not there, unknown kinds."""
    links, aliases, records = planted_links(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    first = records.join(part.select(name("r", "p_partkey").alias("id"), F.when(F.col("p_partkey") % 6 == 0, "odd").otherwise("paper").alias("kind")), "id").withColumn("source", F.lit("files"))
    second = part.where("p_partkey % 9 = 0").select(name("r", "p_partkey").alias("id"), name("q/", "p_partkey").alias("path"), F.lit("h").alias("content_hash"), F.lit("paper").alias("kind"), F.lit("files").alias("source"))
    own = links.withColumn("origin", F.lit("inferred"))
    manual = own.where("p_partkey % 8 = 7").withColumns({"origin": F.lit("manual"), "evidence": F.array(F.lit("z"))})
    tasks = part.select(name("t", "p_partkey").alias("task"), F.when(F.col("p_partkey") % 5 == 0, "nothing").otherwise(name("r", "p_partkey")).alias("target"))
    built = catalog.full_index([first, second], aliases, own.unionByName(manual).drop("p_partkey"), tasks)
    built["manual"] = built["links"].where("origin = 'manual'")
    out = None
    for part_name, df in built.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(part_name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select 'frequency' as section, p_partkey::varchar as item, (p_size)::double as value from part where p_partkey % 10 < 5 union all select 'not understood', p_partkey::varchar, 1.0 from part where p_partkey % 4 <> 0
    union all select 'cluster', min(p_partkey)::varchar, count(*)::double from part where p_partkey % 10 < 8 group by p_partkey // 10 union all select 'type', case when p_partkey % 3 = 0 then 'principle' else 'concept' end, count(*)::double from part group by 2
    union all select 'bridge', p_partkey::varchar, 0.5 from part where p_partkey % 50 = 1 union all select 'gap', p_partkey::varchar, 1.0 from part where p_partkey % 10 between 5 and 6 union all select 'isolated', p_partkey::varchar, 1.0 from part where p_partkey % 10 >= 8""")
def knowledge_report(spark, sf_dir):
    """Parts as concepts in chains of eight out of ten; the fifth and sixth of each are needed and have no paper."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    n = part.select(k.alias("id"), F.when(k % 3 == 0, "principle").otherwise("concept").alias("type"), F.when(k % 4 == 0, True).alias("understood"))
    e = part.where(k % 10 < 7).select(k.alias("source"), (k + 1).alias("target"), F.lit("prerequisite").alias("type"))
    f = part.where(k % 10 < 5).select(k.alias("id"), F.col("p_size").alias("frequency"))
    b = part.select(k.alias("id"), F.when(k % 50 == 1, 0.5).otherwise(0.0).alias("score"))
    return catalog.knowledge_report(n, e, f, b)


@query("select 'x' || p_partkey as alias, 'a' || p_partkey as id from part union all select 'a' || p_partkey, 'a' || p_partkey from part union all select 'b' || p_partkey, 'b' || p_partkey from part union all select 'c' || p_partkey, 'c' || p_partkey from part")
def alias_cycles(spark, sf_dir):
    """Chains into cycles of three end where they enter them."""
    one = lambda a, b: F.struct(name(a, "p_partkey").alias("alias"), name(b, "p_partkey").alias("id"))
    rows = table(spark, sf_dir, "part").select(F.explode(F.array(one("x", "a"), one("a", "b"), one("b", "c"), one("c", "a"))).alias("a"))
    return graph.resolved(rows.select("a.*"))


@query("select 'a' || p_partkey as alias, case when p_partkey % 2 = 0 then 'b' else 'c' end || p_partkey as id from part union all select 'b' || p_partkey, 'c' || p_partkey from part where p_partkey % 2 = 1")
def role_fallbacks(spark, sf_dir):
    """Chains of two fallbacks, the second disabled for even parts."""
    one = lambda a, b, off: F.struct(name(a, "p_partkey").alias("alias"), name(b, "p_partkey").alias("id"), off.alias("disabled"))
    rows = table(spark, sf_dir, "part").select(F.explode(F.array(one("a", "b", F.lit(False)), one("b", "c", F.col("p_partkey") % 2 == 0))).alias("a"))
    return graph.resolved(history.fallbacks(rows.select("a.*")))


@query("""select 'near:' || (p_partkey // 4 + 1) as "group", p_partkey as first from part""")
def numbered_clusters(spark, sf_dir):
    """Chains of four parts as numbered groups."""
    part = table(spark, sf_dir, "part").where("p_partkey % 4 < 3").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return graph.numbered_groups(graph.components(part), "near").select("group", F.col("id").alias("first"))


@query("select coalesce(c_custkey, k) as key, coalesce(case when k % 3 <> 0 then 'new' end, case when c_custkey is not null then 'old' end) as a, coalesce(v, c_nationkey) as b from (select c_custkey, c_nationkey from customer where c_custkey % 2 = 0) full join (select c_custkey + 4 as k, c_nationkey + 100 as v from customer where c_custkey % 3 <> 1) x on c_custkey = k")
def record_upserts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    stored = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.lit("old").alias("a"), F.col("c_nationkey").alias("b"))
    new = c.where("c_custkey % 3 <> 1").select((F.col("c_custkey") + 4).alias("key"), F.when((F.col("c_custkey") + 4) % 3 != 0, "new").alias("a"), (F.col("c_nationkey") + 100).alias("b"))
    return catalog.upserted(stored, new, "key", ["a", "b"])


# --- tasks


@query("""select conv_id, turn, role, last_value(case when length(text) > 60 then text end ignore nulls) over (partition by conv_id order by turn, role, text rows unbounded preceding) as content from conversations""")
def carried_drafts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumns({"content": F.when(F.length("text") > 60, F.col("text")), "_o": F.struct("turn", "role", "text")})
    return history.carried(rows, ["conv_id"], "_o", "content").select("conv_id", "turn", "role", "content")


@query("select l_orderkey, l_linenumber, l_partkey, min((l_partkey % 50 > 0)::int) over (partition by l_orderkey) = 1 as apply from lineitem")
def applied_outputs(spark, sf_dir):
    """Lines as a task's outputs; those of every fiftieth part have an old base hash, so their whole order waits."""
    li = table(spark, sf_dir, "lineitem")
    stored = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 50 == 0, "new").otherwise("base").alias("hash"))
    outputs = li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("path"), F.lit("base").alias("base_hash"))
    return history.applied(outputs, stored).select("l_orderkey", "l_linenumber", "l_partkey", "apply")


@query("select o_orderkey as task, case o_orderkey % 5 when 0 then 'unknown type' when 1 then 'route' when 2 then 'attempts' else 'size' end as fault from orders where o_orderkey % 5 < 4")
def task_contracts(spark, sf_dir):
    m = F.col("o_orderkey") % 5
    contracts = spark.createDataFrame([("review", ["auto", "manual"], 3, 100)], "type string, routes array<string>, max_attempts int, max_size int")
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.when(m == 0, "odd").otherwise("review").alias("type"), F.when(m == 1, "else").otherwise("auto").alias("route"), F.when(m == 2, 4).otherwise(3).alias("attempts"), F.when(m == 3, 101).otherwise(100).alias("size"))
    return history.contract_faults(tasks, contracts)


@query("select 'n' || p_partkey as node_id, 'a' || p_partkey as source_anchor_id from part where p_partkey % 5 = 4")
def subtype_backfill(spark, sf_dir):
    """Nodes of another type, with a subtype row, without an anchor, with one of another paper, and those to be filled."""
    part, m = table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    n = part.select(name("n", "p_partkey").alias("id"), F.lit("p").alias("paper_id"), F.when(m == 0, "METHOD").otherwise("CLAIM").alias("type"), F.when(m == 2, F.array().cast("array<string>")).otherwise(F.array(name("a", "p_partkey"))).alias("provenance"))
    anchors = part.select(name("a", "p_partkey").alias("id"), F.when(m == 3, "q").otherwise("p").alias("paper_id"))
    present = part.where("p_partkey % 5 = 1").select(name("n", "p_partkey").alias("node_id"))
    return history.backfill(n, anchors, present, ("CLAIM",))


@query("select 's' || p_partkey as segment_id, case p_partkey % 5 when 0 then 'missing' when 1 then 'repeated' when 2 then 'empty' else 'foreign' end as fault from part where p_partkey % 5 < 4")
def segment_markers(spark, sf_dir):
    part, m = table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    ledger = part.where("p_partkey % 5 <> 3").select(name("s", "p_partkey").alias("segment_id"))
    bodies = F.when(m == 0, F.array().cast("array<string>")).when(m == 1, F.array(F.lit("a"), F.lit("b"))).when(m == 2, F.array(F.lit("  "))).otherwise(F.array(F.lit("a")))
    return segments.marker_faults(ledger, part.select(name("s", "p_partkey").alias("segment_id"), F.explode(bodies).alias("body")))


@query("select conv_id, count(*) = 3 and bool_and(role = case r when 1 then 'system' when 2 then 'user' else 'assistant' end) as fits from (select *, row_number() over (partition by conv_id order by turn, role, text) as r from conversations) group by 1")
def section_orders(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["role"]).alias("roles"))
    return found.select("conv_id", segments.sections_fit(F.col("roles"), ["system", "user", "assistant"]).alias("fits"))


# --- bibliography sync and catalogue


@query("select c_custkey, c_custkey % 4 in (0, 1) and c_custkey % 3 <> 0 and c_custkey % 5 <> 0 as wanted from customer")
def wanted_records(spark, sf_dir):
    """Wanted: in collection c0 or c1, with the tag `read`, not ignored; a fifth is ignored, a third not read."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.array(name("c", k % 4)).alias("collection_keys"), F.array_compact(F.array(F.when(k % 3 != 0, "read"), F.when(k % 5 == 0, "skip"), F.lit("x"))).alias("tags"))
    return rows.select("c_custkey", resolve.wanted(["c0", "c1"], ["read"], ["skip"]).alias("wanted"))


@query("select c_custkey, case c_custkey % 3 when 0 then 'key' || c_custkey when 1 then 'zotero-I' || c_custkey else 'zotero-' || sha256('a b/' || c_custkey)[1:12] end as cite_key from customer")
def safe_cite_keys(spark, sf_dir):
    k = F.col("c_custkey")
    own, item = nth(k % 3, name("key", k), "no good key/", "also bad *"), nth(k % 3, "I", name("I", k), name("a b/", k))
    return table(spark, sf_dir, "customer").select("c_custkey", resolve.cite_key(own, item).alias("cite_key"))


@query("select c_custkey, case when c_custkey % 4 = 0 then '' else 'b' || (c_custkey % 40) end as doi_key, c_custkey % 4 <> 0 and count(*) over (partition by c_custkey % 40) > 1 as same_doi, c_custkey % 7 = 0 as same_key from customer union all select c_custkey, '', false, true from customer where c_custkey % 7 = 0")
def batch_repeats(spark, sf_dir):
    """A quarter without a DOI, which is no repeat of another; a seventh whose key comes twice."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 4 == 0, "").otherwise(name("b", k % 40)).alias("doi_key"))
    rows = rows.unionByName(rows.where("c_custkey % 7 = 0").withColumn("doi_key", F.lit("")))
    return resolve.batch_repeats(rows, ["c_custkey"])


@query("""select c_custkey as paper, 'topic:Physics' as topic, case when c_custkey % 4 = 0 then 'manual' else 'sync' end as origin, case when c_custkey % 4 = 0 then 'auto' when c_custkey % 4 = 1 then 'verified' else 'auto' end as status from customer
    union all select c_custkey, 'topic:t' || c_custkey % 3, 'sync', 'auto' from customer union all select c_custkey, 'topic:kept', 'manual', 'auto' from customer where c_custkey % 4 = 0""")
def category_links(spark, sf_dir):
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    records = c.select(k.alias("paper"), F.array(F.lit("C1"), F.lit("C9")).alias("collection_keys"), F.array(name("t", k % 3)).alias("tags"))
    stored = c.where("c_custkey % 4 < 2").select(k.alias("paper"), F.lit("topic:Physics").alias("topic"), F.when(k % 4 == 0, "manual").otherwise("sync").alias("origin"), F.when(k % 4 == 0, "auto").otherwise("verified").alias("status"))
    stored = stored.unionByName(c.where("c_custkey % 4 = 0").select(k.alias("paper"), F.lit("topic:kept").alias("topic"), F.lit("manual").alias("origin"), F.lit("auto").alias("status")))
    return resolve.category_links(records, {"C1": "Physics"}, stored)


@query("select c_custkey, 'f' || (c_custkey * 2 + 1) as path from customer where c_custkey * 2 + 1 not in (select p_partkey from part)")
def missing_attachments(spark, sf_dir):
    k = F.col("c_custkey")
    records = table(spark, sf_dir, "customer").select("c_custkey", F.array(name("f", k * 0), name("f", k * 2 + 1)).alias("attachment_paths"))
    return resolve.missing_attachments(records, table(spark, sf_dir, "part").select(name("f", "p_partkey").alias("path")), "c_custkey")


@query("select c_custkey, row_number() over (order by (1990 + c_nationkey)::varchar, c_custkey) as place from customer")
def year_timeline(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 1990).alias("year"))
    return catalog.timeline(rows, "year", "c_custkey").select("c_custkey", "place")


@query("select c_mktsegment as role, c_custkey, case when n_nationkey < 20 then n_regionkey || ' / ' || n_name else n_name end as path from customer join nation on c_nationkey = n_nationkey where c_mktsegment in ('BUILDING', 'MACHINERY')")
def role_sections(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("segment"), F.array("n_name").alias("topics"))
    paths = nation.where("n_nationkey < 20").select(F.col("n_name").alias("topic"), F.array(F.col("n_regionkey").cast("string"), F.col("n_name")).alias("path"))
    return catalog.role_sections(rows, ("BUILDING", "MACHINERY"), "c_custkey", "segment", "topics", paths)


# --- evaluation


@query("select p_partkey, p_size + 4 <= 30 + 1 as inside from part")
def box_containment(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", evaluate.contains(box(0, 0, 30, 30), box(1, 1, size + 4, size + 4)).alias("inside"))


def gold_set(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of parts with an anchor each on pages of papers; gold items of every second part with two components."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    paper, page = name("paper", k % 20), (k % 3 + 1).cast("int")
    n = part.select(name("n", k).alias("id"), nth(k % 3, "RESULT", "CLAIM", "SECTION").alias("type"), F.concat(F.lit("The  "), F.col("p_name"), F.lit(" number "), k.cast("string"), F.lit(".")).alias("text"), F.array(name("a", k)).alias("provenance"))
    anchors = part.select(name("a", k).alias("id"), paper.alias("paper_id"), page.alias("page_number"), F.when(k % 5 == 0, box(50, 50, 60, 60)).otherwise(box(0, 0, 30, 30)).alias("bbox"))
    part_of = lambda text: F.struct(text.alias("text"), box(1, 1, 20, 20).alias("bbox"))
    gold = part.where("p_partkey % 2 = 0").select(name("g", k).alias("id"), F.lit("RESULT").alias("type"), F.when(k % 7 == 0, "paperX").otherwise(paper).alias("paper_id"), page.alias("page"), F.array(part_of(F.col("p_name")), part_of(F.concat(F.lit("number "), k.cast("string"), F.lit(".")))).alias("components"))
    return gold, n, anchors


@query("select 'g' || p_partkey as gold_id, case when p_partkey % 3 < 2 and p_partkey % 5 > 0 and p_partkey % 7 > 0 then 'n' || p_partkey end as node_id, case when p_partkey % 3 < 2 and p_partkey % 5 > 0 and p_partkey % 7 > 0 then p_partkey % 3 = 0 end as same_type from part where p_partkey % 2 = 0")
def gold_matching(spark, sf_dir):
    return evaluate.gold_matches(*gold_set(spark, sf_dir)).select("gold_id", "node_id", "same_type")


@query("with w as (select distinct p_partkey % 20 as paper, p_partkey % 3 as page from part where p_partkey % 14 = 3) select 'n' || p_partkey as id from part where p_partkey % 3 < 2 and p_partkey % 5 > 0 and (p_partkey % 20, p_partkey % 3) in (select (paper, page) from w)")
def window_predictions(spark, sf_dir):
    _, n, anchors = gold_set(spark, sf_dir)
    k = F.col("p_partkey")
    windows = table(spark, sf_dir, "part").where("p_partkey % 14 = 3").select(name("paper", k % 20).alias("paper_id"), (k % 3 + 1).cast("int").alias("page"), box(2, 2, 9, 9).alias("bbox"))
    return evaluate.in_windows(n, anchors, windows).select("id")


@query("select p_partkey, case p_partkey % 4 when 0 then '(gone)' when 1 then 'size' when 2 then 'name,size' end as drift from part where p_partkey % 4 < 3")
def ledger_drift(spark, sf_dir):
    part, m = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    ledger = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    now = part.where("p_partkey % 4 > 0").select("p_partkey", F.when(m == 2, "other").otherwise(F.col("p_name")).alias("name"), F.when(m.isin(1, 2), F.lit(None)).otherwise(F.col("p_size")).alias("size"))
    return evaluate.drifted(ledger, now, "p_partkey", ["name", "size"])


def two_builds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An old and a new build: unchanged, another status, another type, twice the same, only new, only old."""
    part, k, m = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_partkey") % 6
    rows = lambda which, prefix, kind, status: part.where(which).select(name(prefix, k).alias("id"), F.lit(kind).alias("type"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("text"), F.lit(status).alias("status"), F.lit("h").alias("source_hash"))
    old = rows("p_partkey % 6 in (0, 1, 2, 5)", "o", "CLAIM", "x").unionByName(rows("p_partkey % 6 = 3", "o", "CLAIM", "x")).unionByName(rows("p_partkey % 6 = 3", "o2", "CLAIM", "x"))
    new = rows("p_partkey % 6 in (0, 3, 4)", "n", "CLAIM", "x").unionByName(rows("p_partkey % 6 = 1", "n", "CLAIM", "y")).unionByName(rows("p_partkey % 6 = 2", "n", "RESULT", "x"))
    return old, new


VERSIONS = """select 'n' || p_partkey as new_id, case when p_partkey % 6 < 3 then 'o' || p_partkey end as old_id, case p_partkey % 6 when 0 then 'EXACT' when 1 then 'NONMATERIAL' when 2 then 'MATERIAL' when 3 then 'AMBIGUOUS_MATCH' else 'NEW_CANDIDATE' end as state from part where p_partkey % 6 < 5
    union all select null, 'o' || p_partkey, 'REMOVED_CANDIDATE' from part where p_partkey % 6 in (3, 5) union all select null, 'o2' || p_partkey, 'REMOVED_CANDIDATE' from part where p_partkey % 6 = 3"""


@query(VERSIONS)
def version_states(spark, sf_dir):
    return evaluate.version_map(*two_builds(spark, sf_dir), ["text", "source_hash"], ("text", "type"), ("status",))


@query(f"with v as ({VERSIONS}) select new_id, old_id, state, case when new_id is null then 'REMOVED' when old_id is null or old_id[2:]::bigint % 4 = 1 then 'NEW_UNREVIEWED' when state = 'EXACT' then 'MATCHING' else 'STALE' end as status, case when old_id is not null and new_id is not null and old_id[2:]::bigint % 4 <> 1 then case when old_id[2:]::bigint % 2 = 0 then 'REJECT' else 'ACCEPT' end end as previous from v")
def review_packets(spark, sf_dir):
    """What a reviewer sees: three quarters of the old rows have decisions, the last of which counts."""
    k = F.col("p_partkey")
    events = table(spark, sf_dir, "part").where("p_partkey % 4 <> 1").select(name("o", k).alias("object"), F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("REVISE").alias("d")), F.struct(F.lit(2).alias("n"), F.when(k % 2 == 0, "REJECT").otherwise("ACCEPT").alias("d")))).alias("e")).select("object", "e.*")
    mapped = evaluate.version_map(*two_builds(spark, sf_dir), ["text", "source_hash"], ("text", "type"), ("status",))
    return evaluate.packet(mapped, events, "object", "n", "d").withColumn("previous", F.when(F.col("new_id").isNotNull(), F.col("previous")))


@query("""select 'n' || p_partkey as node_id, case when p_partkey % 5 in (2, 3) then 'new' else 'old' end || p_partkey as anchor_id from part""")
def rebuilt_evidence(spark, sf_dir):
    """A rebuild: untouched, kept, updated, added and refused nodes with their evidence after it."""
    part, k, m = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_partkey") % 5
    row = lambda which, text: part.where(which).select(name("n", k).alias("id"), F.lit(1).alias("version"), F.when(m == 4, "CLAIM").otherwise("PROCESS").alias("type"), text.alias("text"))
    stored, fresh = row("p_partkey % 5 <> 3", F.lit("t")), row("p_partkey % 5 <> 1", F.when(m.isin(2, 4), "u").otherwise("t"))
    actions = evaluate.rebuilt(stored, fresh.drop("version"), ["text"])
    old = part.where("p_partkey % 5 <> 3").select(name("n", k).alias("node_id"), name("old", k).alias("anchor_id"))
    return evaluate.rebuilt_evidence(actions, old, part.where("p_partkey % 5 <> 1").select(name("n", k).alias("node_id"), name("new", k).alias("anchor_id")))


@query("select l_orderkey, l_partkey, (1 + max((l_partkey % 5 = 2)::int))::int as version from lineitem group by 1, 2")
def rebuilt_edges(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().select("l_orderkey", "l_partkey", name("n", "l_partkey").alias("target_node_id"), F.lit(1).alias("version"))
    actions = table(spark, sf_dir, "part").select(name("n", "p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 2, "updated").otherwise("untouched").alias("action"))
    return evaluate.rebuilt_edges(actions, e).select("l_orderkey", "l_partkey", "version")


@query("select 'e' || s_suppkey as new_id, 'f' || s_suppkey as old_id from supplier where s_suppkey % 3 > 0")
def mapped_edges(spark, sf_dir):
    """Edges of the new build matched through the nodes' pairs; a third has another relation in the old one."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    pairs = s.select(F.explode(F.array(*(F.struct(name(f"n{e}", k).alias("new_id"), name(f"o{e}", k).alias("old_id"), F.lit("PAIRED").alias("state")) for e in "ab"))).alias("p")).select("p.*")
    edge = lambda i, v, rel: s.select(name(i, k).alias("id"), name(f"{v}a", k).alias("source_node_id"), name(f"{v}b", k).alias("target_node_id"), rel.alias("relation_type"))
    return evaluate.mapped_edges(edge("f", "o", F.when(k % 3 == 0, "CITES").otherwise("USES")), edge("e", "n", F.lit("USES")), pairs)
