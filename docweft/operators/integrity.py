"""Checks of anchors, nodes, edges, evidence and reviews; each gives rows (code, object_id, detail, severity)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import CLAIM_TYPES, EPISTEMIC, INACTIVE, RELATIONS, REVIEWED, layers
from ..session import written
from .graph import cyclic, prerequisites

# What a relation may point at or come from.
TARGETS = {"ASSUMES": ("ASSUMPTION", "APPROXIMATION"), "EVIDENCE_FOR": CLAIM_TYPES}
SOURCES = {"CONTAINS": ("PAPER", "SECTION")}
SUBTYPES = {"claims": CLAIM_TYPES, "equations": ("EQUATION",), "figures": ("FIGURE",)}
#: The fields of nodes and edges that a review's fingerprint covers; those that an object lacks are left out.
PRINTED = ["type", "layer", "text", "relation_type", "source_node_id", "target_node_id"]
ISSUE = "code string, object_id string, detail string, severity string"


def issues(df: DataFrame, code: str, object_id: Column, detail: Column | str, warning: bool = False) -> DataFrame:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(code).alias("code"), object_id.cast("string").alias("object_id"), detail.alias("detail"), F.lit("WARNING" if warning else "ERROR").alias("severity"))


def first_fault(*checks: tuple[Column, str]) -> Column:
    """The detail of the first check that does not hold (false or unknown); null if all hold."""
    out = F.when(~F.coalesce(checks[0][0], F.lit(False)), checks[0][1])
    for holds, detail in checks[1:]:
        out = out.when(~F.coalesce(holds, F.lit(False)), detail)
    return out


def notation_fault(text: Column, box: Column, notes: Column, titles: Column) -> Column:
    """Do notes lie in order, apart, on their own text and inside the span's box, and titles in the text?"""
    inside = F.forall(notes, lambda n: (n["start_char"] >= 0) & (n["start_char"] < n["end_char"]) & (n["end_char"] <= F.length(text)) & (F.substring(text, n["start_char"] + 1, n["end_char"] - n["start_char"]) == n["raw"]))
    order = F.aggregate(notes, F.struct(F.lit(0).alias("end"), F.lit(True).alias("ok")), lambda a, n: F.struct(n["end_char"].alias("end"), (a["ok"] & (n["start_char"] >= a["end"])).alias("ok")), lambda a: a["ok"])
    boxes = F.forall(notes, lambda n: (box["x0"] <= n["bbox"]["x0"]) & (n["bbox"]["x0"] < n["bbox"]["x1"]) & (n["bbox"]["x1"] <= box["x1"] + 0.01) & (box["y0"] <= n["bbox"]["y0"]) & (n["bbox"]["y0"] < n["bbox"]["y1"]) & (n["bbox"]["y1"] <= box["y1"] + 0.01))
    named = F.forall(titles, lambda t: (F.trim(t) != "") & F.contains(text, t))
    return first_fault((inside & order & boxes, "Notation does not match its span"), (named, "A section title is not part of its block"))


def anchor_faults(anchors: DataFrame, spans: DataFrame, pages: DataFrame, papers: DataFrame) -> DataFrame:
    """(id, fault) of every anchor: ownership, hash, page, range, text, box and notation; null fault if all is well."""
    s = spans.select(F.col("id").alias("span_id"), F.struct("paper_id", "page_id", "page_number", "text", "bbox", "notation", "section_titles").alias("s"))
    p = pages.select(F.col("id").alias("_page"), F.struct("paper_id", "number", "width", "height", "rotation").alias("p"))
    d = papers.select(F.col("id").alias("paper_id"), F.struct("source_hash", "page_count").alias("d"))
    rows = anchors.join(d, "paper_id", "left").join(s, "span_id", "left")
    rows = rows.join(p, F.col("s.page_id") == F.col("_page"), "left")
    turned = F.col("p.rotation").isin(90, 270)
    width, height = F.when(turned, F.col("p.height")).otherwise(F.col("p.width")), F.when(turned, F.col("p.width")).otherwise(F.col("p.height"))
    box, good = F.col("bbox"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    fault = first_fault(
        (F.col("d").isNotNull(), "Evidence must refer to this paper"),
        (F.col("source_hash") == F.col("d.source_hash"), "Evidence source hash is stale"),
        ((F.col("s.paper_id") == F.col("paper_id")) & (F.col("s.page_number") == F.col("page_number")), "Evidence span ownership is invalid"),
        ((F.col("p.paper_id") == F.col("paper_id")) & (F.col("p.number") == F.col("page_number")), "Evidence page ownership is invalid"),
        (F.col("page_number").between(F.lit(1), F.col("d.page_count")), "Evidence page is outside the parsed document"),
        ((F.col("start_char") >= 0) & (F.col("start_char") < F.col("end_char")) & (F.col("end_char") <= F.length("s.text")) & (F.substring(F.col("s.text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("text")), "Evidence text does not match its source range"),
        (F.col("bbox") == F.col("s.bbox"), "Evidence coordinates do not match the source block"),
        (notation_fault(F.col("s.text"), F.col("s.bbox"), F.col("s.notation"), F.col("s.section_titles")).isNull(), "Source notation does not match its span"),
        (F.col("p.rotation").isin(0, 90, 180, 270) & good(width) & good(height) & good(box["x0"]) & good(box["x1"]) & (box["x0"] >= 0) & (box["x0"] < box["x1"]) & (box["x1"] <= width + 0.01) & (box["y0"] >= 0) & (box["y0"] < box["y1"]) & (box["y1"] <= height + 0.01), "Evidence bounding box is invalid or outside its page"),
    )
    return rows.select("id", "paper_id", fault.alias("fault"))


def edge_faults(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, fault) of every edge: ends exist in its paper, no loop, known relation, fitting types."""
    n = nodes.select("id", "paper_id", "type")
    s, t = (n.select(F.col("id").alias(f"{end}_node_id"), F.col("paper_id").alias(f"_{end}_paper"), F.col("type").alias(f"_{end}_type")) for end in ("source", "target"))
    # Merged: a table's size is guessed from its files, and what was exploded from a small one would be broadcast whole.
    # What the source shows is told in booleans before the rows are dealt out by target: they carry no name that is done with.
    relation = F.col("relation_type")
    fits = lambda end, r, kinds: (relation != r) | F.col(f"_{end}_type").isin(*kinds)
    told = {"_own": F.col("_source_paper") == F.col("paper_id"), "_apart": F.col("source_node_id") != F.col("target_node_id")} | {f"_from_{r}": fits("source", r, kinds) for r, kinds in SOURCES.items()}
    rows = edges.join(s.hint("merge"), "source_node_id", "left").select("id", "paper_id", "target_node_id", relation, *(x.alias(k) for k, x in told.items()))
    rows = rows.join(t.hint("merge"), "target_node_id", "left")
    checks = [
        (F.col("_own") & (F.col("_target_paper") == F.col("paper_id")), "Invalid or foreign-paper edge endpoints"),
        (relation.isin(*RELATIONS), "Unknown relation"),
        (F.col("_apart"), "Self relations are not permitted"),
        *((fits("target", r, kinds), f"{r} must target {' or '.join(kinds)}") for r, kinds in TARGETS.items()),
        *((F.col(f"_from_{r}"), f"{r} must come from {' or '.join(kinds)}") for r, kinds in SOURCES.items()),
    ]
    return rows.select("id", first_fault(*checks).alias("fault"))


def illegal_layers(nodes: DataFrame) -> DataFrame:
    return nodes.join(F.broadcast(layers(nodes.sparkSession)), ["type", "layer"], "left_anti")


def repeats(nodes: DataFrame, order: str = "id") -> DataFrame:
    """(id, previous): nodes with the type and normalised text of one before them in order.

    Nodes are dealt out by ranges of (type, text, order), so that a large group spreads over many; each range's part of a
    group takes the last node of the part before.
    """
    norm = F.lower(F.trim(F.regexp_replace("text", r"[\t\n\x0B\f\r ]+", " ")))
    rows = nodes.select("id", F.col("type").alias("_type"), norm.alias("_norm"), F.col(order).alias("_order"))
    rows = written(rows.repartitionByRange("_type", "_norm", "_order").withColumn("_range", F.spark_partition_id()), "ranges")
    w = W.partitionBy("_range", "_type", "_norm").orderBy("_order")
    rows = rows.withColumns({"_at": F.row_number().over(w), "previous": F.lag("id").over(w)})
    last = rows.groupBy("_range", "_type", "_norm").agg(F.max_by("id", "_at").alias("_last"))
    last = last.withColumn("_last", F.lag("_last").over(W.partitionBy("_type", "_norm").orderBy("_range"))).where("_last is not null")
    last = last.select(F.col("_range").alias("_r"), F.col("_type").alias("_t"), F.col("_norm").alias("_n"), "_last")
    same = (F.col("_range") == F.col("_r")) & F.col("_type").eqNullSafe(F.col("_t")) & F.col("_norm").eqNullSafe(F.col("_n")) & (F.col("_at") == 1)
    return rows.join(last, same, "left").select("id", F.coalesce("previous", "_last").alias("previous")).where("previous is not null")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes other than PAPER in no edge."""
    ends = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("id")).distinct()
    return nodes.where("type <> 'PAPER'").join(ends, "id", "left_anti")


def unanchored(spans: DataFrame, anchors: DataFrame) -> DataFrame:
    return spans.join(anchors.select(F.col("span_id").alias("id")).distinct(), "id", "left_anti")


def fingerprints(objects: DataFrame, anchors: DataFrame, fields: list[str]) -> DataFrame:
    """(id, fingerprint): SHA-256 over an object's fields and its anchors in provenance order; missing optional parts are left out."""
    rows = objects.select("id", F.struct(*fields).alias("o"), F.posexplode_outer("provenance").alias("pos", "anchor_id"))
    have = [c for c in ("page_number", "start_char", "end_char", "bbox", "text", "source_hash", "notation") if c in anchors.columns]
    rows = rows.join(anchors.select(F.col("id").alias("anchor_id"), F.struct(*have).alias("a")), "anchor_id", "left")
    per = rows.groupBy("id").agg(F.first("o").alias("o"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "anchor_id", "a")))).alias("anchors"))
    return per.select("id", F.sha2(tx.canonical_json(F.col("o"), F.when(F.size("anchors") > 0, F.col("anchors")).alias("anchors")), 256).alias("fingerprint"))


def reviews_current(objects: DataFrame, reviews: DataFrame, prints: DataFrame, scientific: bool = False) -> DataFrame:
    """(id, current) of objects with a reviewed status: exactly one audit of the version before, and it fits in every field."""
    a = reviews.withColumn("_n", F.count("*").over(W.partitionBy("object_id", "object_kind", "object_version"))).select(
        F.col("object_id").alias("id"), (F.col("object_version") + 1).alias("version"), F.col("object_kind").alias("kind"), F.struct("paper_id", "source_hash", "decision", "scope", "reviewer", "reason", "scientific_basis", "evidence_fingerprint", "_n").alias("a")
    )
    rows = objects.where(F.col("verification_status").isin(*REVIEWED)).join(a, ["id", "version", "kind"], "left").join(prints, "id", "left")
    fits = (
        (F.col("a._n") == 1) & (F.col("a.paper_id") == F.col("paper_id")) & (F.col("a.source_hash") == F.col("source_hash")) & (F.col("a.decision") == F.col("verification_status"))
        & F.col("a.scope").eqNullSafe(F.col("verification_scope")) & (F.trim("a.reviewer") != "") & (F.length(F.trim("a.reason")) >= 10) & (F.col("a.evidence_fingerprint") == F.col("fingerprint"))
    )
    if scientific:
        fits = fits & (F.col("a.scope") == "SCIENTIFIC_VALIDITY") & (F.trim("a.scientific_basis") != "")
    return rows.groupBy("id").agg(F.max(F.coalesce(fits, F.lit(False)).cast("int")).cast("boolean").alias("current"))


def literal_nodes(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id) of nodes of a literal status whose text stands in one of their anchors."""
    cited = nodes.where(F.col("epistemic_status").isin("PAPER_EXPLICIT", "AUTHOR_CLAIM")).select("id", "text", F.explode("provenance").alias("anchor_id"))
    known = cited.join(anchors.select(F.col("id").alias("anchor_id"), F.col("text").alias("_text")), "anchor_id")
    return known.where(F.contains("_text", F.col("text"))).select("id").distinct()


def review_outcomes(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """Review requests, each accepted or refused with a reason: stale hash or version, no evidence, or a scope that does not fit the kind."""
    o = objects.select(F.col("id").alias("object_id"), F.struct("version", "source_hash", "provenance", "kind", "type", "epistemic_status").alias("o"))
    rows = requests.join(o, "object_id", "left")
    attribution = (F.col("decision") == "VERIFIED") & (F.col("scope") == "SOURCE_ATTRIBUTION")
    fault = first_fault(
        (F.col("o").isNotNull(), "Object not found"),
        ((F.col("source_hash") == F.col("o.source_hash")) & (F.col("expected_version") == F.col("o.version")), "Stale source hash or object version"),
        (F.size("o.provenance") > 0, "Verification needs evidence"),
        (~((F.col("o.kind") == "node") & (F.col("o.type") == "PAPER")), "Paper identity is not a claim"),
        (~attribution | ((F.col("o.kind") == "node") & F.col("o.epistemic_status").isin("PAPER_EXPLICIT", "AUTHOR_CLAIM")), "Source review verifies literal attribution only"),
    )
    return rows.withColumn("fault", fault).withColumn("new_version", F.when(F.col("fault").isNull(), F.col("o.version") + 1)).drop("o")


def report(papers: DataFrame, pages: DataFrame, spans: DataFrame, anchors: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, subtypes: dict[str, DataFrame] | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """All issues of the tables as one DataFrame. What several checks read, the anchors' faults and what each node's anchors say, is found and written once; so are the edges' faults."""
    faults = written(anchor_faults(anchors, spans, pages, papers).where("fault is not null").select("id", "fault"), "faults")
    bad = faults.select(F.col("id").alias("anchor_id"))
    cited = nodes.select("id", "type", "text", "epistemic_status", F.explode("provenance").alias("anchor_id"))
    known = cited.join(anchors.select(F.col("id").alias("anchor_id"), F.col("text").alias("anchor_text")), "anchor_id", "left").join(bad.withColumn("bad", F.lit(1)), "anchor_id", "left")
    quoted = known.groupBy("id", "type", "epistemic_status").agg(F.max(F.contains("anchor_text", F.col("text")).cast("int")).alias("quoted"), F.max(F.col("anchor_text").isNull().cast("int")).alias("missing"), F.max("bad").alias("bad"))
    quoted = written(quoted.where("missing = 1 or bad = 1 or coalesce(quoted, 0) = 0"), "quoted")
    unquoted = quoted.where("type <> 'PAPER' and epistemic_status in ('PAPER_EXPLICIT', 'AUTHOR_CLAIM') and coalesce(quoted, 0) = 0 and missing = 0")
    on_bad = quoted.where("bad = 1")
    loose = edges.select("id", F.explode("provenance").alias("anchor_id")).join(bad, "anchor_id", "left_semi")
    # Written, so that what the edges' two joins shuffle is deleted before the other checks shuffle.
    wrong = written(edge_faults(edges, nodes).where("fault is not null"), "edge_faults")
    owner = evidence.join(nodes.select(F.col("id").alias("supports_object_id"), "provenance"), "supports_object_id").where(~F.array_contains("provenance", F.col("anchor_id")))
    marked = [df.select("id", "verification_status", "verification_scope") for df in (nodes, edges)]
    scoped = marked[0].unionByName(marked[1]).where(~F.col("verification_status").isin(*REVIEWED) & F.col("verification_scope").isNotNull())
    out = [
        issues(illegal_layers(nodes), "INVALID_NODE", F.col("id"), "Type and layer do not go together"),
        issues(nodes.where(~F.col("epistemic_status").isin(*EPISTEMIC)), "INVALID_NODE", F.col("id"), "Unknown epistemic status"),
        issues(nodes.where((F.col("type") != "PAPER") & (F.size("provenance") == 0)), "INVALID_NODE", F.col("id"), "No source provenance"),
        issues(on_bad, "INVALID_NODE", F.col("id"), "Cites an invalid anchor"),
        issues(quoted.where("missing = 1"), "INVALID_NODE", F.col("id"), "Cites a missing anchor"),
        issues(unquoted, "INVALID_NODE", F.col("id"), "Attributed text does not match its source"),
        issues(orphans(nodes, edges), "ORPHAN_NODE", F.col("id"), "In no relationship", True),
        issues(repeats(nodes), "DUPLICATE_CANDIDATE", F.col("id"), F.concat(F.lit("Same type and text as "), F.col("previous")), True),
        issues(wrong, "INVALID_EDGE", F.col("id"), F.col("fault")),
        issues(edges.where(F.size("provenance") == 0), "INVALID_EDGE", F.col("id"), "No evidence anchors"),
        issues(loose, "INVALID_EDGE", F.col("id"), "Cites an invalid anchor"),
        issues(scoped, "CONFLICTING_VERIFICATION", F.col("id"), "An unreviewed status carries a review scope"),
        issues(faults, "INVALID_ANCHOR", F.col("id"), F.col("fault")),
        issues(owner, "INVALID_EVIDENCE", F.col("id"), "Evidence conflicts with the node's provenance"),
        issues(unanchored(spans, anchors), "UNANCHORED_SOURCE_SPAN", F.col("id"), "Span without an anchor"),
        issues(cyclic(prerequisites(edges)), "PREREQUISITE_CYCLE", F.col("id"), "Prerequisites form a cycle"),
    ]
    for name, table in (subtypes or {}).items():
        typed = table.join(nodes.select(F.col("id").alias("node_id"), "type"), "node_id", "left")
        out.append(issues(typed.where(F.col("type").isNull() | ~F.col("type").isin(*SUBTYPES[name])), "INVALID_SUBTYPE", F.col("node_id"), "Subtype does not fit its node"))
        lacking = nodes.where(F.col("type").isin(*SUBTYPES[name])).join(table.select(F.col("node_id").alias("id")), "id", "left_anti")
        out.append(issues(lacking, "INVALID_NODE", F.col("id"), "Its subtype row is missing"))
    if reviews is not None:
        versions = nodes.select("id", "version", F.lit("node").alias("kind")).unionByName(edges.select("id", "version", F.lit("edge").alias("kind")))
        objects = [df.select("id", "paper_id", "version", "verification_status", "verification_scope", "provenance", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in PRINTED], F.lit(kind).alias("kind")) for df, kind in ((nodes, "node"), (edges, "edge"))]
        both = objects[0].unionByName(objects[1]).join(papers.select(F.col("id").alias("paper_id"), "source_hash"), "paper_id", "left")
        reviewed = both.where(F.col("verification_status").isin(*REVIEWED))
        current = reviews_current(reviewed, reviews, fingerprints(reviewed, anchors, PRINTED))
        out.append(issues(current.where("not current"), "CONFLICTING_VERIFICATION", F.col("id"), "Its reviewed status has no current review"))
        r = reviews.join(versions.select(F.col("id").alias("object_id"), F.col("version").alias("_v"), F.col("kind").alias("object_kind")), ["object_id", "object_kind"], "left")
        out.append(issues(r.where(F.col("_v").isNull() | (F.col("object_version") >= F.col("_v"))), "INVALID_REVIEW_REFERENCE", F.col("id"), "Review of an unknown object or version"))
    return reduce(DataFrame.unionByName, out).distinct()


def structurally_valid(found: DataFrame) -> DataFrame:
    """One row: whether no issue is an error."""
    return found.agg(F.coalesce(F.bool_and(F.col("severity") != "ERROR"), F.lit(True)).alias("structurally_valid"))


def validated_nodes(requests: DataFrame, nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Node requests with reason: null if accepted, else the first rule they break."""
    legal = layers(requests.sparkSession).withColumn("_legal", F.lit(True))
    first = anchors.select(F.col("id").alias("_anchor"), F.col("paper_id").alias("_anchor_paper"), F.col("text").alias("_anchor_text"))
    rows = requests.join(F.broadcast(legal), ["type", "layer"], "left").join(first, F.get("provenance", F.lit(0)) == F.col("_anchor"), "left")
    rows = rows.join(nodes.select("id", F.lit(True).alias("_taken")), "id", "left")
    reason = first_fault(
        (F.col("_taken").isNull(), "Id is taken"), (F.col("type") != "PAPER", "A document's root is not a candidate"), (F.col("_legal"), "Type and layer do not go together"),
        (F.size("provenance") > 0, "No source provenance"), (F.col("_anchor_paper") == F.col("paper_id"), "Evidence must refer to this paper"),
        (F.col("confidence").between(0, 1), "Confidence must lie between 0 and 1"),
        (~F.col("epistemic_status").isin("PAPER_EXPLICIT", "AUTHOR_CLAIM") | F.contains("_anchor_text", F.col("text")), "Attributed text does not match its source"),
    )
    return rows.select(*requests.columns, reason.alias("reason"))


def validated_edges(requests: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge requests with reason; those that close a prerequisite cycle with the stored edges or one another are refused too."""
    faults = edge_faults(requests, nodes)
    all_edges = edges.select("id", "source_node_id", "target_node_id", "relation_type", "verification_status").unionByName(requests.select("id", "source_node_id", "target_node_id", "relation_type", F.lit("CANDIDATE").alias("verification_status")))
    loops = cyclic(prerequisites(all_edges)).select("id", F.lit("Prerequisites would form a cycle").alias("_loop")).distinct()
    rows = requests.join(faults.hint("merge"), "id").join(loops.hint("merge"), "id", "left")
    return rows.select(*requests.columns, F.coalesce("fault", "_loop").alias("reason"))


def path_edges(edges: DataFrame, nodes: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Edges that a path may use: active, valid, with evidence, not on a prerequisite cycle; with current(id, current) only reviewed ones between reviewed nodes."""
    good = edges.where(~F.col("verification_status").isin(*INACTIVE) & (F.size("provenance") > 0)).join(edge_faults(edges, nodes).where("fault is null").select("id").hint("merge"), "id", "left_semi")
    good = good.join(cyclic(prerequisites(edges)).select("id").distinct().hint("merge"), "id", "left_anti")
    if current is not None:
        sure = current.where("current").select("id").hint("merge")
        verified = nodes.where("verification_status = 'VERIFIED'").join(sure, "id", "left_semi").select("id").hint("merge")
        good = good.where("verification_status = 'VERIFIED'").join(sure, "id", "left_semi")
        for end in ("source_node_id", "target_node_id"):
            good = good.join(verified.withColumnRenamed("id", end).hint("merge"), end, "left_semi")
    return good


def created_subtypes(nodes: DataFrame, present: DataFrame) -> DataFrame:
    """(node_id, subtype, number, claim_type) for nodes without a subtype row, from what their text and type show: claims, and figures and equations with their numbers."""
    subtype = F.lit(None).cast("string")
    for name, kinds in SUBTYPES.items():
        subtype = F.when(F.col("type").isin(*kinds), name).otherwise(subtype)
    rows = nodes.withColumn("subtype", subtype).where("subtype is not null").join(present.select(F.col("node_id").alias("id")), "id", "left_anti")
    number = F.when(F.col("subtype") == "figures", tx.figure_number(F.col("text"))).when(F.col("subtype") == "equations", tx.equation_number(F.col("text")))
    return rows.select(F.col("id").alias("node_id"), "subtype", number.alias("number"), F.when(F.col("subtype") == "claims", F.col("type")).alias("claim_type"))


#: Names of JSON types by the first word of a variant's schema.
_JSON = {"string": "STRING", "integer": "BIGINT", "number": "DOUBLE", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def contract_faults(rows: DataFrame, key: str, json: str, fields: dict[str, dict]) -> DataFrame:
    """(key, field, fault) of JSON records against a contract: fields by name with type, required, enum, items (type), min and max.

    min and max bound numbers, the length of strings and the size of arrays. A record that is no JSON object is one fault
    of field `*`; of a field the first fault counts: missing, type, enum, items, range. Whole numbers are numbers too.
    """
    rows = rows.withColumn("_v", F.try_parse_json(F.col(json)))
    rows = rows.withColumn("_object", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    checks = []
    for name, rule in fields.items():
        value = F.try_variant_get("_v", f"$.{name}", "variant")
        text, number = F.try_variant_get("_v", f"$.{name}", "string"), F.try_variant_get("_v", f"$.{name}", "double")
        kind = F.schema_of_variant(value)
        is_a = lambda have, want: have.startswith(_JSON[want]) | (F.lit(want == "number") & (have.startswith("BIGINT") | have.startswith("DECIMAL")))
        there = value.isNotNull() & (kind != "VOID")
        fault = F.when(~there, "missing" if rule.get("required") else None)
        if "type" in rule:
            fault = fault.when(there & ~is_a(kind, rule["type"]), "type")
        if "enum" in rule:
            fault = fault.when(there & ~text.isin(*rule["enum"]), "enum")
        if "items" in rule:
            each = F.try_variant_get("_v", f"$.{name}", "array<variant>")
            fault = fault.when(there & F.exists(each, lambda x: ~is_a(F.schema_of_variant(x), rule["items"])), "items")  # noqa: B023
        size = number if rule.get("type") in ("integer", "number") else F.length(text) if rule.get("type") == "string" else F.size(F.try_variant_get("_v", f"$.{name}", "array<variant>"))
        for bound, outside in (("min", lambda x, b: x < b), ("max", lambda x, b: x > b)):
            if bound in rule:
                fault = fault.when(there & outside(size, rule[bound]), "range")
        checks.append(F.struct(F.lit(name).alias("field"), fault.alias("fault")))
    whole = F.array(F.struct(F.lit("*").alias("field"), F.lit("no object").alias("fault")))
    found = F.when(F.col("_object"), F.filter(F.array(*checks), lambda c: c["fault"].isNotNull())).otherwise(whole)
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.*")


def reference_faults(rows: DataFrame, key: str, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, field, value): references that name nothing, for columns of single names or lists of them; references: column -> (table, its column). One anti-join a column."""
    out = []
    for field, (targets, target) in references.items():
        listed = rows.schema[field].dataType.typeName() == "array"
        each = rows.select(key, F.explode(field).alias("value")) if listed else rows.select(key, F.col(field).alias("value"))
        each = each.where("value is not null").withColumn("field", F.lit(field))
        known = targets.select(F.col(target).alias("value")).distinct()
        out.append(each.join(known, "value", "left_anti").select(key, "field", F.col("value").cast("string").alias("value")))
    return reduce(DataFrame.unionByName, out)
