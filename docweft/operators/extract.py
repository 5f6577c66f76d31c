"""Typed candidates from sentences and blocks, section state, process groups and the graph made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as tx
from ..schema import default_layer

# Cue patterns over the searchable sentence, in order: (type, pattern, not in captions, methods sections only).
CUES = (
    ("ASSUMPTION", r"\b(assum(?:e[sd]?|ing|ptions?))\b", False, False),
    ("DEFINITION", r"\b(is defined as|we define|where \w+ is .+ and \w+ is)\b", False, False),
    ("LIMITATION", r"\b(uncertainties|suffers from|major limitation|stability issues)\b", False, False),
    ("RESEARCH_PROBLEM", r"\b(but .+ suffer|development .+ requires|remains a critical challenge)\b", True, False),
    ("SIMULATION", r"\b(simulations? were (carried out|performed)|were modeled in|calculations were performed)\b", True, False),
    ("DEVICE", r"\b(our complete device integrates|the complete .+ integrates|our device .+ consists|device (structure|stack) .+ (consists|comprises)|capacitor .+ comprised)\b", True, False),
    ("RELATIONSHIP_ANALYSIS", r"\bwe (?:\w+ ){0,3}(?:extract(?:ed)?|explore[ds]?|investigat(?:e[ds]?|ing)|examin(?:e[ds]?|ing)|stud(?:y|ied))\b.+\b(as a function of|relationship|correlation|dependence)\b", True, False),
    ("METHOD", r"\b(we (propose|introduce|present|use|employed|fabricated)|we (then |further )?extract(?:ed)?|we address .+ by|here we .+ by|treatment was performed|structures were fully relaxed|the (proposed|key) (method|idea)|is a technique|our (method|approach))\b", True, False),
    ("RESULT", r"\b(we (show|find|demonstrate|observe)|results (show|demonstrate|reveal)|achieves?|outperforms?|reaches|\w+ exhibits? a (low|high)|\w+ show(?:s)? (a|an|current|no|negligible|excellent)|the average .+ was|no obvious degradation .+ observed|was calculated to be)\b", True, False),
    ("CLAIM", r"\b(we (argue|conclude|claim)|this (shows|suggests|demonstrates))\b", True, False),
    ("METHOD", r"\b(?:was|were) (?:\w+ ){0,3}(?:deposited|patterned|etched|fabricated|transferred|exfoliated|picked up|removed|cleaned|cladded|polished|assembled|grown|annealed|heated|cooled|immersed)\b|\b(?:after|following) (?:the )?(?:transfer|polishing|etching|deposition)\b|\b(?:lithography|etching|deposition|transfer|processing) (?:was|were) (?:used|performed)\b", True, True),
)
# What marks background sentences and own work, process steps, section purposes, activities, and the headings that open and close a Methods section.
BACKGROUND, OWN_WORK = r"^(although|while) .+ (is capable|can|has been)\b", r"\b(we|our|this work|this study)\b"
STEP = r"\b(?:deposited|patterned|etched|fabricated|transferred|exfoliated|picked up|removed|cleaned|cladded|polished|assembled|grown|annealed|immersed|oxidation|etching|lithography)\b"
MADE, MEASURED = r"\b(fabrication|preparation|synthesis|processing)\b", r"\b(characteri[sz]ation|measurements?|spectroscopy|microscopy|testing)\b"
ACTIVITY = r"\b(spectra|resistance|thickness|properties|response|measurements?|characteri[sz]ation|microscopy|mapping|spectroscopy|current.voltage|imaging)\b.*\b(was|were|is|are)\b.*\b(acquired|measured|characteri[sz]ed|verified|determined|performed|collected)\b"
METHODS_HEAD = r"^(?:\d+[. ]+)?(?:materials and |experimental )?methods$"
OTHER_HEAD = r"^(?:references|acknowledg|data availability|code availability|author contributions|results|discussion|conclusions)"
FABRICATION, CHARACTERIZATION = "fabrication/processing", "characterization and measurement-sample preparation"
SHORTEST, LONGEST, MOST_BLOCKS = 35, 1200, 20


def classify(clean: Column, caption: Column, methods: Column, cues=CUES) -> Column:
    """The type of the first cue that a sentence has; null without one, outside the length limits, and for background sentences.

    A background sentence that has a limitation cue gets no type: no later cue is tried.
    """
    background = clean.rlike(BACKGROUND) & ~clean.rlike(OWN_WORK)
    out = F.when(~F.length(clean).between(SHORTEST, LONGEST), F.lit(None).cast("string"))
    for kind, pattern, no_caption, only_methods in cues:
        hit = clean.rlike(pattern)
        if no_caption:
            hit = hit & ~caption
        if only_methods:
            hit = hit & methods
        out = out.when(hit, F.when(background, F.lit(None)).otherwise(kind) if kind == "LIMITATION" else F.lit(kind))
    return out


def candidates(blocks: DataFrame, doc: str = "doc_id", unicode: bool = True, cues=CUES) -> DataFrame:
    """Typed candidates of blocks(doc, page, ord, text, kind, section_titles, methods): (…, n, type, layer, text, epistemic_status).

    Captions give FIGURE and their sentences; table captions and numbered equations only themselves; headings a SECTION
    for each title; other blocks their inline titles as SECTION and their sentences. n numbers a block's candidates.
    """
    text, titles = F.col("text"), F.coalesce("section_titles", F.array().cast("array<string>"))
    # What is asked of a block several times is a column, found once.
    flat = F.col("_flat")
    blocks = blocks.withColumn("_flat", tx.compact(text))
    blocks = blocks.withColumns({
        "_caption": tx.figure_number(flat).isNotNull(), "_table": flat.rlike(r"(?i)^table\s+\d+\s*[:.\-]"),
        "_equation": (F.length(text) < 700) & text.rlike("[=∑∫≤≥]") & tx.equation_number(text).isNotNull(),
    })
    caption, table, equation = F.col("_caption"), F.col("_table"), F.col("_equation") & ~F.col("_caption")
    silent = F.col("kind").isin("header", "panel_label")
    is_heading = (F.col("kind") == "heading") & ~caption
    one = lambda t, x, pos: F.struct(F.lit(t).alias("type"), x.alias("text"), F.lit(pos).alias("pos"))
    none = F.array().cast("array<struct<type:string,text:string,pos:int>>")
    own_lines = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike(tx.TEMPLATE_HEADER))
    sections = F.transform(F.when(F.size(titles) > 0, titles).otherwise(own_lines), lambda x: one("SECTION", x, 1))
    inline = F.when(~caption, F.transform(titles, lambda x: one("SECTION", x, 1))).otherwise(none)
    body = F.when(~caption, F.aggregate(titles, text, lambda t, x: F.when(F.startswith(t, F.concat(x, F.lit("\n"))), F.substring(t, F.length(x) + 2, F.length(t))).otherwise(t))).otherwise(text)
    said = F.transform(tx.sentences(body), lambda x: one("", x, 2))
    parts = F.when(silent, none).when(table, F.array(one("TABLE", text, 0))).when(equation, F.array(one("EQUATION", text, 0))).when(is_heading, sections)
    parts = parts.otherwise(F.concat(F.when(caption, F.array(one("FIGURE", text, 0))).otherwise(none), inline, said))
    # The outer forms keep what a row costs single: a filter on what an inner explode gives, or on a type that a projection
    # finds, is moved before it, and splits, normalises and classifies each sentence again, for every use in the cascade.
    rows = blocks.select(doc, "page", "ord", "methods", caption.alias("caption"), F.posexplode_outer(parts).alias("n", "c"))
    rows = rows.withColumn("clean", F.when(F.col("c.type") == "", tx.searchable(F.col("c.text"), unicode)))
    kind = F.when(F.col("c.type") != "", F.col("c.type")).otherwise(classify(F.col("clean"), F.col("caption"), F.col("methods"), cues))
    rows = rows.select(doc, "page", "ord", "n", F.explode_outer(F.array(kind)).alias("type"), F.col("c.text").alias("text")).where("type is not null")
    explicit = F.col("type").isin("FIGURE", "TABLE", "EQUATION", "SECTION")
    return rows.withColumns({"layer": default_layer(F.col("type")), "epistemic_status": F.when(explicit, "PAPER_EXPLICIT").otherwise("AUTHOR_CLAIM")}).withColumn("layer", F.when(F.col("type") == "ASSUMPTION", "SEMANTIC").otherwise(F.col("layer")))


def section_state(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds methods (inside a Methods section) and purpose, both carried forward over (page, ord)."""
    w = W.partitionBy(doc).orderBy("page", "ord").rowsBetween(W.unboundedPreceding, 0)
    titles = F.when(F.size("section_titles") > 0, F.col("section_titles")).when(F.col("kind") == "heading", F.array("text"))
    flat = F.transform(titles, lambda x: F.lower(tx.compact(x)))
    flag = F.when(F.exists(flat, lambda x: x.rlike(METHODS_HEAD)), True).when(F.exists(flat, lambda x: x.rlike(OTHER_HEAD)), False)
    rows = blocks.withColumns({"_titled": titles.isNotNull(), "_flag": flag})
    rows = rows.withColumn("methods", F.coalesce(F.last("_flag", ignorenulls=True).over(w), F.lit(False)))
    label = F.col("methods") & (F.col("kind") == "paragraph") & F.length(F.trim("text")).between(5, 159) & ~F.col("text").rlike("[.!?;:=]") & ~F.col("_titled")
    purpose = F.when(F.col("_titled") | label, heading_purpose(tx.searchable(F.when(F.col("_titled"), F.array_join(titles, " ")).otherwise(F.col("text")), False)))
    rows = rows.withColumns({"_border": F.col("_titled") | label, "_purpose": purpose})
    return rows.withColumn("purpose", F.coalesce(F.last("_purpose", ignorenulls=True).over(w), F.lit(FABRICATION))).withColumnRenamed("_border", "border").drop("_titled", "_flag", "_purpose")


def heading_purpose(clean: Column) -> Column:
    return F.when(clean.rlike(MADE), FABRICATION).when(clean.rlike(MEASURED), CHARACTERIZATION).otherwise(FABRICATION)


def runs(rows: DataFrame, group: list[str], order: list[str], border: Column, most: int = MOST_BLOCKS) -> DataFrame:
    """Numbers runs: adds run (a new one at each border) and chunk (runs cut every `most` rows)."""
    w = W.partitionBy(*group).orderBy(*order)
    rows = rows.withColumn("run", F.sum(border.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    n = F.row_number().over(W.partitionBy(*group, "run").orderBy(*order)) - 1
    return rows.withColumn("chunk", F.floor(n / most).cast("int"))


def processes(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """PROCESS compilations of blocks with section_state(): literal excerpts of a Methods section by purpose.

    Order decides here (continued sentences, measurement context, full groups), so each document is walked once, by a
    small state machine over its paragraphs. Returns (doc, purpose, text, keys), keys being the (page, ord) pairs.
    """
    import re

    import pandas as pd

    step, activity, end, split = re.compile(STEP), re.compile(ACTIVITY), re.compile(r"[.!?]$"), re.compile(tx.SENTENCE_END)
    cues = [(k, re.compile(p)) for k, p, _, _ in CUES]

    clean = tx.searchable_text

    def is_method(c: str) -> bool:
        if not SHORTEST <= len(c) <= LONGEST:
            return False
        return next((k for k, p in cues if p.search(c)), None) == "METHOD"

    def walk(page: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        open_: dict[str, list] = {FABRICATION: [], CHARACTERIZATION: []}

        def close(*purposes: str) -> None:
            for p in purposes:
                if sum(len(x) for _, x in open_[p]) >= (2 if p == FABRICATION else 1):
                    found.append((page[doc].iloc[0], p, "\n".join(t for _, x in open_[p] for t in x), [k for k, _ in open_[p]]))
                open_[p] = []

        def put(p: str, key: str, texts: list[str]) -> None:
            if texts:
                if len(open_[p]) == MOST_BLOCKS:
                    close(p)
                open_[p].append((key, texts))

        for r in page.sort_values(["page", "ord"]).itertuples():
            if r.border:
                close(*open_)
            if r.kind != "paragraph" or not r.methods:
                continue
            said = split.split(r.text)
            picked = [s for s in said if is_method(clean(s)) and step.search(clean(s))]
            group = open_[FABRICATION]
            if group and not r.border and not end.search(group[-1][1][-1].rstrip()):
                rest = re.split(tx.SENTENCE_END_PLAIN, r.text)[0]
                picked = picked if rest in picked else [rest, *picked]
            about_measuring = bool(activity.search(clean(said[0])))
            if about_measuring:
                close(*open_)
            made, measured, context = [], [], False
            for s in said:
                long = len(clean(s)) >= SHORTEST
                if about_measuring or r.purpose != FABRICATION:
                    measured += [s] * long
                elif s in picked:
                    made.append(s)
                    context = False
                elif activity.search(clean(s)) or context and long:
                    measured.append(s)
                    context = True
            if r.purpose == FABRICATION:
                made = [s for s in picked if s not in said] + made
            put(FABRICATION, f"{r.page}:{r.ord}", made)
            put(CHARACTERIZATION, f"{r.page}:{r.ord}", measured)
        close(*open_)
        return pd.DataFrame(found, columns=[doc, "purpose", "text", "keys"])

    kind = blocks.schema[doc].dataType.simpleString()
    return blocks.select(doc, "page", "ord", "kind", "text", "methods", "purpose", "border").groupBy(doc).applyInPandas(walk, f"{doc} {kind}, purpose string, text string, keys array<string>")


def materialise(found: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, evidence, edges) of candidates: confidence 0.6, one evidence row an anchor, one CONTAINS edge from the document."""
    d, span = F.col(doc), [F.col("page"), F.col("ord")]
    anchor = ids.row_id(d, "anchor", *span)
    node = ids.row_id(d, "node", *span, F.col("n"))
    nodes = found.select(node.alias("id"), d.alias("paper_id"), "type", "layer", tx.shortened(tx.compact(F.col("text"))).alias("label"), "text", "epistemic_status", F.lit("CANDIDATE").alias("verification_status"), F.lit(0.6).alias("confidence"), F.array(anchor).alias("provenance"), F.lit(1).alias("version"))
    evidence = nodes.select("paper_id", F.col("id").alias("node_id"), F.explode("provenance").alias("anchor_id")).select(ids.row_id(F.col("paper_id"), "evidence", F.col("node_id"), F.col("anchor_id")).alias("id"), F.col("node_id").alias("supports_object_id"), "anchor_id")
    edges = nodes.select(ids.row_id(F.col("paper_id"), "edge", F.col("id")).alias("id"), "paper_id", F.col("paper_id").cast("string").alias("source_node_id"), F.col("id").alias("target_node_id"), F.lit("CONTAINS").alias("relation_type"), F.lit("PAPER_EXPLICIT").alias("epistemic_status"), F.lit("SUPPORTED").alias("verification_status"), F.lit(1.0).alias("confidence"), "provenance", F.lit(1).alias("version"))
    return nodes, evidence, edges


def paper_status(warnings: DataFrame, papers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """READY, or PARTIAL where a document has warnings."""
    n = warnings.groupBy(doc).agg(F.count("*").alias("warnings"))
    return papers.select(doc).join(n, doc, "left").select(doc, F.coalesce("warnings", F.lit(0)).alias("warnings")).withColumn("status", F.when(F.col("warnings") > 0, "PARTIAL").otherwise("READY"))
