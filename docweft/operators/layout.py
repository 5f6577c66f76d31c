"""Text blocks: generation, reading order, kinds, running lines, fragments and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import written

LINES_A_PAGE = 20


def blocks_of_text(df: DataFrame, doc: str = "doc_id", text: str = "text", page_lines: int = LINES_A_PAGE) -> DataFrame:
    """One block a line: (doc, page, ord, text); a page has `page_lines` lines."""
    out = df.select(doc, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("ord", "text"))
    return out.select(doc, (F.floor(F.col("ord") / page_lines) + 1).cast("int").alias("page"), "ord", "text")


def outline(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages in order, each with its blocks in order, nested."""
    pages = blocks.groupBy(doc, "page").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("blocks"))
    return pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "blocks"))).alias("pages"))


def html_blocks(df: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """Blocks of an HTML page: headings, paragraphs, list items; those inside nav, header and footer are of kind header."""
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?is)<(nav|header|footer)\b[^>]*>(.*?)</\1\s*>", "<x-margin>$2</x-margin>")
    parts = F.regexp_extract_all(body, F.lit(r"(?is)(<x-margin>.*?</x-margin>|<(?:h[1-6]|p|li)\b[^>]*>.*?(?=<(?:h[1-6]|p|li|x-margin)\b|</(?:h[1-6]|p|li|body|article|ul)\b|\z))"), F.lit(1))
    rows = df.select(doc, F.posexplode(parts).alias("ord", "raw"))
    kind = F.when(F.col("raw").startswith("<x-margin"), "header").when(F.lower("raw").rlike("^<h[1-6]"), "heading").otherwise("paragraph")
    return rows.select(doc, "ord", kind.alias("kind"), tx.compact(F.regexp_replace("raw", r"(?s)<[^>]*>", " ")).alias("text")).where("text <> ''")


def modal_size(rows: DataFrame, group: list[str], size: str, weight: Column) -> DataFrame:
    """Per group the size with the largest summed weight; the smaller size on a tie."""
    sums = rows.groupBy(*group, size).agg(F.sum(weight).alias("weight"))
    return sums.groupBy(*group).agg(F.max_by(F.col(size), F.struct("weight", -F.col(size))).alias(size), F.max("weight").alias("weight"))


def heading(text: Column, font: Column, bold: Column, titles: Column, y0: Column, page_height: Column, body: Column) -> Column:
    """Short, not at the page's foot, and large, or a section label, or bold at body size."""
    label = F.exists(titles, lambda t: tx.compact(t).rlike(tx.BODY_SECTION))
    return F.length(text).between(5, 179) & (y0 < page_height * 0.94) & ((font >= 14) | label | (bold & (font >= body - 0.5)))


def section_titles(lines: Column, body: Column) -> Column:
    """Of lines (text, bold, size): section labels, and bold short lines at body size that do not end like a sentence."""
    def title(x: Column) -> Column:
        label = tx.compact(x["text"])
        bold = x["bold"] & F.length(label).between(5, 139) & ~label.rlike(r"[.!?:]$") & (x["size"] >= body - 0.5)
        return (label.rlike(tx.BODY_SECTION) | bold) & ~label.rlike(tx.TEMPLATE_HEADER)

    return F.transform(F.filter(lines, title), lambda x: x["text"])


# Fixed value: clusters of one-letter and number labels.
PANEL = r"^(?:[a-z]|\d+(?:\.\d+)?)\s*(?:(?:[a-z]|\d+(?:\.\d+)?)\s*){0,8}$"


def kind(text: Column, is_heading: Column, y0: Column, page_height: Column) -> Column:
    """header for template words near the top, panel_label for label clusters, else heading or paragraph."""
    top = (y0 < page_height * 0.12) & tx.compact(text).rlike(tx.TEMPLATE_HEADER)
    panel = F.trim(text).rlike(PANEL) & text.rlike(r"\b[a-z]\b")
    return F.when(top, "header").when(panel, "panel_label").when(is_heading, "heading").otherwise("paragraph")


def column_order(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Reads pages without figure captions and with long blocks on both sides by column; blocks at the top stay first.

    blocks: doc, page, ord, text, x0, y0, x1, width, height. Adds the new ord.
    """
    page = W.partitionBy(doc, "page")
    long = F.length("text") > 250
    left, right = long & (F.col("x1") < F.col("width") * 0.55), long & (F.col("x0") > F.col("width") * 0.45)
    two = ~F.max(tx.figure_number(F.col("text")).isNotNull()).over(page) & F.max(left).over(page) & F.max(right).over(page)
    top = F.col("y0") < F.col("height") * 0.1
    keys = [F.when(two, (~top).cast("int")), F.when(two & ~top, (F.col("x0") > F.col("width") * 0.45).cast("int")), F.when(two & ~top, F.col("y0")), F.col("ord")]
    rows = blocks.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    return rows.withColumn("ord", F.row_number().over(page.orderBy(*(F.asc_nulls_first(f"_k{i}") for i in range(4)))) - 1).drop("_k0", "_k1", "_k2", "_k3")


def running_lines(blocks: DataFrame, doc: str = "doc_id", most: int = 180, least: int = 2) -> DataFrame:
    """Normalised short texts that stand on several pages or documents: (norm, n); each page counts once."""
    norm = F.lower(F.trim(F.regexp_replace("text", r"[\t\n\x0B\f\r ]+", " ")))
    rows = blocks.where(F.length("text") < most).select(doc, norm.alias("norm")).where("norm <> ''").distinct()
    return rows.groupBy("norm").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def mark_running(blocks: DataFrame, margin: Column, group: str = "doc_id") -> DataFrame:
    """Blocks in the margin whose text runs over two pages or more of their document become headers without titles."""
    norm = F.lower(tx.compact(F.col("text")))
    rows = blocks.withColumns({"_norm": norm, "_margin": margin})
    runs = rows.where(F.col("_margin") & (F.length("text") < 180)).groupBy(group, "_norm").agg(F.count_distinct("page").alias("_n")).where("_n >= 2")
    out = rows.join(runs, [group, "_norm"], "left")
    marked = F.col("_margin") & F.col("_n").isNotNull()
    new = {"kind": F.when(marked, "header").otherwise(F.col("kind"))}
    if "section_titles" in blocks.columns:
        new["section_titles"] = F.when(marked, F.array().cast(blocks.schema["section_titles"].dataType)).otherwise(F.col("section_titles"))
    return out.withColumns(new).drop("_norm", "_margin", "_n")


def join_fragments(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Joins caption columns and the fragments of numbered equations, page by page; all columns stay.

    Candidate pairs are a self-join within a page: a seed (caption or numbered equation) with the blocks that lie where
    its fragments may. Seeds then claim in page order, in one fold over a page's seeds: a block that an earlier one has
    claimed neither claims nor is claimed, and an equation needs an operator sign in what it gathers. A joined block has
    the members' text from left to right, the union of their boxes, the largest font, their notes shifted to their new
    places, no titles, and what else its seed had. blocks: doc, page, ord, text, x0, y0, x1, y1, font_size, kind and more.
    """
    page = [doc, "page"]
    flat, lines = tx.compact(F.col("text")), F.split("text", "\n")
    caption = flat.rlike(f"^(?:{tx.FIGURE})")
    numbered = F.exists(lines, lambda x: F.trim(x).rlike(f"^(?:{tx.EQUATION})$"))
    rows = written(blocks.withColumns({"_caption": caption, "_numbered": numbered, "_sign": F.col("text").rlike("[=∑∫≤≥]")}), "blocks")
    box = ["ord", "x0", "y0", "x1", "y1", "font_size", "_caption", "_numbered", "_sign"]
    a = rows.where("_caption or _numbered").select(*page, F.struct(*box).alias("a"))
    b = rows.select(*page, F.struct(*box, F.length("text").alias("size")).alias("b"))
    x, y = F.col("a"), F.col("b")
    gap, top, foot, font = y["x0"] - x["x1"], F.abs(x["y0"] - y["y0"]), F.abs(x["y1"] - y["y1"]), F.abs(x["font_size"] - y["font_size"])
    beside = gap.between(0, 35) & (top < 3) & (foot < 12) & (font < 0.6) & (y["size"] > 50) & ~y["_caption"]
    within = (F.least(x["y1"], y["y1"]) > F.greatest(x["y0"], y["y0"])) & (y["x0"] >= x["x0"] - 30) & (y["x0"] < x["x1"] - 20) & (y["x1"] <= x["x1"]) & (y["size"] < 100)
    near = a.join(b, page).where((x["ord"] != y["ord"]) & F.when(x["_caption"], beside).otherwise(within))
    seeds = near.groupBy(*page, "a").agg(F.array_sort(F.collect_list(F.struct(y["ord"].alias("ord"), y["_sign"].alias("sign")))).alias("near"))
    seeds = seeds.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col("a.ord").alias("ord"), F.col("a._numbered").alias("numbered"), F.col("a._sign").alias("sign"), "near"))).alias("seeds"))

    def claim(acc: Column, seed: Column) -> Column:
        free = F.filter(seed["near"], lambda n: ~F.array_contains(acc["claimed"], n["ord"]))
        sound = (F.size(free) > 0) & (~seed["numbered"] | seed["sign"] | F.exists(free, lambda n: n["sign"])) & ~F.array_contains(acc["claimed"], seed["ord"])
        members = F.concat(F.array(seed["ord"]), F.transform(free, lambda n: n["ord"]))
        pairs = F.transform(members, lambda m: F.struct(seed["ord"].alias("owner"), m.alias("ord")))
        return F.when(sound, F.struct(F.concat(acc["claimed"], members).alias("claimed"), F.concat(acc["pairs"], pairs).alias("pairs"))).otherwise(acc)

    start = F.struct(F.array().cast("array<int>").alias("claimed"), F.array().cast("array<struct<owner:int,ord:int>>").alias("pairs"))
    owned = seeds.select(*page, F.explode(F.aggregate("seeds", start, claim, lambda acc: acc["pairs"])).alias("p")).select(*page, "p.owner", "p.ord")
    rows = rows.withColumn("ord", F.col("ord").cast("int")).join(owned, [*page, "ord"], "left").withColumn("owner", F.coalesce("owner", "ord"))
    notes = "notation" in blocks.columns
    part = F.struct("x0", "ord", "text", *(["notation"] if notes else []))
    groups = rows.groupBy(*page, "owner").agg(
        F.count("*").alias("_n"), F.array_sort(F.collect_list(part)).alias("_parts") if not notes else F.array_sort(F.collect_list(part), lambda p, q: F.when(p["x0"] < q["x0"], -1).when(p["x0"] > q["x0"], 1).otherwise(p["ord"] - q["ord"])).alias("_parts"),
        F.min("x0").alias("_x0"), F.min("y0").alias("_y0"), F.max("x1").alias("_x1"), F.max("y1").alias("_y1"), F.max("font_size").alias("_font"),
    ).where("_n > 1")
    rows = rows.where("ord = owner").join(groups, [*page, "owner"], "left")
    joined = F.col("_n").isNotNull()
    new = {"text": F.array_join(F.transform("_parts", lambda p: p["text"]), "\n"), "x0": F.col("_x0"), "y0": F.col("_y0"), "x1": F.col("_x1"), "y1": F.col("_y1"), "font_size": F.col("_font"), "kind": F.lit("paragraph")}
    if notes:
        shift = lambda i: F.aggregate(F.slice("_parts", F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p["text"]) + 1)
        moved = lambda p, i: F.transform(p["notation"], lambda n: n.withField("start_char", n["start_char"] + shift(i)).withField("end_char", n["end_char"] + shift(i)))
        new["notation"] = F.flatten(F.transform("_parts", moved))
    if "section_titles" in blocks.columns:
        new["section_titles"] = F.array().cast("array<string>")
    rows = rows.select(*(F.when(joined, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in blocks.columns))
    return rows.withColumn("ord", F.row_number().over(W.partitionBy(*page).orderBy("ord")) - 1)


def titles(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, title): on page 1 the first heading of the largest font with over 20 characters, and the like ones right below it.

    The run ends at the first block that is no heading, differs in font or leaves a gap; found by a running flag.
    """
    first = blocks.where("page = 1")
    start = first.where((F.col("kind") == "heading") & (F.length("text") > 20)).groupBy(doc).agg(F.max_by(F.struct("ord", "font_size"), F.struct("font_size", -F.col("ord"))).alias("_s"))
    w = W.partitionBy(doc).orderBy("ord")
    rows = first.join(start, doc).where(F.col("ord") >= F.col("_s.ord"))
    gap = F.col("y0") - F.lag("y1").over(w)
    broken = (F.col("ord") > F.col("_s.ord")) & ((F.col("kind") != "heading") | (F.abs(F.col("font_size") - F.col("_s.font_size")) > 0.5) | ~gap.between(0, 35))
    rows = rows.withColumn("_broken", F.coalesce(broken, F.lit(False)).cast("int"))
    rows = rows.withColumn("_broken", F.sum("_broken").over(w)).where("_broken = 0")
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.trim(x).rlike(tx.TEMPLATE_HEADER))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.array_join(lines, "\n").alias("t")))), lambda x: x["t"]), " ")
    return rows.groupBy(doc).agg(F.left(tx.compact(joined), F.lit(500)).alias("title"))


def displayed_box(box: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A page box as shown after the page's rotation."""
    def made(*xs: Column) -> Column:
        return F.struct(*(x.alias(k) for x, k in zip(xs, ("x0", "y0", "x1", "y1"), strict=True)))

    x0, y0, x1, y1 = (box[k] for k in ("x0", "y0", "x1", "y1"))
    return F.when(rotation == 90, made(height - y1, x0, height - y0, x1)).when(rotation == 180, made(width - x1, height - y1, width - x0, height - y0)).when(rotation == 270, made(y0, width - x1, y1, width - x0)).otherwise(made(x0, y0, x1, y1))


def glyph_notation(glyphs: Column, body: Column, baseline: Column, rules: Column | None = None) -> tuple[Column, Column]:
    """(notes, issues) of a line's glyph spans (start, end, raw, size, origin_y, superscript, attached, x0, x1, y0).

    Superscript by flag or by a raised baseline, subscript by a lowered one and a smaller size, overbar by one of the
    short rules (x0, x1, y) right above exactly one character. Spans that are shifted but fit neither, that have both a
    flag and a lowered baseline, and rules over several characters are issues; nothing is guessed.
    """
    far = lambda g: g["origin_y"] - baseline
    small = lambda g: g["size"] < body * 0.8
    low, high = (lambda g: small(g) & far(g).between(body * 0.1, body * 0.55)), (lambda g: small(g) & (far(g) < -body * 0.1) & (far(g) > -body))
    word = lambda g: g["attached"] & g["raw"].rlike(r"(?U)\w")
    kind = lambda g: F.when(g["superscript"] & low(g), None).when(g["superscript"] | high(g), "SUPERSCRIPT").when(low(g), "SUBSCRIPT")
    made = lambda g, k, shown: F.struct(g["start"].alias("start_char"), g["end"].alias("end_char"), g["raw"].alias("raw"), shown.alias("display"), k.alias("kind"))
    notes = F.array_compact(F.transform(glyphs, lambda g: F.when(kind(g).isNotNull() & word(g), made(g, kind(g), F.concat(F.when(kind(g) == "SUBSCRIPT", "_").otherwise("^"), g["raw"])))))
    unclear = lambda g: word(g) & kind(g).isNull() & (g["superscript"] | small(g) & (F.abs(far(g)) >= body * 0.1))
    issues = F.transform(F.filter(glyphs, unclear), lambda g: F.struct(g["start"].alias("start_char"), F.lit("AMBIGUOUS_SHIFT").alias("issue")))
    if rules is not None:
        under = lambda r: F.filter(glyphs, lambda g: (g["x0"] < r["x1"]) & (g["x1"] > r["x0"]) & (g["y0"] - r["y"]).between(0, body * 0.4))
        one = lambda r: F.get(under(r), F.lit(0))
        single = lambda r: (F.size(under(r)) == 1) & (F.length(one(r)["raw"]) == 1)
        bars = F.transform(F.filter(rules, single), lambda r: made(one(r), F.lit("OVERBAR"), F.concat(one(r)["raw"], F.lit("\u0305"))))
        notes = F.array_sort(F.concat(notes, bars))
        issues = F.concat(issues, F.transform(F.filter(rules, lambda r: ~single(r) & (F.size(under(r)) > 0)), lambda r: F.struct(one(r)["start"].alias("start_char"), F.lit("AMBIGUOUS_OVERBAR").alias("issue"))))
    return notes, issues
