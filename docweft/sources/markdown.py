"""Markdown files with front matter, and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, front, body, valid) of whole files; files without front matter are kept and not valid."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return rows.select("path", F.regexp_extract("value", FRONT, 1).alias("front"), F.when(F.col("value").rlike(FRONT), F.regexp_extract("value", FRONT, 2)).otherwise(F.col("value")).alias("body"), F.col("value").rlike(FRONT).alias("valid"))


def field(front: Column, name: str) -> Column:
    """A scalar field of simple front matter, without quotes; null if it is missing."""
    found = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(front.rlike(rf"(?m)^{name}:"), F.regexp_replace(found, r"""^(["'])(.*)\1$""", "$2"))


def list_field(front: Column, name: str) -> Column:
    """A list field of simple front matter: [a, b] or dashed lines; empty if it is missing."""
    inline = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\[(.*?)\][ \t]*$", 1)
    dashed = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*-[^\n]*\n?)+)", 1)
    items = F.when(inline != "", F.split(inline, r"\s*,\s*")).otherwise(F.regexp_extract_all(dashed, F.lit(r"(?m)^[ \t]*-[ \t]*(.*?)[ \t]*$"), F.lit(1)))
    return F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2")), lambda x: x != "")


def repeated_ids(cards: DataFrame, key: str = "id") -> DataFrame:
    """Adds repeated: true for every card of an id but the first by path."""
    from pyspark.sql import Window as W

    return cards.withColumn("repeated", F.row_number().over(W.partitionBy(key).orderBy("path")) > 1)


def scanned(cards: DataFrame, required: tuple[str, ...], key: str = "id") -> DataFrame:
    """Cards of read() with their id and fault: no front matter, a required field missing, or an id that an earlier path has; null for sound ones. The scan goes on past faulty cards."""
    rows = cards.withColumn(key, field(F.col("front"), key))
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(field(F.col("front"), f)), F.lit("")) == "", f) for f in (key, *required))))
    own = F.when(~F.col("valid"), "no front matter").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    rows = rows.withColumn("fault", own)
    sound = repeated_ids(rows.where("fault is null"), key)
    return sound.withColumn("fault", F.when(F.col("repeated"), "repeated id")).drop("repeated").unionByName(rows.where("fault is not null"))


def write_report(rows: DataFrame, path: str) -> bool:
    """Writes a report as JSON unless the one there has the same rows; tells whether it wrote."""
    spark = rows.sparkSession
    try:
        old = spark.read.schema(rows.schema).json(path)
        if rows.exceptAll(old).isEmpty() and old.exceptAll(rows).isEmpty():
            return False
    except Exception as e:  # the path is missing
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("overwrite").json(path)
    return True


def lines(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows as lines of a Markdown table, a column `line`; bars and line breaks in values are written so that they stay in their cell."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", "<br>")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))


def write_lines(rows: DataFrame, path: str, *columns: str) -> None:
    """Writes rows, in their order, as Markdown tables, a file a partition."""
    lines(rows, *columns).write.mode("overwrite").text(path)


#: Lines of a report's file; longer sections go on in further files.
FILE_LINES = 10_000


def report_files(rows: DataFrame, folder: str, sections: tuple[str, ...], per_file: int = FILE_LINES) -> DataFrame:
    """(path, content) of a report(section, item, value): a Markdown file for each part of a section, and INDEX.md that links them in order.

    Sections stand in the order given (others are left out), items by falling value, then name. A file has at most
    per_file lines, so that no row grows with the report; the index has a line a file.
    """
    from ..operators.catalog import placed

    order = {name: k for k, name in enumerate(sections)}
    known = rows.where(F.col("section").isin(*sections)).withColumn("k", F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("section")])
    rows = placed(known, F.col("k"), -F.col("value"), F.col("item"))
    first = rows.groupBy("k").agg(F.min("place").alias("first"))
    rows = rows.join(F.broadcast(first), "k").withColumn("part", F.floor((F.col("place") - F.col("first")) / per_file).cast("long"))
    line = F.concat(F.lit("- "), F.regexp_replace("item", r"[\r\n]+", " "), F.lit(": "), F.col("value").cast("string"))
    parts = rows.groupBy("k", "section", "part").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    path = F.concat(F.lit(f"{folder}/"), F.replace("section", F.lit(" "), F.lit("-")), F.when(F.col("part") > 0, F.concat(F.lit("-"), F.col("part") + 1)).otherwise(""), F.lit(".md"))
    parts = parts.select("k", "part", F.size("lines").alias("n"), path.alias("path"), F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))
    link = F.concat(F.lit("- ["), "path", F.lit("]("), "path", F.lit("): "), F.col("n").cast("string"))
    index = parts.agg(F.array_sort(F.collect_list(F.struct("k", "part", link.alias("line")))).alias("lines"))
    index = index.select(F.lit("INDEX.md").alias("path"), F.concat(F.lit("# Index\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))
    return parts.select("path", "content").unionByName(index)


def contract(df: DataFrame) -> str:
    """A table's schema as JSON, for snapshot tests."""
    return df.schema.json()
