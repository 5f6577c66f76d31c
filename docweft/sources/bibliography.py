"""Bibliography exports as DataFrames: API wrappers, item lists with collections, and CSL, in one record shape."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as tx
from . import json_items

# Only the fields that are used; other fields of the exports are ignored, and missing ones are null.
_PERSON = "struct<creatorType:string,name:string,literal:string,firstName:string,lastName:string,given:string,family:string>"
_ITEM = (
    "itemType string, type string, itemKey string, key string, id string, itemID string, parentItem string, title string, citationKey string, `citation-key` string, citekey string, extra string, "
    f"issued struct<`date-parts`:array<array<string>>>, date string, language string, publicationTitle string, `container-title` string, creators array<{_PERSON}>, author array<{_PERSON}>, "
    "tags array<string>, collections array<string>, attachments array<struct<path:string,localPath:string,url:string>>, path string, filename string, version bigint"
)


def read(spark: SparkSession, path: str, csl: bool = False, library: tuple[str, str] = ("user", "0")) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of a JSON export: a list of items, or an object with items. Items without a title are errors; notes and annotations are left out; attachments join their parents."""
    rows = json_items.items(spark, path)
    data = F.coalesce(F.get_json_object("raw", "$.data"), F.col("raw"))
    simple = lambda name: F.regexp_replace(data, rf'\{{\s*"{name}"\s*:\s*("(?:[^"\\]|\\.)*")\s*(?:,[^{{}}]*)?\}}', "$1")
    rows = rows.select("position", F.get_json_object("raw", "$.key").alias("outer_key"), F.get_json_object("raw", "$.version").cast("long").alias("outer_version"), F.from_json(simple("tag"), f"struct<{_struct(_ITEM)}>", {"mode": "PERMISSIVE"}).alias("i"), *(F.get_json_object(data, f"$.{f}").alias(n) for f, n in (("DOI", "doi_1"), ("doi", "doi_2"), ("url", "url_1"), ("URL", "url_2"))))
    kind = F.coalesce("i.itemType", "i.type", F.lit(""))
    key = F.coalesce("outer_key", "i.itemKey", "i.key", "i.id", F.lit(""))
    rows = rows.withColumns({"kind": kind, "item_key": key})
    found = rows.where("kind = 'attachment' and i.parentItem is not null").groupBy(F.col("i.parentItem").alias("item_key")).agg(F.array_compact(F.collect_set(F.coalesce("i.path", "url_1", "i.filename"))).alias("found"))
    works = rows.where(~F.col("kind").isin("attachment", "note", "annotation"))
    bad = ~tx.meaningful(F.col("i.title"))
    good = works.where(~bad).join(found, "item_key", "left")
    cite = F.coalesce("i.citationKey", F.col("i")["citation-key"], "i.citekey", tx.extra_cite_key(F.col("i.extra")), F.when(F.lit(csl), F.col("i.id")))
    year = tx.year(F.get(F.get(F.col("i.issued")["date-parts"], F.lit(0)), F.lit(0)), F.col("i.date"))
    doi = tx.doi(F.coalesce("doi_1", "doi_2"))
    made = F.concat(F.lit("EXPORT"), F.upper(F.substring(F.sha2(F.when(doi != "", doi).otherwise(F.concat(tx.title_key(F.col("i.title")), F.coalesce(year.cast("string"), F.lit("")))), 256), 1, 10)))
    full = lambda p: F.coalesce(p["name"], p["literal"], F.nullif(F.trim(F.concat_ws(" ", p["firstName"], p["lastName"])), F.lit("")), F.nullif(F.trim(F.concat_ws(" ", p["given"], p["family"])), F.lit("")))
    people = F.filter(F.coalesce("i.creators", "i.author"), lambda p: F.coalesce(p["creatorType"], F.lit("author")).isin("author", "inventor"))
    no_paths = F.array().cast("array<string>")
    own_paths = F.coalesce(F.array_compact(F.transform("i.attachments", lambda a: F.coalesce(a["path"], a["localPath"], a["url"]))), no_paths)
    final_key = F.when(F.col("item_key") == "", made).otherwise(F.col("item_key"))
    records = good.select(
        F.lit(library[0]).alias("library_type"), F.lit(library[1]).alias("library_id"), final_key.alias("item_key"), F.coalesce(cite, F.concat(F.lit("zotero-"), final_key)).alias("cite_key"), F.trim("i.title").alias("title"),
        F.array_compact(F.transform(people, full)).alias("authors"), year.alias("year"), doi.alias("doi_key"), tx.title_key(F.col("i.title")).alias("title_key"), F.coalesce("url_1", "url_2").alias("url"), F.col("i.language").alias("language"),
        F.coalesce("i.publicationTitle", F.col("i")["container-title"]).alias("venue"), F.array_sort(F.array_distinct(F.coalesce("i.tags", no_paths))).alias("tags"), F.array_sort(F.array_distinct(F.coalesce("i.collections", no_paths))).alias("collection_keys"),
        F.array_sort(F.array_distinct(F.concat(own_paths, F.coalesce("found", no_paths)))).alias("attachment_paths"), F.coalesce("outer_version", "i.version").alias("version"), (F.col("item_key") == "").alias("synthetic_item_key"),
    )
    return records, works.where(bad).select("position", F.lit("item without a title").alias("error"))


def _struct(fields: str) -> str:
    """Column definitions as the fields of a struct type."""
    return ",".join(":".join(part.split(" ", 1)) for part in fields.split(", "))


class PagedSource(DataSource):
    """A paged REST listing as a batch source: option url with {start} and {limit}; a page short of the limit is the last one.

    Pages are read by `pages` partitions, each by every pages-th page, so the listing is read in parallel and no page twice.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "page int, raw string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.limit, self.parts = options["url"], int(options.get("limit", 100)), int(options.get("pages", 4))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        import json
        import urllib.request

        page = partition.value
        while True:
            with urllib.request.urlopen(self.url.format(start=page * self.limit, limit=self.limit), timeout=60) as answer:
                items = json.load(answer)
            for item in items:
                yield page, json.dumps(item, ensure_ascii=False)
            if len(items) < self.limit:
                return
            page += self.parts
