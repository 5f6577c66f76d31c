"""Large JSON exports, cut at the borders of their items by many tasks.

One file may be one array of millions of items on one line, so neither lines nor files are units of work. Spark reads the
file in byte ranges and cuts it behind every closing brace (`lineSep`); where a piece stands in its file is its range's
start and its number in the range. Whether a piece begins within a string is the parity of the quotation marks before it,
and its depth is the sum of the brackets before it: both are running sums, taken within a range and then over the ranges'
totals, so no task sees more than a range. An item ends where the depth comes back to that of the array; the pieces of an
item are put together again, and parsing goes on as for any column.

Defined results: the array is the whole file, or the value of one key of an object (`items`). Elements that are no objects,
pieces that never end, and what cannot be parsed stay in the result as they are, for the caller to count. A file without
the array has no items. An item is held as a whole by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"')))


def _depth(text: Column) -> Column:
    """Opening less closing brackets of a text without strings."""
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def _delta(plain: Column, inside: Column) -> Column:
    """The change of depth over a piece without escapes, if it begins inside a string or not."""
    outside = F.regexp_replace(F.when(inside, F.concat(F.lit('"'), plain)).otherwise(plain), r'"[^"]*("|$)', "")
    return _depth(outside)


def _before(rows: DataFrame, value: str, total: str) -> DataFrame:
    """Adds `total`, the sum of `value` over all earlier pieces of the file: running sums within ranges, then over ranges."""
    ranges = rows.groupBy("file", "start").agg(F.sum(value).alias("_sum"))
    first = F.coalesce(F.sum("_sum").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("file", "start", first.alias("_first"))
    own = F.coalesce(F.sum(value).over(W.partitionBy("file", "start").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(ranges, ["file", "start"]).withColumn(total, F.col("_own") + F.col("_first")).drop("_own", "_first")


def items(spark: SparkSession, path: str, key: str = "items") -> DataFrame:
    """(file, position, raw) of the elements of every JSON file at a path; position: how many objects of its file come before it."""
    read = spark.read.option("lineSep", "}").text(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("piece"))
    rows = written(rows, "pieces")
    # The reader takes the braces away; all pieces but a file's last one had one, and that too if the file is long enough.
    whole = rows.groupBy("file").agg(F.max(F.struct("start", "at")).alias("last"), (F.sum(F.octet_length("piece") + 1) <= F.first("size")).alias("closed"))
    ends = F.when(F.col("closed") | (F.struct("start", "at") < F.col("last")), "}").otherwise("")
    rows = rows.join(whole, "file").select("file", "start", "at", F.concat("piece", ends).alias("piece"))
    plain = F.regexp_replace("piece", r"\\.", "")
    rows = _before(rows.withColumn("quotes", _quotes(plain)), "quotes", "quoted").withColumn("inside", F.col("quoted") % 2 == 1)
    rows = written(_before(rows.withColumn("delta", _delta(plain, F.col("inside"))), "delta", "depth").drop("quotes", "quoted"), "pieces")
    return _elements(_array(rows, key))


def _array(rows: DataFrame, key: str) -> DataFrame:
    """The pieces from the array's opening bracket on (what stands before it cut away), with base, the depth inside the array."""
    head = rf'(?s)^(.*?)"{key}"\s*:\s*\['
    lead = F.regexp_extract("piece", head, 1)
    quiet = F.regexp_replace(lead, r"\\.", "")
    outside = (F.col("inside").cast("int") + _quotes(quiet)) % 2 == 0
    keyed = F.col("piece").rlike(head) & outside & (F.col("depth") + _delta(quiet, F.col("inside")) == 1)
    plain = (F.col("depth") == 0) & ~F.col("inside") & F.col("piece").rlike(r"^\s*\[")
    begins = rows.where(plain | keyed).groupBy("file").agg(F.min(F.struct("start", "at", F.when(plain, 1).otherwise(2).alias("base"))).alias("begin"))
    here = F.struct("start", "at")
    of = F.struct(F.col("begin.start"), F.col("begin.at"))
    rows = rows.join(begins, "file").where(here >= of)
    cut = F.when(F.col("begin.base") == 1, F.regexp_replace("piece", r"^\s*\[", "")).otherwise(F.regexp_replace("piece", head, ""))
    end = F.col("depth") + F.col("delta")
    return rows.select("file", "start", "at", F.when(here == of, cut).otherwise(F.col("piece")).alias("piece"), F.when(here == of, F.col("begin.base")).otherwise(F.col("depth")).alias("depth"), end.alias("end"), F.when(here == of, False).otherwise(F.col("inside")).alias("inside"), F.col("begin.base").alias("base"))


#: What stands before an object in the array, strings whole.
_LEAD = r'(?s)^((?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+)(.*)$'

#: What stands before the bracket that ends the array, in a piece where no other object begins before it: strings, plain values, and lists of these up to three deep.
_TAIL = r'(?s)^((?:[^"\[\]{]++|"(?:[^"\\]++|\\.)*+"|\[(?:[^\[\]]++|\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\])*+\])*+)\]'


def _elements(rows: DataFrame) -> DataFrame:
    """The elements of the array's pieces, put together."""
    level = (F.col("depth") == F.col("base")) & ~F.col("inside")
    lead = F.regexp_replace(F.regexp_extract("piece", _LEAD, 1), r'"(?:[^"\\]++|\\.)*+"', "")
    signs = F.split(F.regexp_replace(lead, r"[^\[\]]", ""), "")
    open_ = F.aggregate(signs, F.lit(0), lambda n, c: F.when((c == "") | (n < 0), n).when(c == "[", n + 1).otherwise(n - 1))
    closed = level & (open_ < 0)  # the array ends before another object begins
    ended = rows.where(closed).groupBy("file").agg(F.min(F.struct("start", "at")).alias("_end"))
    rows = rows.join(ended, "file", "left").where(F.col("_end").isNull() | (F.struct("start", "at") <= F.col("_end")))
    rows = rows.withColumn("last", F.col("_end").isNotNull() & (F.struct("start", "at") == F.col("_end"))).drop("_end")
    rows = rows.withColumn("done", ((F.col("end") == F.col("base")) & ~F.col("last")).cast("int"))
    rows = _before(rows, "done", "position")
    text = F.when(F.col("last"), F.regexp_extract("piece", _TAIL, 1)).otherwise(F.col("piece"))
    whole = rows.groupBy("file", "position").agg(F.array_sort(F.collect_list(F.struct("start", "at", text.alias("text")))).alias("p"))
    whole = whole.select("file", "position", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    parts = F.array(F.regexp_extract("text", _LEAD, 1), F.regexp_extract("text", _LEAD, 2))
    bare = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[\s,]+|[\s,]+$", "")), lambda x: x != "")
    return whole.select("file", F.col("position").cast("long").alias("position"), F.explode(bare).alias("raw"))


def _framed(batches):
    import pyarrow as pa

    n = 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([("," if n + k else "[") + t for k, t in enumerate(texts)], pa.string())], ["value"])
        n += len(texts)
    yield pa.RecordBatch.from_arrays([pa.array(["]" if n else "[]"], pa.string())], ["value"])


def write(objects: DataFrame, path: str) -> None:
    """Writes a column of JSON objects as JSON files, an array a partition."""
    objects.mapInArrow(_framed, "value string").write.text(path)
