"""Gold sets, metrics, adjudication credit, snapshot diffs and rebuilds on stable ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import written

# Acceptance thresholds of the frozen protocol.
THRESHOLDS = {"precision": 0.9, "recall": 0.8, "type": 0.9, "anchor": 1.0, "page": 1.0, "figure": 1.0, "equation": 1.0, "quantity": 1.0, "provenance": 1.0}
DECISIONS = ("ACCEPT", "REVISE", "REJECT")


def contains(outer: Column, inner: Column) -> Column:
    """Box containment with one unit of tolerance."""
    return (outer["x0"] <= inner["x0"] + 1) & (outer["y0"] <= inner["y0"] + 1) & (outer["x1"] >= inner["x1"] - 1) & (outer["y1"] >= inner["y1"] - 1)


def prediction_key(kind: Column, text: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit("\n"), text), 256)


#: The side of the smallest grid cells, in a page's units, and the most doublings of it.
CELL, LEVELS = 64.0, 24


def _cells(df: DataFrame, box: str, margin: float) -> DataFrame:
    """A row for each cell that a box touches (nine at most): cells of the level whose side is at least the box's longer one."""
    b = F.col(box)
    side = F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"]) + 2 * margin
    rows = df.withColumn("level", F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(1.0)) / CELL)))).cast("int"))
    size = CELL * F.pow(F.lit(2.0), F.col("level"))
    at = lambda v: F.floor(v / size)
    rows = rows.where(side.isNotNull()).withColumn("cx", F.explode(F.sequence(at(b["x0"] - margin), at(b["x1"] + margin))))
    return rows.withColumn("cy", F.explode(F.sequence(at(b["y0"] - margin), at(b["y1"] + margin))))


def inside_pairs(outer: DataFrame, inner: DataFrame, keys: list[str], out_box: str, in_box: str) -> DataFrame:
    """Rows of outer and inner with equal keys (paper, page) whose box of outer contains that of inner.

    Both meet in grid cells and not page by page: an outer box lies in the few cells of its size that it touches, an
    inner one in that of its middle, once for each size that occurs. The middle lies inside what contains the box, so
    every pair meets in exactly one cell. Boxes have x0 <= x1 and y0 <= y1; those with a null or not a number contain nothing.
    """
    b = F.col(in_box)
    whole = ~F.isnan(b["x0"] + b["x1"] + b["y0"] + b["y1"])
    cells = _cells(outer.where(~F.isnan(F.col(out_box)["x0"] + F.col(out_box)["x1"] + F.col(out_box)["y0"] + F.col(out_box)["y1"])), out_box, 1.0)
    levels = [r.level for r in cells.select("level").distinct().collect()]  # LEVELS + 1 at most
    points = inner.where(whole).withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    size = CELL * F.pow(F.lit(2.0), F.col("level"))
    points = points.withColumns({"cx": F.floor((b["x0"] + b["x1"]) / 2 / size), "cy": F.floor((b["y0"] + b["y1"]) / 2 / size)})
    return cells.join(points, [*keys, "level", "cx", "cy"]).where(contains(F.col(out_box), b)).drop("level", "cx", "cy")


def in_windows(nodes: DataFrame, anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """Nodes other than PAPER and SECTION with an anchor whose box holds a gold window on its page of its paper."""
    a = anchors.select(F.col("id").alias("anchor_id"), "paper_id", F.col("page_number").alias("page"), F.col("bbox").alias("a_box"))
    w = windows.select("paper_id", "page", F.col("bbox").alias("w_box"))
    rows = nodes.where(~F.col("type").isin("PAPER", "SECTION")).select("id", F.explode("provenance").alias("anchor_id"))
    hits = inside_pairs(rows.join(a, "anchor_id"), w, ["paper_id", "page"], "a_box", "w_box").select("id").distinct()
    return nodes.join(hits, "id", "left_semi")


#: Lengths of the pieces by which texts meet, longest first.
PIECES = (12, 6, 3, 1)


def holders(items: DataFrame, texts: DataFrame, keys: list[str], wanted: Column, text: Column) -> DataFrame:
    """Rows of items beside rows of texts with equal keys, among them all whose text holds every one of the wanted texts.

    A text that holds another has all pieces of a length of it. An item asks for one only, the rarest of its wanted
    texts' in its keys' texts, of the greatest length that one of them has: so it meets few texts however many its keys
    have. An item of empty texts meets all of its keys.
    """
    longest = F.array_max(F.transform(wanted, F.length))
    size = F.lit(0)
    for n in sorted(PIECES):
        size = F.when(longest >= n, n).otherwise(size)
    items = written(items.withColumns({"_size": size, "_item": F.monotonically_increasing_id()}), "items")
    texts = written(texts.withColumn("_text", F.monotonically_increasing_id()), "texts")
    found = items.where("_size = 0").drop("_size", "_item").join(texts.drop("_text"), keys)
    for (n,) in items.where("_size > 0").select("_size").distinct().collect():  # len(PIECES) at most
        cut = lambda t: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n))))  # noqa: B023, E731
        one = items.where(F.col("_size") == n)
        asked = one.select("_item", *keys, F.explode(F.array_distinct(F.flatten(F.array_compact(F.transform(wanted, cut))))).alias("_piece"))
        held = texts.select("_text", *keys, F.explode(F.array_distinct(cut(text))).alias("_piece"))
        counts = held.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
        # A piece that no text has is the rarest: its item meets none.
        rarest = asked.join(counts.hint("merge"), [*keys, "_piece"], "left").groupBy("_item", *keys).agg(F.min_by("_piece", F.struct(F.coalesce("_n", F.lit(0)), "_piece")).alias("_piece"))
        # Sizes of files say nothing of exploded rows: no side is broadcast for them.
        met = rarest.join(held.hint("merge"), [*keys, "_piece"]).select("_item", "_text")
        found = found.unionByName(met.join(one.drop("_size").hint("merge"), "_item").join(texts.drop(*keys).hint("merge"), "_text").drop("_item", "_text"))
    return found


def gold_matches(gold: DataFrame, nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per gold item (gold_id) the node that has all its components: same type first, then the smallest id; null if none.

    A component fits where an anchor of the node lies on the item's page of its paper, holds its box, and the node's text its text.
    """
    whole = lambda b: ~F.isnan(b["x0"] + b["x1"] + b["y0"] + b["y1"])
    c = F.transform("components", lambda c: F.struct(c["bbox"].alias("box"), tx.compact(c["text"]).alias("text")))
    items = gold.select(F.col("id").alias("gold_id"), F.col("type").alias("gold_type"), "paper_id", "page", c.alias("parts"))
    items = items.where((F.size("parts") > 0) & F.forall("parts", lambda c: F.coalesce(whole(c["box"]) & c["text"].isNotNull(), F.lit(False))))
    own = nodes.where(~F.col("type").isin("PAPER", "SECTION")).select("id", "type", tx.compact(F.col("text")).alias("flat"), F.explode("provenance").alias("anchor_id"))
    own = own.join(anchors.select(F.col("id").alias("anchor_id"), "paper_id", F.col("page_number").alias("page"), "bbox").hint("merge"), "anchor_id").where(whole(F.col("bbox")))
    own = own.groupBy("id", "type", "flat", "paper_id", "page").agg(F.collect_set("bbox").alias("boxes"))
    met = holders(items, own, ["paper_id", "page"], F.transform("parts", lambda c: c["text"]), F.col("flat"))
    per = met.where(F.forall("parts", lambda c: F.contains(F.col("flat"), c["text"]) & F.exists("boxes", lambda b: contains(b, c["box"]))))
    best = per.groupBy("gold_id").agg(F.min_by(F.struct("id", "type"), F.struct((F.col("type") != F.col("gold_type")).cast("int"), F.col("id"))).alias("b"))
    return gold.select(F.col("id").alias("gold_id"), F.col("type").alias("gold_type")).join(best, "gold_id", "left").select("gold_id", "gold_type", F.col("b.id").alias("node_id"), (F.col("b.type") == F.col("gold_type")).alias("same_type"))


def metric(name: str, passed: Column, counted: Column | None = None) -> Column:
    """A struct (name, passed, total, rate, ok): the rate is null without a total; ok against the protocol's threshold."""
    total = F.count("*") if counted is None else F.count_if(counted)
    good = F.count_if(passed if counted is None else passed & counted)
    rate = F.try_divide(good, total)
    return F.struct(F.lit(name).alias("name"), good.alias("passed"), total.alias("total"), rate.alias("rate"), (rate >= THRESHOLDS[name]).alias("ok"))


def metrics(df: DataFrame, **checks: Column) -> DataFrame:
    """One row a metric: (name, passed, total, rate, ok)."""
    return df.agg(F.array(*(metric(k, v) for k, v in checks.items())).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def credited(predictions: DataFrame, direct: DataFrame, bound: DataFrame, explained: DataFrame) -> DataFrame:
    """(node_id, correct, basis): credit by precedence: a direct accept, a bound historical accept, a revise that was only explained, else none."""
    rows = predictions.select("node_id").distinct().join(direct.where("decision = 'ACCEPT'").select("node_id", F.lit(True).alias("_d")).distinct(), "node_id", "left")
    rows = rows.join(bound.select("node_id", F.col("decision").alias("_b"), "decision_id"), "node_id", "left")
    rows = rows.join(explained.select("decision_id", F.lit(True).alias("_e")).distinct(), "decision_id", "left")
    basis = F.when(F.col("_d"), "direct accept").when(F.col("_b") == "ACCEPT", "historical accept").when((F.col("_b") == "REVISE") & F.col("_e"), "explained revise").otherwise("unreviewed")
    return rows.select("node_id", (basis != "unreviewed").alias("correct"), basis.alias("basis"))


def decision_counts(events: DataFrame, key: str, order: str, decision: str, values: tuple[str, ...] = DECISIONS) -> DataFrame:
    """One row of counts by decision over each key's last event."""
    last = events.groupBy(key).agg(F.max_by(decision, order).alias("d"))
    return last.agg(*(F.count_if(F.col("d") == v).alias(v) for v in values))


def change(old: Column, new: Column, material: tuple[str, ...], other: tuple[str, ...]) -> Column:
    """EXACT, NONMATERIAL or MATERIAL by which fields of two structs differ; NEW and REMOVED where a side is missing."""
    same = lambda fields: F.array_min(F.array(F.lit(1), *(old[f].eqNullSafe(new[f]).cast("int") for f in fields))) == 1
    return F.when(old.isNull(), "NEW").when(new.isNull(), "REMOVED").when(~same(material), "MATERIAL").when(~same(other), "NONMATERIAL").otherwise("EXACT")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, material: tuple[str, ...], other: tuple[str, ...] = ()) -> DataFrame:
    """(key, change) of every key of two snapshots."""
    fields = [*material, *other]
    rows = old.select(key, F.struct(*fields).alias("_o")).join(new.select(key, F.struct(*fields).alias("_n")), key, "full")
    return rows.select(key, change(F.col("_o"), F.col("_n"), material, other).alias("change"))


def predecessors(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """(new_id, old_id, state): old rows equal in `on`; those of the same type before others; several leave it ambiguous, none makes it new."""
    o = old.select(*on, F.col("id").alias("_o"), F.col("type").alias("_t"))
    rows = new.select(*on, F.col("id").alias("new_id"), "type").join(o, on, "left")
    fits = F.coalesce(F.col("_t") == F.col("type"), F.lit(False))
    per = rows.groupBy("new_id").agg(F.count("_o").alias("n"), F.count_if(fits).alias("n_same"), F.min(F.when(fits, F.col("_o"))).alias("same"), F.min("_o").alias("any"))
    state = F.when(F.col("n") == 0, "NEW").when((F.col("n_same") == 1) | ((F.col("n_same") == 0) & (F.col("n") == 1)), "PAIRED").otherwise("AMBIGUOUS")
    return per.select("new_id", F.when(state == "PAIRED", F.coalesce("same", "any")).alias("old_id"), state.alias("state"))


def removed(old: DataFrame, new: DataFrame, pairs: DataFrame, source: str = "source_hash") -> DataFrame:
    """(old_id, state, source_preserved): old rows that no new one is paired with, and whether some new row still has their source."""
    left = old.join(pairs.where("state = 'PAIRED'").select(F.col("old_id").alias("id")), "id", "left_anti")
    have = new.select(source, F.lit(True).alias("_have")).distinct()
    return left.join(have, source, "left").select(F.col("id").alias("old_id"), F.lit("REMOVED_CANDIDATE").alias("state"), F.coalesce("_have", F.lit(False)).alias("source_preserved"))


def version_map(old: DataFrame, new: DataFrame, on: list[str], material: tuple[str, ...], other: tuple[str, ...] = (), source: str = "source_hash") -> DataFrame:
    """(new_id, old_id, state): every new row EXACT, NONMATERIAL or MATERIAL beside its one predecessor, AMBIGUOUS_MATCH or NEW_CANDIDATE; every old row without a successor REMOVED_CANDIDATE. Decisions are not carried."""
    pairs = predecessors(old, new, on)
    fields = [*material, *other]
    rows = pairs.join(new.select(F.col("id").alias("new_id"), F.struct(*fields).alias("_n")), "new_id").join(old.select(F.col("id").alias("old_id"), F.struct(*fields).alias("_o")), "old_id", "left")
    state = F.when(F.col("state") == "NEW", "NEW_CANDIDATE").when(F.col("state") == "AMBIGUOUS", "AMBIGUOUS_MATCH").otherwise(change(F.col("_o"), F.col("_n"), material, other))
    gone = removed(old, new, pairs, source).select(F.lit(None).cast(new.schema["id"].dataType).alias("new_id"), "old_id", "state")
    return rows.select("new_id", "old_id", state.alias("state")).unionByName(gone)


def drifted(ledger: DataFrame, now: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, drift): rows of a frozen ledger that are gone, and the names of the fields that have changed."""
    n = now.select(key, F.struct(*fields).alias("_now"))
    rows = ledger.select(key, F.struct(*fields).alias("_was")).join(n, key, "left")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_was.{f}").eqNullSafe(F.col(f"_now.{f}")), f) for f in fields)))
    drift = F.when(F.col("_now").isNull(), F.array(F.lit("(gone)"))).otherwise(changed)
    return rows.select(key, F.array_join(drift, ",").alias("drift")).where("drift <> ''")


def packet(mapped: DataFrame, events: DataFrame, key: str, order: str, decision: str) -> DataFrame:
    """(new_id, old_id, state, status, previous): what a reviewer sees of each mapped row: STALE, MATCHING or NEW_UNREVIEWED, and the predecessor's last decision for reading only."""
    last = events.groupBy(F.col(key).alias("old_id")).agg(F.max_by(decision, order).alias("previous"))
    rows = mapped.join(last, "old_id", "left")
    status = F.when(F.col("new_id").isNull(), "REMOVED").when(F.col("previous").isNull(), "NEW_UNREVIEWED").when(F.col("state") == "EXACT", "MATCHING").otherwise("STALE")
    return rows.select("new_id", "old_id", "state", status.alias("status"), "previous")


def mapped_edges(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """(new_id, old_id): new edges matched to old ones through the nodes' pairs, by source, target and relation."""
    p = pairs.where("state = 'PAIRED'")
    s, t = (p.select(F.col("new_id").alias(f"{e}_node_id"), F.col("old_id").alias(f"_{e}")) for e in ("source", "target"))
    rows = new.select(F.col("id").alias("new_id"), "source_node_id", "target_node_id", "relation_type").join(s, "source_node_id").join(t, "target_node_id")
    o = old.select(F.col("id").alias("old_id"), F.col("source_node_id").alias("_source"), F.col("target_node_id").alias("_target"), "relation_type")
    return rows.join(o, ["_source", "_target", "relation_type"]).select("new_id", "old_id")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b, equal): multiset differences both ways."""
    x, y = (one.exceptAll(two).agg(F.count("*").alias(n)) for one, two, n in ((a, b, "only_a"), (b, a, "only_b")))
    return x.join(F.broadcast(y)).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def rebuilt(stored: DataFrame, fresh: DataFrame, fields: list[str], updatable: tuple[str, ...] = ("PROCESS",)) -> DataFrame:
    """(id, action, version): rows on stable ids: untouched, updated in place (only of updatable types; version + 1), added, kept, or refused."""
    s = stored.select("id", "version", F.struct("type", *fields).alias("_s"))
    rows = s.join(fresh.select("id", F.struct("type", *fields).alias("_f")), "id", "full")
    action = F.when(F.col("_s").isNull(), "added").when(F.col("_f").isNull(), "kept").when(F.col("_s").eqNullSafe(F.col("_f")), "untouched").when(F.col("_s.type").isin(*updatable) & (F.col("_f.type") == F.col("_s.type")), "updated").otherwise("refused")
    return rows.select("id", action.alias("action"), F.when(action == "added", 1).when(action == "updated", F.col("version") + 1).otherwise(F.col("version")).alias("version"))


def rebuilt_evidence(actions: DataFrame, old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Evidence(node_id, anchor_id) after a rebuild: that of updated and added nodes is the fresh build's, that of all others stays."""
    act = actions.select(F.col("id").alias("node_id"), F.col("action").isin("updated", "added").alias("_new"))
    kept = old.join(act.where("not _new").select("node_id"), "node_id", "left_semi")
    return kept.select("node_id", "anchor_id").unionByName(fresh.join(act.where("_new").select("node_id"), "node_id", "left_semi").select("node_id", "anchor_id"))


def rebuilt_edges(actions: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with version + 1 where their target was updated."""
    up = actions.where("action = 'updated'").select(F.col("id").alias("target_node_id"), F.lit(1).alias("_up"))
    return edges.join(up, "target_node_id", "left").withColumn("version", F.col("version") + F.coalesce("_up", F.lit(0))).drop("_up")


#: Characters of items that one automaton holds; more items are looked for part by part.
AUTOMATON = 16_000_000


def contained_items(items: DataFrame, docs: DataFrame, item: str, doc: str, text: str = "text", most: int = AUTOMATON) -> DataFrame:
    """(item, doc): documents whose white-space compacted text holds the item's, whatever its length.

    One pass of an automaton over all items' texts finds those of a document, so no words are exploded and texts do not
    shuffle. The items' size is checked: beyond `most` characters they are dealt into parts of about that size by hash,
    each with its own pass. Items of nothing but white space are in no document; nulls neither; equal items are found each.
    """
    spark = docs.sparkSession
    flat = F.trim(F.regexp_replace(text, r"[\t\n\x0B\f\r ]+", " "))
    i = items.select(F.col(item).alias("_item"), flat.alias("_text")).where("_text <> ''")
    size = i.agg(F.sum(F.length("_text"))).first()[0] or 0
    parts = -(-size // most) or 1
    d = docs.select(F.col(doc).alias("_doc"), flat.alias("_flat")).where("_flat <> ''")
    kind, item_kind = d.schema["_doc"].dataType.simpleString(), i.schema["_item"].dataType
    found = None
    for k in range(parts):
        own = i.where(F.pmod(F.xxhash64("_text"), F.lit(parts)) == k).collect()  # bounded by `most`, within the hash's spread
        texts = spark.sparkContext.broadcast(list(dict.fromkeys(r._text for r in own)))
        number = {t: n for n, t in enumerate(texts.value)}
        names = spark.createDataFrame([(number[r._text], r._item) for r in own], T.StructType([T.StructField("_n", T.LongType()), T.StructField("_item", item_kind)]))
        hits = d.mapInArrow(_searched(texts), f"_doc {kind}, _n long").join(F.broadcast(names), "_n").select(F.col("_item").alias(item), F.col("_doc").alias(doc))
        found = hits if found is None else found.unionByName(hits)
    return found


def _searched(texts: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        patterns = ahocorasick.Automaton()
        for n, text in enumerate(texts.value):
            patterns.add_word(text, n)
        if texts.value:
            patterns.make_automaton()
        for batch in batches if texts.value else ():
            rows, hits = [], []
            for row, text in enumerate(batch.column(1)):
                met = {n for _, n in patterns.iter(text.as_py())}
                rows += [row] * len(met)
                hits += met
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(hits, pa.int64())], ["_doc", "_n"])

    return run
