"""Views, neighbourhoods, paths, cycles, components, order and centrality over nodes and edges tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import INACTIVE, VIEWS
from ..session import discard, scratch, written


def view(nodes: DataFrame, name: str = "knowledge") -> DataFrame:
    """The nodes of a view: all, some types, or the learning layer."""
    if name == "learning":
        return nodes.where("layer = 'LEARNING'")
    return nodes.where(F.col("type").isin(*VIEWS[name])) if name in VIEWS else nodes


def top_nodes(nodes: DataFrame, limit: int = 80) -> DataFrame:
    """The document's root first, then by created_at and id; at most limit (1 to 500) of them, with the total and whether some are missing."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must lie between 1 and 500")
    total = nodes.agg(F.count("*").alias("total"))
    first = nodes.orderBy((F.col("type") != "PAPER").cast("int"), "created_at", "id").limit(limit)
    return first.join(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    keys = nodes.select("id").distinct()
    out = edges.join(keys.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_semi")
    return out.join(keys.withColumnRenamed("id", "target_node_id"), "target_node_id", "left_semi")


def neighborhood(edges: DataFrame, start: str, depth: int = 1, limit: int = 120) -> DataFrame:
    """(id, hop) of the nodes within depth undirected hops; each hop's new ids in order up to what the limit leaves."""
    if not (0 <= depth <= 4 and 1 <= limit <= 300):
        raise ValueError("depth must lie between 0 and 4, limit between 1 and 300")
    spark = edges.sparkSession
    both = edges.select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen, frontier = {start: 0}, [start]
    for hop in range(1, depth + 1):
        room = limit - len(seen)
        if room <= 0 or not frontier:
            break
        # The frontier and what is seen number at most the limit: 300 ids.
        new = both.where(F.col("a").isin(frontier) & ~F.col("b").isin([*seen])).select("b").distinct().orderBy("b").limit(room)
        frontier = [r[0] for r in new.collect()]
        seen |= dict.fromkeys(frontier, hop)
    return spark.createDataFrame([*seen.items()], "id string, hop int")


def shortest_path(edges: DataFrame, start: str, target: str, most: int = 8, relations: tuple[str, ...] = ()) -> DataFrame:
    """One row (found, hops, path): the directed path of fewest hops over active edges; among equals the smallest node list.

    Breadth first: each round joins the frontier with the edges and keeps one smallest path a node, so a round never
    holds more rows than nodes.
    """
    links = edges.where(~F.col("verification_status").isin(*INACTIVE)) if "verification_status" in edges.columns else edges
    if relations:
        links = links.where(F.col("relation_type").isin(*relations))
    links = links.select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b")).where("a <> b")
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    seen = frontier.select("id")
    for _ in range(most if start != target else 0):
        new = frontier.join(links, frontier["id"] == links["a"]).groupBy("b").agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        frontier = written(new.withColumnRenamed("b", "id").join(seen, "id", "left_anti").select("id", "path"), "frontier")
        if not frontier.where(F.col("id") == target).isEmpty() or frontier.isEmpty():
            break
        seen = written(seen.unionByName(frontier.select("id")), "seen")
    hit = frontier.where(F.col("id") == target).select(F.lit(True).alias("found"), (F.size("path") - 1).alias("hops"), F.array_join("path", " > ").alias("path"))
    none = spark.createDataFrame([(False, None, None)], "found boolean, hops int, path string")
    return none.join(hit.select(F.lit(1).alias("_one")), F.lit(True), "left_anti").unionByName(hit)


def prerequisites(edges: DataFrame, include: str | None = None) -> DataFrame:
    """(a, b, id): a comes before b. DEPENDS_ON is turned round; inactive edges are left out but for an included one."""
    active = ~F.col("verification_status").isin(*INACTIVE)
    rows = edges.where((active | (F.col("id") == include)) if include else active)
    forward = rows.where("relation_type = 'PREREQUISITE_OF'").select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b"), "id")
    return forward.unionByName(rows.where("relation_type = 'DEPENDS_ON'").select(F.col("target_node_id").alias("a"), F.col("source_node_id").alias("b"), "id"))


def cyclic(links: DataFrame) -> DataFrame:
    """The rows of links(a, b, id) that lie on a cycle: those whose two ends lie in one strongly connected part, and loops."""
    parts = strong_parts(links)
    a, b = (parts.select(F.col("id").alias(end), F.col("part").alias(f"_{end}")) for end in "ab")
    return links.where("a <> b").join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("_a = _b").select(links.columns).unionByName(links.where("a = b"))


#: Links left after peeling that one task takes; more are taken in rounds of joins.
CORE_LINKS = 500_000


def strong_parts(links: DataFrame, core_links: int = CORE_LINKS) -> DataFrame:
    """(id, part) of the nodes that lie on cycles of links(a, b), by strongly connected part; part is its smallest node, or in rounds of joins its largest.

    Nodes that cannot lie on a cycle are peeled off first: those without an outgoing or an incoming link, until none is
    left. Up to core_links of what is left are walked in one task. Of more the largest node spreads forward along the links; of the nodes that took a node's name, those that reach
    it are its part. They are left out with their links, and what is left goes on. Rows never outnumber the links. Joins are merged:
    names compress so well that a small file of them would be broadcast, and fill the driver.
    """
    core = _peeled(links.where("a <> b").select("a", "b").distinct())
    if core.count() <= core_links:
        # Written: callers read the parts twice, and a walk costs its task once.
        return written(core.groupBy().applyInPandas(_walked, core.select(F.col("a").alias("id"), F.col("a").alias("part")).schema), "parts")
    done = core.select(F.col("a").alias("id"), F.col("a").alias("part")).limit(0)
    while not core.isEmpty():
        name = written(core.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("name", F.col("id")), "name")
        while True:
            sent = core.join(name.withColumnRenamed("id", "a").hint("merge"), "a").groupBy(F.col("b").alias("id")).agg(F.max("name").alias("_n"))
            new = written(name.join(sent.hint("merge"), "id", "left").select("id", F.greatest("name", F.coalesce("_n", "name")).alias("name"), (F.col("_n") > F.col("name")).alias("moved")), "name")
            name = new.select("id", "name")
            if new.where("moved").isEmpty():
                break
        a, b = (name.select(F.col("id").alias(end), F.col("name").alias(f"_{end}")) for end in "ab")
        inside = written(core.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("_a = _b").select("a", "b"), "inside")
        part = written(name.where("id = name"), "part")
        front = part
        while True:
            back = inside.join(front.select(F.col("id").alias("b"), "name").hint("merge"), "b").select(F.col("a").alias("id"), "name").distinct()
            front = written(back.join(part.select("id").hint("merge"), "id", "left_anti"), "front")
            if front.isEmpty():
                break
            part = written(part.unionByName(front), "part")
        done = written(done.unionByName(part.select("id", F.col("name").alias("part"))), "done")
        core = core.join(part.select(F.col("id").alias("a")).hint("merge"), "a", "left_anti").join(part.select(F.col("id").alias("b")).hint("merge"), "b", "left_anti").select("a", "b")
        core = _peeled(core)
    # A part of one node lies on no cycle.
    return done.join(done.groupBy("part").agg(F.count("*").alias("_n")).where("_n > 1").select("part").hint("merge"), "part", "left_semi").select("id", "part")


def _walked(core: pd.DataFrame) -> pd.DataFrame:
    """The strongly connected parts of two nodes and more: nodes in the order in which a walk along the links leaves them, then walks against the links in the reverse of that order.

    A part is named by its smallest node: rows come in any order, and a task that is run again must give the same names.
    """
    along, against = {}, {}
    for a, b in zip(core["a"], core["b"], strict=True):
        along.setdefault(a, []).append(b)
        against.setdefault(b, []).append(a)
    left, seen = [], set()
    for start in along:
        stack = [] if start in seen else [(start, iter(along[start]))]
        seen.add(start)
        while stack:
            node, ahead = stack[-1]
            new = next((x for x in ahead if x not in seen), None)
            if new is None:
                left.append(stack.pop()[0])
            else:
                seen.add(new)
                stack.append((new, iter(along.get(new, ()))))
    part: dict = {}
    for root in reversed(left):
        todo = [] if root in part else [root]
        while todo:
            node = todo.pop()
            part[node] = root
            todo += [x for x in against.get(node, ()) if x not in part]
            part |= dict.fromkeys(todo, root)
    members: dict = {}
    for n, root in part.items():
        members.setdefault(root, []).append(n)
    rows = [(n, low) for low, ns in ((min(ns), ns) for ns in members.values() if len(ns) > 1) for n in ns]
    return pd.DataFrame({"id": pd.Series([n for n, _ in rows], dtype=core["a"].dtype), "part": pd.Series([r for _, r in rows], dtype=core["a"].dtype)})


def _peeled(core: DataFrame) -> DataFrame:
    """Links that are left when those into a node without an outgoing link, or out of one without an incoming link, go until none does."""
    core = written(core, "core")
    size = core.count()
    while size:
        core = core.join(core.select(F.col("a").alias("b")).distinct().hint("merge"), "b", "left_semi").join(core.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_semi").select("a", "b")
        core = written(core, "core")
        left = core.count()
        if left == size:
            break
        size = left
    return core


def components(links: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id that undirected links(a, b) reach.

    Minimum labels spread along the links, and each label is then replaced by its own label, so rounds are few.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"), "label")
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("low")).withColumnRenamed("a", "id")
        new = label.join(near, "id").select("id", F.least("component", "low").alias("low"), F.col("component").alias("old"))
        jump = label.select(F.col("id").alias("low"), F.col("component").alias("far"))
        new = written(new.join(jump, "low", "left").select("id", F.least("low", "far").alias("component"), "old"), "label")
        label = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return label


def numbered_groups(parts: DataFrame, kind: str) -> DataFrame:
    """(group, type, id): the members of components as groups kind:1, kind:2, … in the order of their smallest node, a row a member.

    Components are numbered within ranges of their smallest nodes; what the ranges before hold is added.
    """
    ranges = parts.select("component").distinct().repartitionByRange("component").withColumn("_range", F.spark_partition_id())
    ranges = written(ranges, "ranges")
    before = ranges.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a task
    before = before.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbers = ranges.withColumn("_at", F.row_number().over(W.partitionBy("_range").orderBy("component"))).join(F.broadcast(before), "_range")
    numbers = numbers.select("component", F.concat(F.lit(f"{kind}:"), F.col("_before") + F.col("_at")).alias("group"))
    return parts.join(numbers, "component").select("group", F.lit(kind).alias("type"), "id")


def learning_order(concepts: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, frequency, wave, blocked) of concepts(id, frequency): waves in which all of needs(id, requires) are met before.

    A concept's wave is one more than the latest of what it requires. Concepts on a cycle, behind one, or that need what
    is not a concept never come: blocked, with a null wave. Inside a wave the order is by falling frequency, then id.

    Each pass takes out all concepts with one open need: chains of them shrink by doubled jumps to what they start from,
    and needs that lead into a chain become needs of its start, further off. Only concepts of several needs then wait for
    each other, so the rounds grow with the depth of these and with the logarithm of a chain. What was taken out follows
    from its chain's start, pass by pass backwards.
    """
    with scratch(concepts.sparkSession) as keep:
        keep.append(written(_learning_order(concepts, needs), "order"))
        return keep[0]


def _learning_order(concepts: DataFrame, needs: DataFrame) -> DataFrame:
    nodes = written(concepts.select("id", "frequency"), "concepts")
    open_ = written(needs.join(nodes.select("id"), "id", "left_semi").select("id", "requires", F.lit(1).alias("w")).distinct(), "needs")
    waves = written(nodes.select("id").join(open_.select("id"), "id", "left_anti").select("id", F.lit(1).alias("wave")), "waves")
    rounds, taken = nodes.count().bit_length() + 1, []
    while True:
        single = written(open_.groupBy("id").agg(F.count("*").alias("n"), F.first("requires").alias("start"), F.first("w").alias("w")).where("n = 1").drop("n"), "single")
        chains = _chained(single, rounds)
        taken.append(chains)
        rest = open_.join(single.select("id"), "id", "left_anti").join(chains.select(F.col("id").alias("requires"), "start", F.col("w").alias("more")), "requires", "left")
        rest = rest.groupBy("id", F.coalesce("start", "requires").alias("requires")).agg(F.max(F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
        rest = written(rest.join(waves.select(F.col("id").alias("requires"), "wave"), "requires", "left"), "needs")
        ready = written(rest.groupBy("id").agg(F.max(F.col("wave") + F.col("w")).alias("wave"), F.count("wave").alias("met"), F.count("*").alias("n")).where("met = n").select("id", "wave"), "ready")
        if ready.isEmpty() and single.isEmpty():
            break
        waves = waves.unionByName(ready)
        open_ = rest.join(ready.select("id"), "id", "left_anti").select("id", "requires", "w")
    for chains in reversed(taken):
        more = chains.join(waves.select(F.col("id").alias("start"), "wave"), "start").select("id", (F.col("wave") + F.col("w")).alias("wave"))
        waves = written(waves.unionByName(more), "waves")
    return nodes.join(waves, "id", "left").select("id", "frequency", F.col("wave").cast("int").alias("wave"), F.col("wave").isNull().alias("blocked"))


def _chained(links: DataFrame, rounds: int) -> DataFrame:
    """links(id, start, w), one a node: each led to where its chain starts, weights added; chains that run in circles are left out."""
    for _ in range(rounds):
        back = links.select(F.col("id").alias("start"), F.col("start").alias("before"), F.col("w").alias("more"))
        led = written(links.join(back, "start", "left").select("id", F.coalesce("before", "start").alias("start"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.col("before").isNotNull().alias("moved")), "chains")
        links = led.select("id", "start", "w")
        if led.where("moved").isEmpty():
            return links
    return led.where("not moved").select("id", "start", "w")


#: (source, node) rows that betweenness holds at a time; sources are dealt out in batches of about so many rows.
SOURCE_ROWS = 50_000_000


def betweenness(links: DataFrame, rows: int = SOURCE_ROWS) -> DataFrame:
    """(id, score): undirected, halved, unnormalised betweenness by component. Loops and repeated links add nothing.

    Level by level for a batch of sources at once: (source, node, paths) rows reach their neighbours by a join with the
    links; those of this level and the one before are known, and a node's new neighbours are the next level. Dependencies
    run back over the same levels. So no task holds a component, rows of a hub's links are those of a join key, and a
    batch takes as many rounds as the longest shortest path.
    """
    with scratch(links.sparkSession) as keep:
        near = links.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next")))).alias("l")).select("l.*").distinct()
        near = written(near, "near")
        nodes = written(near.select(F.col("node").alias("id")).distinct(), "nodes")
        n = nodes.count()
        batches = max(1, -(-n * n // rows))
        score = nodes.select("id", F.lit(0.0).alias("score"))
        for k in range(min(batches, n) if n else 0):
            with scratch(links.sparkSession) as made:
                part = _dependencies(near, nodes.where(F.pmod(F.xxhash64("id"), F.lit(min(batches, n))) == k))
                made.append(written(score.unionByName(part).groupBy("id").agg(F.sum("score").alias("score")), "score"))
            discard(score)
            score = made[0]
        keep.append(score if n else written(score, "score"))
        return keep[0]


def _dependencies(near: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, score): half of what shortest paths from these sources depend on each node."""
    levels = [written(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("paths")), "level")]
    while True:
        reached = levels[-1].join(near, "node").groupBy("source", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
        for known in levels[-2:]:
            reached = reached.join(known.select("source", "node"), ["source", "node"], "left_anti")
        reached = written(reached, "level")
        if reached.isEmpty():
            break
        levels.append(reached)
    depend = levels[-1].select("source", "node", F.lit(0.0).alias("depend"))
    parts = []
    for here, before in zip(levels[:0:-1], levels[-2::-1], strict=True):
        back = here.join(depend, ["source", "node"]).join(near, "node").groupBy("source", F.col("next").alias("node")).agg(F.sum((1 + F.col("depend")) / F.col("paths")).alias("share"))
        parts.append(depend.groupBy("node").agg(F.sum("depend").alias("score")))
        depend = written(before.join(back, ["source", "node"], "left").select("source", "node", F.coalesce(F.col("paths") * F.col("share"), F.lit(0.0)).alias("depend")), "depend")
    return reduce(DataFrame.unionByName, parts).groupBy(F.col("node").alias("id")).agg((F.sum("score") / 2).alias("score"))


def resolved(aliases: DataFrame) -> DataFrame:
    """(alias, id): where chains of aliases(alias, id) end; a chain that runs into a cycle ends where it enters it, and an alias on a cycle at itself.

    Pointer jumping: after as many rounds as the number of aliases has binary digits, chains that still have not ended
    point into cycles, at every alias of these; their links are then left out and the jumps done once more.
    """
    links = written(aliases.select("alias", "id").where("alias <> id"), "aliases")
    now, open_ = _jumped(links, max(1, links.count()).bit_length())
    if not open_.isEmpty():
        loop = written(open_.select(F.col("id").alias("alias")).distinct(), "loop")
        now, _ = _jumped(links.join(loop, "alias", "left_anti"), 64)
        now = now.unionByName(loop.select("alias", F.col("alias").alias("id")))
    return now


def _jumped(links: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """links(alias, id) after so many rounds of doubled jumps, fewer if all have ended; and those that have not."""
    now = links
    for _ in range(rounds + 1):
        far = now.select(F.col("alias").alias("id"), F.col("id").alias("far"))
        new = written(now.join(far, "id", "left").select("alias", F.coalesce("far", "id").alias("id"), F.col("far").isNotNull().alias("open")), "aliases")
        now, open_ = new.select("alias", "id"), new.where("open")
        if open_.isEmpty():
            return now, open_
    return now, now.join(links.select(F.col("alias").alias("id")), "id", "left_semi")


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at each node."""
    return edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """Edges by (source, target, type) without loops: the first weight by position, the evidence of all without repeats, in order.

    Repeated evidence of a key is dropped before it is gathered, so that a row holds what is different only.
    """
    key = ["source", "target", "type"]
    rows = edges.where("source <> target")
    first = rows.groupBy(*key).agg(F.min_by("weight", "position").alias("weight"))
    each = rows.select(*key, "position", F.posexplode("evidence").alias("_at", "_e")).groupBy(*key, "_e").agg(F.min(F.struct("position", "_at")).alias("_o"))
    each = each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_e"))), lambda x: x["_e"]).alias("evidence"))
    return first.join(each, key, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(each.schema["evidence"].dataType)))


def evidence_bundle(nodes: DataFrame, evidence: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per node its anchors in page order, each with whether the node's provenance names it."""
    rows = evidence.join(nodes.select(F.col("id").alias("supports_object_id"), "provenance"), "supports_object_id").join(anchors.withColumnRenamed("id", "anchor_id"), "anchor_id")
    item = F.struct("page_number", "anchor_id", "text", F.array_contains("provenance", F.col("anchor_id")).alias("named"))
    return rows.groupBy(F.col("supports_object_id").alias("node_id")).agg(F.array_sort(F.collect_list(item)).alias("anchors"))


def anchor_nodes(evidence: DataFrame, anchor: str) -> DataFrame:
    """The distinct nodes that an anchor supports."""
    return evidence.where(F.col("anchor_id") == anchor).select(F.col("supports_object_id").alias("node_id")).distinct()


def anchor_notation(notes: Column, start: Column, end: Column) -> Column:
    """A span's notes inside an anchor's range, counted from the anchor's start."""
    inside = F.filter(notes, lambda n: (start <= n["start_char"]) & (n["end_char"] <= end))
    return F.transform(inside, lambda n: n.withField("start_char", n["start_char"] - start).withField("end_char", n["end_char"] - start))


def related(edges: DataFrame, outgoing: dict[str, tuple[str, ...]] = {}, incoming: dict[str, tuple[str, ...]] = {}) -> DataFrame:  # noqa: B006
    """Per node one sorted set a name: the other ends of its active edges of the named relations, by direction; one pass."""
    active = edges.where(~F.col("verification_status").isin(*INACTIVE))
    ends = [("out", F.col("source_node_id"), F.col("target_node_id")), ("in", F.col("target_node_id"), F.col("source_node_id"))]
    rows = active.select("relation_type", F.explode(F.array(*(F.struct(F.lit(d).alias("way"), n.alias("id"), o.alias("other")) for d, n, o in ends))).alias("e")).select("relation_type", "e.*")
    sets = [(name, way, rel) for way, names in (("out", outgoing), ("in", incoming)) for name, rel in names.items()]
    return rows.groupBy("id").agg(*(F.array_sort(F.collect_set(F.when((F.col("way") == way) & F.col("relation_type").isin(*rel), F.col("other")))).alias(name) for name, way, rel in sets))


def preferred(nodes: DataFrame, requested: str | None, selected: str | None) -> DataFrame:
    """The one node to show: the requested, else the selected, else the first that is no PAPER, else the first."""
    rank = F.when(F.col("id") == (requested or ""), 0).when(F.col("id") == (selected or ""), 1).when(F.col("type") != "PAPER", 2).otherwise(3)
    return nodes.withColumn("_rank", rank).orderBy("_rank", "id").limit(1).drop("_rank")


def restored(nodes: DataFrame, edges: DataFrame, selected: str, limit: int, around: int = 120) -> DataFrame:
    """The first `limit` nodes of a view (id, created_at, type), and a selected node that the limit cut off with its neighbours."""
    shown = top_nodes(nodes, limit).select("id")
    near = neighborhood(edges, selected, 1, around).select("id")
    return shown.unionByName(near.join(shown.where(F.col("id") == selected).select(F.lit(1).alias("_in")), F.lit(True), "left_anti")).distinct()


def tentative(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """Adds tentative: a candidate, or a node whose review is not current; current(id, current) covers reviewed nodes."""
    return nodes.join(current, "id", "left").withColumn("tentative", (F.col("verification_status") == "CANDIDATE") | ~F.coalesce("current", F.lit(True))).drop("current")
