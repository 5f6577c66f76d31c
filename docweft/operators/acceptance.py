"""Edge and review requests in the order of a log, each judged against what the earlier ones left.

A paper's log is serial: a review counts for the version that it has seen, so the first review of a version wins and later
ones conflict; an edge is refused only if it closes a cycle with those accepted before it; a relationship is verified only
while both its ends are active and its prerequisites form no cycle. What does not depend on the order is judged by joins
first. Then each paper's state and log stream through one task, sorted, papers side by side in others: what the task
holds is the paper's nodes, the different links that order them, and the edges that more than one request names (or a
request and the stored edges), however long the log is. The order of prerequisites is maintained, not computed anew: a new
link moves only the nodes that lie between its ends.

Defined results: requests with equal places count in the order of their object's id. A request of an unknown paper is
refused. While stored edges already form a cycle, no edge is accepted or verified until a review breaks it. Null
decisions and versions are stale. Empty tables give an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import INACTIVE
from .integrity import edge_faults, literal_nodes

OUTCOME = "paper_id string, place long, op string, object_id string, accepted boolean, reason string, new_version long"
BEFORE = {"PREREQUISITE_OF": False, "DEPENDS_ON": True}


class Order:
    """A topological order under links that come and go; `add` refuses a link that closes a cycle."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.after: dict[str, Counter] = {}
        self.before: dict[str, Counter] = {}

    def _reached(self, start: str, links: dict[str, Counter], inside) -> set[str]:
        seen, ends = {start}, [start]
        while ends:
            for n in links.get(ends.pop(), ()):
                if n not in seen and inside(self.place[n]):
                    seen.add(n)
                    ends.append(n)
        return seen

    def add(self, a: str, b: str) -> bool:
        if a == b:
            return False
        for n in (a, b):
            self.place.setdefault(n, len(self.place))
        low, high = self.place[b], self.place[a]
        if low < high:
            ahead = self._reached(b, self.after, lambda p: p <= high)
            if a in ahead:
                return False
            moved = sorted(self._reached(a, self.before, lambda p: p >= low), key=self.place.get) + sorted(ahead, key=self.place.get)
            for n, p in zip(moved, sorted(map(self.place.get, moved)), strict=True):
                self.place[n] = p
        self.after.setdefault(a, Counter())[b] += 1
        self.before.setdefault(b, Counter())[a] += 1
        return True

    def remove(self, a: str, b: str) -> None:
        for links, x, y in ((self.after, a, b), (self.before, b, a)):
            links[x][y] -= 1
            if not links[x][y]:
                del links[x][y]


class Paper:
    """A paper's objects while its log is read."""

    def __init__(self) -> None:
        self.objects: dict[tuple[str, str], dict] = {}
        self.order, self.loops = Order(), []

    def put(self, row: dict) -> None:
        self.objects[row["kind"], row["object_id"]] = row
        self._count(row, row["status"] not in INACTIVE)

    def _link(self, row: dict) -> tuple[str, str] | None:
        turned = BEFORE.get(row["relation_type"]) if row["kind"] == "edge" else None
        return None if turned is None else (row["target_node_id"], row["source_node_id"]) if turned else (row["source_node_id"], row["target_node_id"])

    def _count(self, row: dict, active: bool) -> None:
        """Takes an edge's link into the order or out of it; links that close a cycle wait until another goes."""
        link = self._link(row)
        if link is None or active == row.get("counted", False):
            return
        row["counted"] = active
        if active:
            if not self.order.add(*link):
                self.loops.append(link)
        elif link in self.loops:
            self.loops.remove(link)
        else:
            self.order.remove(*link)
            self.loops = [x for x in self.loops if not self.order.add(*x)]

    def _closes(self, row: dict) -> bool:
        """Would there be a cycle with this edge?"""
        if self.loops or row.get("counted"):
            return bool(self.loops)
        link = self._link(row)
        if link is None:
            return False
        if not self.order.add(*link):
            return True
        self.order.remove(*link)
        return False

    def judge(self, row: dict) -> tuple[str | None, int | None]:
        """The reason against a request, or the object's new version."""
        if row["op"] == "edge":
            if ("edge", row["object_id"]) in self.objects:
                return "Id is taken", None
            if row["fault"]:
                return row["fault"], None
            row |= {"kind": "edge", "status": "CANDIDATE", "version": 1}
            if self._closes(row):
                return "Prerequisites would form a cycle", None
            if row["again"]:
                self.put(row)
            else:
                self._count(row, True)
            return None, 1
        found = self.objects.get((row["kind"], row["object_id"]))
        reason = self._against(row, found)
        if reason:
            return reason, None
        found["version"] += 1
        found["status"] = row["decision"]
        self._count(found, row["decision"] not in INACTIVE)
        return None, found["version"]

    def _against(self, row: dict, found: dict | None) -> str | None:
        if found is None:
            return "Object not found"
        if not row["fresh"] or row["version"] != found["version"] or row["decision"] is None:
            return "Stale source hash or object version"
        if not found["evidence"]:
            return "Verification needs evidence"
        if found["root"]:
            return "Paper identity is not a claim"
        if row["decision"] == "VERIFIED":
            if row["scope"] == "SOURCE_ATTRIBUTION" and not (found["kind"] == "node" and found["literal"]):
                return "Source review verifies literal attribution only"
            if found["kind"] == "edge":
                if self._closes(found):
                    return "Review cannot accept prerequisite cycles"
                ends = [self.objects.get(("node", found[end])) for end in ("source_node_id", "target_node_id")]
                if any(n is None or n["status"] in INACTIVE for n in ends):
                    return "An end of the relationship is disputed, rejected or stale"
        return None


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, paper = None, Paper()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["paper_id"] != current:
                current, paper = row["paper_id"], Paper()
            if row["op"] == "":
                if row["kind"] == "node" or row["again"]:
                    paper.put(row)
                else:
                    paper._count(row, row["status"] not in INACTIVE)
            else:
                reason, version = paper.judge(row)
                out.append((row["paper_id"], row["place"], row["op"], row["object_id"], reason is None, reason, version))
        columns = [*zip(*out, strict=True)] or [[]] * 7
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in OUTCOME.split(", ")])


def outcomes(requests: DataFrame, papers: DataFrame, nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(paper_id, place, op, object_id, accepted, reason, new_version) of every request.

    requests(paper_id, place, op, object_id, kind, source_node_id, target_node_id, relation_type, provenance, source_hash,
    expected_version, decision, scope); op: `edge` for a new edge (object_id is its id) or `review` of an object of a kind.
    """
    blank = {c: F.lit(None).cast(t) for c, t in (("source_node_id", "string"), ("target_node_id", "string"), ("relation_type", "string"), ("decision", "string"), ("scope", "string"), ("fault", "string"), ("fresh", "boolean"))}
    none = {"op": F.lit(""), "place": F.lit(None).cast("long")}
    literal = literal_nodes(nodes, anchors).select("id", F.lit(True).alias("literal"))
    n = nodes.join(literal, "id", "left").select("paper_id", F.col("id").alias("object_id"), F.lit("node").alias("kind"), F.col("version").cast("long").alias("version"), F.col("verification_status").alias("status"), (F.size("provenance") > 0).alias("evidence"), (F.col("type") == "PAPER").alias("root"), F.coalesce("literal", F.lit(False)).alias("literal"))
    e = edges.select("paper_id", F.col("id").alias("object_id"), F.lit("edge").alias("kind"), F.col("version").cast("long").alias("version"), F.col("verification_status").alias("status"), (F.size("provenance") > 0).alias("evidence"), F.lit(False).alias("root"), F.lit(False).alias("literal"), "source_node_id", "target_node_id", "relation_type")
    new = requests.where("op = 'edge'").select(F.concat_ws(":", "place", "object_id").alias("id"), "paper_id", "source_node_id", "target_node_id", "relation_type")
    faults = edge_faults(new, nodes).select(F.col("id").alias("_id"), "fault")
    r = requests.withColumn("_id", F.concat_ws(":", "place", "object_id")).join(faults, "_id", "left").join(papers.select(F.col("id").alias("paper_id"), F.col("source_hash").alias("_hash")), "paper_id", "left")
    r = r.select("paper_id", F.col("place").cast("long").alias("place"), "op", "object_id", "kind", F.col("expected_version").cast("long").alias("version"), F.lit(None).cast("string").alias("status"), (F.size("provenance") > 0).alias("evidence"), F.lit(False).alias("root"), F.lit(False).alias("literal"), "source_node_id", "target_node_id", "relation_type", "decision", "scope", "fault", F.coalesce(F.col("source_hash") == F.col("_hash"), F.lit(False)).alias("fresh"))
    # An edge that no other row names need not be kept when it has been judged; the ids that several rows name are found first.
    named = requests.where("op = 'edge'").select("paper_id", "object_id", F.lit(1).alias("_n")).unionByName(requests.where("op = 'review' and kind = 'edge'").select("paper_id", "object_id", F.lit(1).alias("_n")))
    named = named.unionByName(e.select("paper_id", "object_id", F.lit(1).alias("_n"))).groupBy("paper_id", "object_id").agg(F.sum("_n").alias("_n")).where("_n > 1").select("paper_id", "object_id", F.lit(True).alias("_again"))
    again = lambda df: df.join(named.hint("merge"), ["paper_id", "object_id"], "left").withColumn("again", F.coalesce("_again", F.col("paper_id").isNull() | F.col("object_id").isNull())).drop("_again")
    r, e, n = again(r), again(e), n.withColumn("again", F.lit(True))
    rows = r.unionByName(n.withColumns(blank | none)).unionByName(e.withColumns({c: v for c, v in blank.items() if c not in e.columns} | none))
    return rows.repartition("paper_id").sortWithinPartitions("paper_id", F.asc_nulls_first("place"), "kind", "object_id").mapInArrow(_judged, OUTCOME)


def audits(found: DataFrame, requests: DataFrame) -> DataFrame:
    """The rows of accepted reviews, with the version that they reviewed."""
    done = found.where("accepted and op = 'review'").select("paper_id", "place", "object_id", (F.col("new_version") - 1).alias("object_version"))
    return requests.join(done, ["paper_id", "place", "object_id"]).select("paper_id", "place", "object_id", F.col("kind").alias("object_kind"), "object_version", "decision", "scope", "source_hash")
