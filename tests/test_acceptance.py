"""Requests in order: who comes first wins, cycles, endpoints, versions, audits."""

import random

from docweft.operators import acceptance

NODE = "id string, paper_id string, type string, epistemic_status string, text string, provenance array<string>, version int, verification_status string"
EDGE = "id string, paper_id string, source_node_id string, target_node_id string, relation_type string, provenance array<string>, version int, verification_status string"
REQUEST = "paper_id string, place long, op string, object_id string, kind string, source_node_id string, target_node_id string, relation_type string, provenance array<string>, source_hash string, expected_version int, decision string, scope string"


def edge(place, name, a, b, relation="PREREQUISITE_OF", paper="p"):
    return (paper, place, "edge", name, None, a, b, relation, ["a1"], None, None, None, None)


def review(place, name, kind, version, decision="VERIFIED", scope="SCIENTIFIC_VALIDITY", source="h", paper="p"):
    return (paper, place, "review", name, kind, None, None, None, None, source, version, decision, scope)


def run(spark, requests, edges=(), types=None):
    nodes = [(f"n{i}", "p", (types or {}).get(i, "METHOD"), "AUTHOR_CLAIM" if i < 5 else "UNVERIFIED", f"text {i}", ["a1"] if i != 9 else [], 1, "CANDIDATE") for i in range(10)]
    df = spark.createDataFrame(requests, REQUEST).repartition(3)
    found = acceptance.outcomes(df, spark.createDataFrame([("p", "h"), ("q", "h")], "id string, source_hash string"), spark.createDataFrame(nodes, NODE), spark.createDataFrame([*edges], EDGE), spark.createDataFrame([("a1", "has text 1 and text 2")], "id string, text string"))
    return {r.place: r.reason or r.new_version for r in found.collect()}, acceptance.audits(found, df)


def test_two_that_close_a_cycle_only_together(spark):
    """The first is accepted, the second refused; once the first is rejected, the second may come, and then the first may not be verified."""
    got, _ = run(spark, [
        edge(1, "e1", "n0", "n1"), edge(2, "e2", "n0", "n1", "DEPENDS_ON"), edge(3, "e3", "n1", "n2"), edge(4, "e4", "n2", "n0"), edge(5, "e5", "n2", "n0", "USES"),
        review(6, "e1", "edge", 1, "REJECTED"), edge(7, "e7", "n2", "n0"), review(8, "e1", "edge", 2), review(9, "e7", "edge", 1, "DISPUTED"), review(10, "e1", "edge", 2), edge(12, "e1", "n5", "n6"), edge(11, "e11", "n5", "n5"),
    ])
    cycle = "Prerequisites would form a cycle"
    assert got == {1: 1, 2: cycle, 3: 1, 4: cycle, 5: 1, 6: 2, 7: 1, 8: "Review cannot accept prerequisite cycles", 9: 2, 10: 3, 11: "Self relations are not permitted", 12: "Id is taken"}


def test_first_review_of_a_version_wins(spark):
    got, audits = run(spark, [review(1, "n1", "node", 1), review(2, "n1", "node", 1, "REJECTED"), review(3, "n1", "node", 2, "DISPUTED"), review(4, "n1", "node", 3, source="old"), review(5, "n8", "node", 2), review(6, "no", "node", 1), review(7, "n9", "node", 1), review(8, "n7", "node", None)])
    stale = "Stale source hash or object version"
    assert got == {1: 2, 2: stale, 3: 3, 4: stale, 5: stale, 6: "Object not found", 7: "Verification needs evidence", 8: stale}
    assert [(r.place, r.object_id, r.object_version, r.decision) for r in audits.orderBy("place").collect()] == [(1, "n1", 1, "VERIFIED"), (3, "n1", 2, "DISPUTED")]


def test_endpoints_and_scopes(spark):
    """An edge is verified only while both its ends are active; attribution only of nodes whose text their anchor has."""
    got, _ = run(spark, [
        edge(1, "e", "n1", "n2", "USES"), review(2, "n2", "node", 1, "DISPUTED"), review(3, "e", "edge", 1), review(4, "n2", "node", 2), review(5, "e", "edge", 1), review(6, "n1", "node", 1, scope="SOURCE_ATTRIBUTION"),
        review(7, "n3", "node", 1, scope="SOURCE_ATTRIBUTION"), review(8, "n7", "node", 1, scope="SOURCE_ATTRIBUTION"), review(9, "e", "edge", 2, scope="SOURCE_ATTRIBUTION"), review(10, "n0", "node", 1), edge(11, "x", "n1", "n2", paper="q"),
    ], types={0: "PAPER"})
    literal = "Source review verifies literal attribution only"
    assert got == {1: 1, 2: 2, 3: "An end of the relationship is disputed, rejected or stale", 4: 3, 5: 2, 6: 2, 7: literal, 8: literal, 9: literal, 10: "Paper identity is not a claim", 11: "Invalid or foreign-paper edge endpoints"}


def test_a_stored_cycle_blocks_until_it_is_broken(spark):
    stored = [("s1", "p", "n1", "n2", "PREREQUISITE_OF", ["a1"], 1, "SUPPORTED"), ("s2", "p", "n2", "n1", "PREREQUISITE_OF", ["a1"], 1, "SUPPORTED")]
    got, _ = run(spark, [edge(1, "e1", "n5", "n6"), review(2, "s1", "edge", 1, "REJECTED"), edge(3, "e3", "n5", "n6"), edge(4, "e4", "n1", "n2"), edge(5, "e3", "n5", "n6")], stored)
    assert got == {1: "Prerequisites would form a cycle", 2: 2, 3: 1, 4: "Prerequisites would form a cycle", 5: "Id is taken"}


def test_order_is_maintained():
    """Links that come and go, against a search of the whole graph."""
    rng = random.Random(1)
    for _ in range(30):
        order, links = acceptance.Order(), []
        for _ in range(120):
            if links and rng.random() < 0.25:
                order.remove(*links.pop(rng.randrange(len(links))))
                continue
            a, b = rng.choice("abcdefghijk"), rng.choice("abcdefghijk")
            ahead, ends = {b}, [b]
            while ends:
                n = ends.pop()
                for x, y in links:
                    if x == n and y not in ahead:
                        ahead.add(y)
                        ends.append(y)
            assert order.add(a, b) == (a not in ahead)
            if a not in ahead:
                links.append((a, b))
            assert all(order.place[x] < order.place[y] for x, y in links)


def test_empty(spark):
    assert run(spark, [])[0] == {}


def test_edges_that_nothing_names_again_are_not_kept():
    """A log of 3,000 edges with ids of their own leaves nodes and links only; the links still close cycles, and ids named again are taken."""
    paper = acceptance.Paper()
    row = lambda i, a, b, again=False: {"op": "edge", "object_id": f"e{i}", "fault": None, "relation_type": "PREREQUISITE_OF", "source_node_id": a, "target_node_id": b, "again": again}
    assert all(paper.judge(row(i, "n1", f"n{2 + i % 3}")) == (None, 1) for i in range(3000)) and len(paper.objects) == 0
    assert paper.judge(row(3000, "n3", "n1"))[0] == "Prerequisites would form a cycle"
    assert paper.judge(row(3001, "n5", "n6", True)) == (None, 1) and paper.judge(row(3001, "n5", "n6", True))[0] == "Id is taken"


def test_ids_named_again_without_a_value(spark):
    got, _ = run(spark, [edge(1, None, "n1", "n2"), edge(2, None, "n3", "n4"), edge(3, "x", "n2", "n1")], [("x", "p", "n7", "n8", "USES", ["a1"], 1, "SUPPORTED")])
    assert got == {1: 1, 2: "Id is taken", 3: "Id is taken"}
