"""Large JSON files cut into items by byte ranges, against json itself."""

import json
import random

import pytest

from docweft.sources import json_items

ITEM = [{"a": 1}, {}, {"s": 'q"}{][\\'}, {"n": {"m": [{"x": "]"}, [1, {"y": "\\\""}]]}}, {"items": [{"items": []}]}, {"u": "é 你 🤖 }"}, {"t": "two\nlines"}]


def got(spark, path):
    rows = sorted((r.file, r.position, r.raw) for r in json_items.items(spark, str(path)).collect())
    return [raw for *_, raw in rows]


@pytest.mark.parametrize("most", ["300", "128m"])
def test_items_of_any_shape(spark, tmp_path, most):
    """Arrays and objects with the array at a key, on one line and on many, cut every 300 bytes or not at all."""
    rng = random.Random(8)
    files = {}
    for k in range(4):
        values = [rng.choice(ITEM) | {"id": i} for i in range(rng.randrange(1, 40))]
        body = values if k % 2 else {"version": "x[", "collections": [{"name": "c"}], "items": values, "after": [{"z": 1}]}
        path = tmp_path / f"f{k}.json"
        path.write_text(json.dumps(body, ensure_ascii=k % 3 == 0, indent=2 if k > 1 else None), encoding="utf-8")
        files[path] = values
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for path, values in files.items():
            assert [json.loads(x) for x in got(spark, path)] == values
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('[{"a": 1}, [1, [2]], "]"], [{"b": 2}]', ['{"a": 1}', '[1, [2]], "]"']), ("[]", []), ("{}", []), ("", []), ('{"items": []}', []), ('{"other": [{"a": 1}]}', []), ('[1, {"a": 1}, "x{", {"b": 2}, null, [3]]', ["1", '{"a": 1}', '"x{"', '{"b": 2}', "null, [3]"]),
        ('[{"a": 1}, {"b": 2', ['{"a": 1}', '{"b": 2']), ('[{"a": 1}, {"b": {"c": 1}', ['{"a": 1}', '{"b": {"c": 1}']), (' \n[ {"a":1}\n,\n{"b":2} ] ', ['{"a":1}', '{"b":2}']), ('{"items":[{"a":1}]}', ['{"a":1}']),
    ],
)
def test_odd_files(spark, tmp_path, text, want):
    (tmp_path / "x.json").write_text(text)
    assert got(spark, tmp_path / "x.json") == want
