"""The pipeline's stages against brute force, and its guard."""

import importlib
import sys

from pyspark.sql import functions as F
from test_exact_dedup_mixing import brute_mix, norm
from test_pairs import brute as classes_of

import corpus_pipeline
from docweft.llm import mixing, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    seen = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, SF).cache()
        outs.append(seen)
    assert all(o.columns == docs.columns for o in outs[:-1])
    machine = queries.toxicity_machine(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    text = {r.doc_id: r.text for r in docs.collect()}
    bad = {i for i, d in zip(text, machine.worst([*text.values()]), strict=True) if machine.score(d) >= toxicity.THRESHOLD}
    clean = {r.doc_id for r in outs[0].collect()}
    assert clean == set(text) - bad
    first = {}
    for i in sorted(clean):
        first.setdefault(norm(text[i]), i)
    unique = {r.doc_id for r in outs[1].collect()}
    assert unique == set(first.values())
    single = {r.doc_id for r in outs[2].collect()}
    assert single == {i for i, c, _ in classes_of([(i, text[i]) for i in unique]) if i == c}
    assert rows_of_mix(outs[3]) == mix_by_brute_force(spark, outs[2], text)
    assert outs[4].count() == outs[3].count() and outs[4].where(F.length("ids") != 4 * F.col("n_tokens")).count() == 0
    want = {r.h for r in outs[3].select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()}
    assert {r.decoded_sha256 for r in outs[4].collect()} == want
    key = lambda df: sorted(map(str, df.select("doc_id", "source", "n_tokens", "decoded_sha256").collect()))
    assert key(corpus_pipeline.run(spark, SF)) == key(outs[4])


def rows_of_mix(df):
    return sorted((r.doc_id, (r.text or "").split(), r.n_chars == (None if r.text is None else len(r.text))) for r in df.collect())


def mix_by_brute_force(spark, docs, text):
    """Rows of the mixing stage: the blocks that brute_mix's shards draw of each document, a row for each shard and pass; texts without words as they are."""
    want, goal = brute_mix(spark, docs)
    shown, step = {}, mixing.BLOCK_WORDS
    for (doc, p, block), (shard, _) in sorted(want.items()):
        shown.setdefault((shard, doc, p), []).append(block)
    rows = [(doc, [w for b in blocks for w in text[doc].split()[b * step : (b + 1) * step]], True) for (_, doc, _), blocks in shown.items()]
    size = {}
    for r in docs.select("doc_id", "source").collect():
        size[r.source] = size.get(r.source, 0) + len((text[r.doc_id] or "").split())
    return sorted(rows + [(r.doc_id, [], True) for r in docs.select("doc_id", "source").collect() if not (text[r.doc_id] or "").split() and (goal[r.source] >= size[r.source])])


def test_odd_rows(spark):
    """Nulls in every column, empty, very long and repeated texts, repeated ids, clashing columns, and no rows: what each stage keeps."""
    far = "w " * 40_000
    rows = [(1, None, None, None, None, "k"), (None, "some words here", "en", "s", 3, "k"), (2, "", "en", "s", 0, "k"), (2, "", "en", "s", 0, "k"), (3, far, "en", None, 80_000, "k"), (4, "some  words\there", "en", "s", 3, "k"), (5, "a b c d e f g h i j k", "en", "t", 9, "k"), (6, "a b c d e f g h i j K", "en", "t", 9, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cut string")
    kept, seen = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF)
        assert seen.columns == docs.columns
        kept.append(sorted((r.doc_id is None, r.doc_id or 0) for r in seen.collect()))
    ids = lambda *xs: sorted((x is None, x or 0) for x in xs)
    assert kept[0] == ids(1, None, 2, 2, 3, 4, 5, 6)
    assert kept[1] == ids(1, 3, 4, 5, 6)
    assert kept[2] == ids(1, 3, 4, 5)
    # 40,014 words, nearly all of the null source, whose target is all but what the others may have; texts stay whole or in blocks.
    words = {}
    for r in seen.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    assert words.get(4, 0) in (0, 3, 6, 9) and words.get(5, 0) % 11 == 0 and words.get(5, 0) <= 33 and words[3] <= 120_000
    assert abs(words[3] - (40_014 - 9 - 33)) <= mixing.BLOCK_WORDS
    tokens = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert tokens.count() == seen.count()
    seen = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, SF)
        assert seen.collect() == []


def test_entry_without_these_folders(monkeypatch):
    """The entry module imports, and keeps the engine's queries, when llm and the pipeline are gone."""
    for name in [m for m in sys.modules if m.startswith(("docweft.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    import docweft

    monkeypatch.delattr(docweft, "llm", raising=False)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("docweft.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() and not any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in entry.queries())
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)
