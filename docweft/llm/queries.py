"""The operators as registered queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard_join, language, lattice, licenses, merkle, mixing, pieces, secrets, spelling, toxicity, url_filter
from .common import give_back

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = language.labelled_sample(docs.where(fold("doc_id", 4) != 2), "doc_id", "text", "lang")
    out = language.identify(docs, train)
    return out.select(F.col("doc").alias("doc_id"), F.coalesce(fold("doc", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), TOKENIZER).withColumnRenamed("doc", "doc_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.assign(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def toxicity_machine(docs: DataFrame, labels: DataFrame) -> toxicity.Machine:
    """Learned from labels whose crc32(doc_id) mod 3 is not 1."""
    machine = toxicity.train(*toxicity.labelled_sample(docs, labels.where(fold("doc_id", 3) != 1), "doc_id", "text", "toxic"))
    give_back()  # training is over, but the driver's process stays
    return machine


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity_machine(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("doc").alias("doc_id"), F.coalesce(fold("doc", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lattice.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    counts = [secrets.count("base", k).alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select(F.col("doc").alias("doc_id"), *counts, F.sha2(secrets.named("base"), 256).alias("base_sha256"), secrets.named("spans").alias("spans"), *[f"n_{prefix}{name}" for prefix, name in secrets.STANDINGS])


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_documents(table(spark, sf_dir, "documents"), PIECE_MODEL, end=True).withColumnRenamed("doc", "doc_id")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = {"n_chars": F.try_add(F.col("n_chars"), F.lit(1))}
    out = merkle.verify(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", changes, fold("doc_id", 7) == 0)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_mixing, op3_jaccard_join, op4_license_scan, op5_url_filter, op6_bpe, op7_exact_dedup, op8_toxicity, op9_lattice_dedup, op10_secret_scan, op11_pieces, op12_spelling, op13_merkle)}

#: crc32 in SQL: its table, made of the polynomial, and the value of a column of bytes.
CRC_TABLE = """
        crc_table as (select list(c order by i) as crc_table from (
            select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),"""
CRC = "xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])), 4294967295)"


def _bytes(text: str) -> str:
    return f"list_transform(range(1, 2 * strlen({text}), 2), lambda k: ('0x' || substr(hex({text}), k, 2))::bigint)"


def _levels(name: str, leaves: str) -> str:
    """A table of all nodes over leaves(tree, place, hash, n)."""
    return f"""
        {name} as (
            select tree, 0 as level, place, hash, n from {leaves}
            union all
            select tree, level + 1, place // 2, sha256(string_agg(hash, '' order by place)), (any_value(n) + 1) // 2 from {name} where n > 1 group by tree, level, place // 2),"""


ORACLES = {
    "op7_exact_dedup": r"""
        with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
        from t window w as (partition by text_sha256)""",
    "op12_spelling": "with" + CRC_TABLE + r"""
        runs as (
            select coalesce(cast(doc_id as varchar), '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
        counted as (select id, run, count(*) as n from runs group by all),
        bytes as (select *, """ + _bytes("id || ':' || run") + r""" as b from counted),
        hashed as (select run, n, """ + CRC + r""" as h from bytes, crc_table),
        words as (
            select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, cast(sum(n) as bigint) as n
            from hashed group by 1 having length(word) >= 7 and sum(n) >= 2),
        cut as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from words)),
        near as (
            select a.word, a.n, b.word as near, b.n as near_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
            union select a.word, a.n, b.word, b.n from cut a join words b on a.rest = b.word
            union select b.word, b.n, a.word, a.n from cut a join words b on a.rest = b.word),
        best as (select word, count(*) as n_near, arg_min(near, struct_pack(x := -near_n, y := hex(near))) as near, max(near_n) as near_n from near group by word),
        forms as (select w.word, case when near_n >= 10 * n then near end as form, n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * n then near_n end as form_n from words w left join best b on w.word = b.word),
        steps as (with recursive s as (
            select word, word as root, 0 as step from words
            union all select s.word, f.form, step + 1 from s join forms f on f.word = s.root where f.form is not null) select word, arg_max(root, step) as root from s group by word)
        select word, form, root, n, n_near, form_n from forms join steps using (word)""",
    "op13_merkle": "with recursive" + CRC_TABLE + r"""
        marked as (
            select *, """ + _bytes("doc_id::varchar") + r""" as b from documents),
        hashes as (
            select doc_id, coalesce('=' || lang, '') as tree, [n_chars, case when h % 7 = 0 then n_chars + 1 else n_chars end] as counts,
                list_transform(counts, lambda c: sha256(array_to_string(list_transform([doc_id::varchar, source, lang, c::varchar, text], lambda x: case when x is null then '-' else strlen(x) || ':' || x end), ''))) as h2
            from (select *, """ + CRC + r""" as h from marked, crc_table)),
        leaves as (select doc_id, tree, h2[1] as hash, h2[2] as folded, row_number() over (partition by tree order by doc_id) - 1 as place, count(*) over (partition by tree) as n from hashes),""" + _levels("nodes", "leaves") + r"""
        subroots as (select tree, hash, row_number() over (order by tree) - 1 as place, count(*) over () as n from nodes where n = 1),
        top_leaves as (select '' as tree, place, hash, n from subroots),""" + _levels("tops", "top_leaves") + r"""
        sides as (
            select a.tree, a.level, a.place, case when b.hash is null then '' when b.place < a.place then '<' || b.hash else '>' || b.hash end as step
            from nodes a left join nodes b on a.tree = b.tree and a.level = b.level and b.place = xor(a.place, 1) where a.n > 1),
        top_sides as (
            select a.level, a.place, case when b.hash is null then '' when b.place < a.place then '<' || b.hash else '>' || b.hash end as step
            from tops a left join tops b on a.level = b.level and b.place = xor(a.place, 1) where a.n > 1),
        steps as (
            select doc_id, level, step from leaves l join sides s on s.tree = l.tree and s.place = l.place >> s.level
            union all select doc_id, 1000 + level, step from leaves l join subroots r using (tree) join top_sides s on s.place = r.place >> s.level),
        ways as (select doc_id, list(step order by level) as way, sha256(string_agg(substr(step, 2), '' order by level)) as proof_sha256 from steps group by doc_id),
        found as (
            select doc_id, l.hash as leaf, r.hash as subroot, (select hash from tops where n = 1) as root, coalesce(proof_sha256, sha256('')) as proof_sha256,
                list_reduce(list_concat([folded], coalesce(way, [])), lambda h, s: sha256(case when s[1] = '<' then substr(s, 2) || h else h || substr(s, 2) end)) as folded_root
            from leaves l join subroots r using (tree) left join ways using (doc_id))
        select *, folded_root = root as verified from found""",
}
