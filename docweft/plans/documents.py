"""Queries over documents, pages, conversations and benchmark: blocks, sentences, cues, search, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as tx
from ..operators import evaluate, extract, layout, search, segments
from ..session import table
from ..sources import store
from .registry import query

FLAT = r"trim(regexp_replace({}, '[\t\n\x0B\f\r ]+', ' ', 'g'))"
LINES = "lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as ord from documents)"
#: Cues for the invented prose, whose sentences have none of the literature's.
LOCAL_CUES = (
    ("DEFINITION", r"\b(password|token) ?=", False, False),
    ("LIMITATION", r"\b(worthless|trash|pathetic)\b", False, False),
    ("METHOD", r"\b(licensed|released) under\b", True, False),
    ("RESULT", r"\bthe (the|of|and|in)\b", True, False),
    ("CLAIM", r"(^| )(und|der) (die|das)( |$)|(^| )les? (la|de)( |$)", True, False),
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("select sha256(text) as source_hash, min(doc_id) as first, count(*) as copies from documents group by 1")
def doc_dedup_by_hash(spark, sf_dir):
    return store.distinct_contents(documents(spark, sf_dir), "doc_id", "text")


UUID5 = """(select h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || format('{:02x}', ((('0x' || h[17:18])::int) & 63) | 128) || h[19:20] || '-' || h[21:32]
    from (select sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(k)) as h))"""


@query(f"select doc_id, {UUID5} as paper_id from (select doc_id, 'docweft:' || doc_id || ':paper' as k from documents)")
def stable_ids(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", ids.row_id(F.col("doc_id"), "paper").alias("paper_id"))


@query(f"""with {LINES} select doc_id, (ord // 20 + 1)::int as page, count(*) as spans, sum(length(line))::bigint as chars, md5(string_agg(line, chr(10) order by ord)) as digest from lines group by 1, 2""")
def document_outline(spark, sf_dir):
    pages = layout.outline(layout.blocks_of_text(documents(spark, sf_dir))).select("doc_id", F.explode("pages").alias("p"))
    texts = F.transform("p.blocks", lambda b: b["text"])
    chars = F.aggregate(texts, F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    return pages.select("doc_id", "p.page", F.size(texts).cast("long").alias("spans"), chars.alias("chars"), F.md5(F.array_join(texts, "\n")).alias("digest"))


@query(f"""with {LINES}, n as (select distinct doc_id, lower({FLAT.format("line")}) as norm from lines where length(line) < 180)
    select norm, count(*) as n from n where norm <> '' group by 1 having count(*) >= 2""")
def running_lines(spark, sf_dir):
    return layout.running_lines(layout.blocks_of_text(documents(spark, sf_dir)))


@query(r"""select page_id, len(regexp_extract_all(html, '<h[1-6]\b')) as headings, len(regexp_extract_all(html, '<p\b')) as paragraphs, len(regexp_extract_all(html, '<(nav|header|footer)\b')) as margins,
    regexp_extract(html, '<h1[^>]*>([^<]*)', 1) as title from pages""")
def html_block_counts(spark, sf_dir):
    html = F.col("html")
    n = lambda p: F.regexp_count(html, F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n(r"<h[1-6]\b").alias("headings"), n(r"<p\b").alias("paragraphs"), n(r"<(nav|header|footer)\b").alias("margins"), F.regexp_extract(html, r"<h1[^>]*>([^<]*)", 1).alias("title"))


@query(f"""with {LINES}, s as (select doc_id, length(line) as size, sum(length(line))::bigint as weight from lines where length(line) >= 35 group by 1, 2)
    select doc_id, size::int as size, weight from (select *, row_number() over (partition by doc_id order by weight desc, size) as n from s) where n = 1""")
def modal_block_length(spark, sf_dir):
    rows = layout.blocks_of_text(documents(spark, sf_dir)).withColumn("size", F.length("text")).where("size >= 35")
    return layout.modal_size(rows, ["doc_id"], "size", F.col("size").cast("long"))


SENTENCES = r"sentences as (select doc_id, lang, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(31) || '\2', 'g'), chr(31))) as sentence from documents)"


@query(f"with {SENTENCES} select doc_id, count(*) as sentences, sum(length(sentence))::bigint as chars, max(length(sentence))::int as longest from sentences group by 1")
def sentence_split(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(tx.sentences(F.col("text"), plain=True)).alias("sentence"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("sentence")).alias("chars"), F.max(F.length("sentence")).alias("longest"))


def _cascade(cues) -> str:
    """The classification cascade as SQL, for sentences that are neither captions nor in methods sections."""
    out = "case when not length(clean) between 35 and 1200 then null "
    for kind, pattern, _, only_methods in cues:
        if not only_methods:
            quoted = pattern.replace("'", "''")
            then = f"case when regexp_matches(clean, '{extract.BACKGROUND}') and not regexp_matches(clean, '{extract.OWN_WORK}') then null else 'LIMITATION' end" if kind == "LIMITATION" else f"'{kind}'"
            out += f"when regexp_matches(clean, '{quoted}') then {then} "
    return out + "end"


def _classified_sql(cues) -> str:
    return f"""with {SENTENCES}, clean as (select lang, lower({FLAT.format("sentence")}) as clean from sentences)
        select lang, coalesce({_cascade(cues)}, 'UNCLASSIFIED') as type, count(*) as n, sum(length(clean))::bigint as chars from clean group by 1, 2"""


def _classified(spark, sf_dir, cues):
    rows = documents(spark, sf_dir).select("lang", F.explode(tx.sentences(F.col("text"), plain=True)).alias("sentence"))
    clean = F.lower(F.trim(F.regexp_replace("sentence", r"[\t\n\x0B\f\r ]+", " ")))
    rows = rows.select("lang", clean.alias("clean"))
    kind = F.coalesce(extract.classify(F.col("clean"), F.lit(False), F.lit(False), cues), F.lit("UNCLASSIFIED"))
    return rows.groupBy("lang", kind.alias("type")).agg(F.count("*").alias("n"), F.sum(F.length("clean")).alias("chars"))


@query(_classified_sql(extract.CUES))
def cue_classification(spark, sf_dir):
    return _classified(spark, sf_dir, extract.CUES)


@query(_classified_sql(LOCAL_CUES))
def cue_classification_local(spark, sf_dir):
    return _classified(spark, sf_dir, LOCAL_CUES)


@query("""with a as (select conv_id, turn, role, text, coalesce(role <> lag(role) over w, true)::int as border from conversations window w as (partition by conv_id order by turn, role, text)),
    b as (select *, sum(border) over (partition by conv_id order by turn, role, text rows unbounded preceding) as run from a),
    c as (select *, ((row_number() over (partition by conv_id, run order by turn, role, text) - 1) // 20)::int as chunk from b)
    select conv_id, run::bigint as run, chunk, role, count(*) as n, min(turn) as first_turn, max(turn) as last_turn, sum(length(text))::bigint as chars from c group by 1, 2, 3, 4""")
def process_groups(spark, sf_dir):
    order = ["turn", "role", "text"]
    rows = table(spark, sf_dir, "conversations")
    border = F.coalesce(F.col("role") != F.lag("role").over(W.partitionBy("conv_id").orderBy(*order)), F.lit(True))
    rows = extract.runs(rows.withColumn("_border", border), ["conv_id"], order, F.col("_border"))
    return rows.groupBy("conv_id", "run", "chunk", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@query(r"""with t as (select doc_id, array_to_string(regexp_extract_all(regexp_replace(replace(lower(text), 'ß', 'ss'), '(^|[^\p{L}\p{M}\p{N}_])-([0-9])', '\1−\2', 'g'), '[\p{L}\p{M}\p{N}_]+|[−±×Ω°]+'), ' ') as norm from documents)
    select doc_id, (case when contains(norm, 'the and') then 2 else 1 end)::int as score from t where list_has_all(string_split(norm, ' '), ['the', 'and']) order by score desc, doc_id limit 50""")
def normalized_search(spark, sf_dir):
    return search.ranked_documents(documents(spark, sf_dir), "the and")


@query(r"""with t as (select doc_id, array_to_string(regexp_extract_all(regexp_replace(replace(lower(text), 'ß', 'ss'), '(^|[^\p{L}\p{M}\p{N}_])-([0-9])', '\1−\2', 'g'), '[\p{L}\p{M}\p{N}_]+|[−±×Ω°]+'), ' ') as norm from documents)
    select doc_id, (case when contains(norm, 'the on') then 2 else 1 end)::int as score from t where list_has_all(string_split(norm, ' '), ['the', 'on'])""")
def unicode_search(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", tx.relevance(tx.searchable(F.col("text")), "the on").alias("score"))
    return rows.where("score > 0")


@query(r"""select 'url' as kind, page_id as id, regexp_replace(lower(trim(url)), '^(https?://(dx\.)?doi\.org/|doi:\s*)', '') as norm from pages union all
    select 'title', p_partkey, regexp_replace(replace(lower(p_name), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}_]+', '', 'g') from part""")
def doi_title_normalize(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.lit("url").alias("kind"), F.col("page_id").alias("id"), tx.doi(F.col("url")).alias("norm"))
    return urls.unionByName(table(spark, sf_dir, "part").select(F.lit("title").alias("kind"), F.col("p_partkey").alias("id"), tx.title_key(F.col("p_name")).alias("norm")))


KEY_RISK = tx.KEY_RISK + r"""|\b(?:password|token) ?= ?"?[A-Za-z0-9_-]{16,}"""


@query(f"""with {LINES} select doc_id, count(*) as lines, min(ord)::int as first_line from lines
    where regexp_matches(line, '{KEY_RISK.replace("(?=", "(?:").replace("'", "''")}') group by 1""")
def key_risk_lines(spark, sf_dir):
    rows = layout.blocks_of_text(documents(spark, sf_dir)).where(F.col("text").rlike(KEY_RISK))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.min("ord").alias("first_line"))


AUDIT = "(licensed|released|password|token)"


@query(f"""with {LINES}, h as (select doc_id, ord, line, lower(regexp_extract(line, '(?i){AUDIT}', 1)) as term from lines where regexp_matches(line, '(?i){AUDIT}'))
    select doc_id, ord::int as line, term, (octet_length(encode(regexp_extract(line, '(?is)^(.*?){AUDIT}', 1))) + 1)::int as byte_column, case when term in ('password', 'token') then 'CREDENTIAL' when contains(line, 'under') then 'LICENCE' else 'OTHER' end as class, sha256(line) as line_sha256 from h""")
def lexical_audit(spark, sf_dir):
    rows = layout.blocks_of_text(documents(spark, sf_dir)).where(F.col("text").rlike(f"(?i){AUDIT}"))
    term = F.lower(F.regexp_extract("text", f"(?i){AUDIT}", 1))
    kind = F.when(term.isin("password", "token"), "CREDENTIAL").when(F.contains("text", F.lit("under")), "LICENCE").otherwise("OTHER")
    column = F.octet_length(F.regexp_extract("text", f"(?is)^(.*?){AUDIT}", 1)) + 1
    return rows.select("doc_id", F.col("ord").alias("line"), term.alias("term"), column.alias("byte_column"), kind.alias("class"), F.sha2("text", 256).alias("line_sha256"))


PACK = 5500


@query(f"""with recursive {LINES}, d as (select doc_id, string_split(text, chr(10)) as ls, len(string_split(text, chr(10))) as n, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) <= {PACK} as fits from documents where text <> ''),
    w as (select doc_id, 1 as n, 1 as first, length(ls[1]) as size, 0 as closed from d where fits
        union all select w.doc_id, w.n + 1, case when w.size + length(d.ls[w.n + 1]) + 1 > {PACK} then w.n + 1 else w.first end, case when w.size + length(d.ls[w.n + 1]) + 1 > {PACK} then length(d.ls[w.n + 1]) else w.size + length(d.ls[w.n + 1]) + 1 end,
            case when w.size + length(d.ls[w.n + 1]) + 1 > {PACK} then 1 else 0 end from w join d using (doc_id) where w.n < d.n),
    r as (select doc_id, first, max(n) as last from w group by 1, 2)
    select r.doc_id, true as fits, (row_number() over (partition by r.doc_id order by first) - 1)::int as segment, first::int as first, last::int as last, sha256(array_to_string(d.ls[first:last], chr(10))) as text_hash from r join d using (doc_id)
    union all select doc_id, false, null, null, null, null from d where not fits""")
def line_packing(spark, sf_dir):
    return segments.segments(documents(spark, sf_dir), most=PACK)


@query("""with i as (select l_orderkey, l_linenumber as first, l_linenumber + (l_quantity > 45)::int as last from lineitem),
    d as (select *, coalesce(lag(last) over (partition by l_orderkey order by first, last), 0) + 1 as due from i),
    p as (select l_orderkey, sum((first > due)::int) as gaps, sum((first < due)::int) as "overlaps", max(last) as e from d group by 1)
    select o.o_orderkey, coalesce(gaps, 0)::bigint as gaps, coalesce("overlaps", 0)::bigint as "overlaps", coalesce(gaps = 0 and "overlaps" = 0 and e = total, total = 0) as complete
    from (select o_orderkey, count(l_orderkey)::int as total from orders left join lineitem on o_orderkey = l_orderkey group by 1) o left join p on o.o_orderkey = p.l_orderkey""")
def interval_coverage(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + (F.col("l_quantity") > 45).cast("int")).alias("last"))
    totals = table(spark, sf_dir, "orders").select("o_orderkey").join(lines.groupBy("o_orderkey").agg(F.count("*").cast("int").alias("n")), "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("total"))
    return segments.coverage(lines, totals, "o_orderkey")


@query("""with a as (select conv_id, turn, role, text, length(text) as size, least(length(text), 500) as want from conversations),
    b as (select *, greatest(least(want, 2000 - coalesce(sum(want) over (partition by conv_id order by turn, role, text rows between unbounded preceding and 1 preceding), 0)), 0)::bigint as taken from a)
    select conv_id, turn, role, size::int as size, taken, taken > 0 as included, taken > 0 and taken < size as truncated from b""")
def context_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    return segments.context_budget(rows, ["conv_id"], ["turn", "role", "text"], "size", 2000, 500).drop("text")


@query(f"""with i as (select item_id, {FLAT.format("text")} as item from benchmark), d as (select doc_id, {FLAT.format("text")} as body from documents)
    select item_id, doc_id from i join d on contains(body, item) where item <> ''""")
def gold_containment(spark, sf_dir):
    return evaluate.contained_items(table(spark, sf_dir, "benchmark"), documents(spark, sf_dir), "item_id", "doc_id")


@query(r"""select doc_id, case when length(flat) > 110 then flat[1:110] || '…' else flat end as label, sha256('CLAIM' || chr(10) || text) as prediction_key
    from (select *, trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g')) as flat from documents)""")
def labels_and_keys(spark, sf_dir):
    flat = F.trim(F.regexp_replace("text", r"[\t\n\x0B\f\r ]+", " "))
    return documents(spark, sf_dir).select("doc_id", tx.shortened(flat).alias("label"), evaluate.prediction_key(F.lit("CLAIM"), F.col("text")).alias("prediction_key"))


@query("""select lang, source, case when regexp_matches('topic:' || source, '^topic:[^\\x00-\\x1f/\\\\#]+$') then 'topic:' || source else 'topic:label-' || sha256(source)[1:16] end as topic,
    'topic:label-' || sha256(lang || '/' || source)[1:16] as compound, count(*) as n from documents group by all""")
def topic_ids(spark, sf_dir):
    rows = documents(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"))
    return rows.select("lang", "source", ids.topic_id(F.col("source")).alias("topic"), ids.topic_id(F.concat_ws("/", "lang", "source")).alias("compound"), "n")
