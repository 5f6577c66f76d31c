"""Queries over event logs, bibliography-like records, catalogues and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, evaluate, history, integrity, resolve
from ..session import new_path, table
from ..streaming import jobs, leases
from .registry import query

TERMINAL = ("purchase",)
KINDS = ("click", "error", "purchase", "signup", "view")


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


LAST_SQL = "l as (select user_id, arg_max(event_type, (ts, event_id)) as status, max(ts) as ts, count(*) as attempt from events group by 1)"


@query(f"with {LAST_SQL} select user_id, status, ts, attempt from l")
def latest_state(spark, sf_dir):
    n = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("attempt"))
    return history.latest(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", "ts").join(n, "user_id").select("user_id", F.col("event_type").alias("status"), "ts", "attempt")


@query(f"with {LAST_SQL} select user_id, status, attempt + 1 as attempt from l where status <> 'purchase' and ts + interval 300 seconds < (select max(ts) from events) order by ts, user_id limit 1")
def job_claim(spark, sf_dir):
    rows = latest_state(spark, sf_dir).select(F.col("user_id").alias("id"), "status", F.col("ts").alias("updated_at"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + 300).alias("lease_until"), "attempt")
    now = events(spark, sf_dir).agg((F.unix_micros(F.max("ts").cast("timestamp")) / 1e6).alias("now"))
    return history.claimable(rows.join(F.broadcast(now)), F.col("now"), TERMINAL).select(F.col("id").alias("user_id"), "status", "attempt")


@query("select event_type as status, count(*) as events, count(distinct user_id) as keys from events group by 1")
def stage_funnel(spark, sf_dir):
    return history.funnel(events(spark, sf_dir), "user_id", "event_type").withColumnRenamed("event_type", "status")


@query("with g as (select user_id, epoch_us(lead(ts) over (partition by user_id order by ts)) - epoch_us(ts) > 300000000 as gap from events) select user_id, count(*) as events, count(*) filter (gap) as gaps from g group by 1")
def lease_gaps(spark, sf_dir):
    return history.lease_gaps(events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")


FOLLOWS = {"signup": ("view", "click"), "view": ("view", "click", "error"), "click": ("view", "click", "purchase", "error"), "error": ("view", "click")}


@query("""with p as (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events)
    select coalesce(previous, '-') as previous, event_type, coalesce(case when previous is null then true when previous = 'purchase' then false when previous = 'signup' then event_type in ('view', 'click') when previous = 'view' then event_type in ('view', 'click', 'error')
        when previous = 'click' then event_type in ('view', 'click', 'purchase', 'error') when previous = 'error' then event_type in ('view', 'click') end, false) as legal, count(*) as n from p group by all""")
def attempt_rules(spark, sf_dir):
    rows = history.transitions(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", FOLLOWS, TERMINAL)
    return rows.groupBy(F.coalesce("previous", F.lit("-")).alias("previous"), "event_type", "legal").agg(F.count("*").alias("n"))


@query("select conv_id, count(*) filter (role = 'assistant') as attempts, count(*) filter (role = 'assistant') > 2 as blocked from conversations group by 1")
def attempt_limits(spark, sf_dir):
    return history.attempts(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.col("role") == "assistant", 2)


@query("""select doc_id, case when quality = 1 and toxic = 0 then null when quality = 1 then 'accept with open points' when toxic = 1 then null else 'revise without issue and change' end as fault from labels""")
def review_algebra(spark, sf_dir):
    """quality 1: accept of ['quality', 'clean'] with toxic texts failing `clean`; quality 0: revise, issues named only for toxic texts."""
    made = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    criteria = F.array(F.lit("quality"), F.lit("clean"))
    passed = made(F.when(good, "quality"), F.when(~toxic, "clean"))
    failed = made(F.when(~good, "quality"), F.when(toxic, "clean"))
    issues = made(F.when(~good & toxic, "quality"), F.when(toxic, "clean"))
    decision = F.when(good, "accept").otherwise("revise")
    fault = history.review_fault(decision, criteria, passed, failed, issues, issues, F.array(F.lit("source")))
    return table(spark, sf_dir, "labels").select("doc_id", fault.alias("fault"))


@query("""with r as (select user_id as object_id, row_number() over (partition by user_id order by ts, event_id)::int as version, event_type as decision, value from events),
    o as (select object_id, max(version) + 1 as version, arg_max(decision, version) as status from r group by 1)
    select o.object_id as id, r.value >= 50 as current from o join r on r.object_id = o.object_id and r.version = o.version - 1 where o.status in ('purchase', 'error')""")
def current_review(spark, sf_dir):
    """Events as reviews: purchase verifies, error rejects; a value under 50 leaves the reason too short to count."""
    from pyspark.sql import Window as W

    status = F.when(F.col("event_type") == "purchase", "VERIFIED").when(F.col("event_type") == "error", "REJECTED").otherwise("CANDIDATE")
    r = events(spark, sf_dir).select(F.col("user_id").alias("object_id"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("object_version"), status.alias("decision"), "value")
    r = r.select("object_id", F.lit("node").alias("object_kind"), "object_version", F.lit("p").alias("paper_id"), F.lit("h").alias("source_hash"), "decision", F.lit("SOURCE_ATTRIBUTION").alias("scope"), F.lit("someone").alias("reviewer"), F.when(F.col("value") >= 50, "long enough a reason").otherwise("short").alias("reason"), F.lit(None).cast("string").alias("scientific_basis"), F.lit("f").alias("evidence_fingerprint"))
    o = r.groupBy("object_id").agg((F.max("object_version") + 1).alias("version"), F.max_by("decision", "object_version").alias("verification_status"))
    o = o.select(F.col("object_id").alias("id"), F.lit("node").alias("kind"), "version", "verification_status", F.lit("SOURCE_ATTRIBUTION").alias("verification_scope"), F.lit("p").alias("paper_id"), F.lit("h").alias("source_hash"))
    return integrity.reviews_current(o, r, o.select("id", F.lit("f").alias("fingerprint")))


@query("with l as (select user_id, arg_max(event_type, (ts, event_id)) as d from events group by 1) select " + ", ".join(f"count(*) filter (d = '{k}') as {k}" for k in KINDS) + " from l")
def decision_counts(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("_o", F.struct("ts", "event_id"))
    return evaluate.decision_counts(rows, "user_id", "_o", "event_type", KINDS)


@query("select 'lang' as dimension, lang as value, count(*) as n from documents group by 2 union all select 'source', source, count(*) from documents group by 2")
def catalog_groupings(spark, sf_dir):
    return catalog.groupings(table(spark, sf_dir, "documents"), "lang", "source")


@query("select user_id, " + ", ".join(f"count(*) filter (event_type = '{k}') as {k}" for k in KINDS) + " from events group by 1")
def existence_matrix(spark, sf_dir):
    return catalog.existence(events(spark, sf_dir), "user_id", "event_type", [*KINDS])


@query("select o_orderkey, o_orderpriority, row_number() over (order by position nulls last, o_orderpriority, o_orderkey) as place from orders left join (select n_nationkey as k, n_regionkey as position from nation) m on o_orderkey = k")
def reading_order(spark, sf_dir):
    manual = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("o_orderkey"), F.col("n_regionkey").alias("position"))
    return catalog.reading_order(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), manual, "o_orderkey", "o_orderpriority").select("o_orderkey", "o_orderpriority", "place")


RECORDS_SQL = """r as (select c_custkey as item_key, 'b' || (c_nationkey * 100 + floor(c_acctbal / 40)::int) as doi_key, c_mktsegment || c_nationkey as title_key, (c_custkey % 7)::int as year from customer),
    x as (select s_suppkey as paper, s_suppkey * 11 as item_key, 'b' || (s_nationkey * 100 + floor(s_acctbal / 40)::int) as doi_key, 'BUILDING' || s_nationkey as title_key, (s_suppkey % 7)::int as year from supplier)"""


@query(f"""with {RECORDS_SQL}, d as (select *, count(*) over (partition by doi_key) > 1 as same_doi from r),
    m as (select d.*, (select list_sort(list_distinct(list(paper))) from x where x.item_key = d.item_key) as k, (select list_sort(list_distinct(list(paper))) from x where x.doi_key = d.doi_key) as o, (select count(*) from x where x.title_key = d.title_key and x.year = d.year) as t from d),
    t as (select *, list_distinct(list_concat(coalesce(k, []), coalesce(o, []))) as targets from m),
    y as (select *, case when same_doi then 'doi repeats in the batch' when len(targets) > 1 then 'several papers' when len(targets) = 0 and t > 0 then 'same title and year' end as reason from t)
    select item_key, case when reason is not null then 'duplicate' when len(targets) = 1 then 'matched' else 'created' end as outcome, reason, case when reason is null and len(targets) = 1 then targets[1] end as paper from y""")
def entity_resolution(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    doi = lambda n, a: F.concat(F.lit("b"), (F.col(n) * 100 + F.floor(F.col(a) / 40)).cast("int").cast("string"))
    records = c.select(F.col("c_custkey").alias("item_key"), doi("c_nationkey", "c_acctbal").alias("doi_key"), F.concat("c_mktsegment", "c_nationkey").alias("title_key"), (F.col("c_custkey") % 7).cast("int").alias("year"))
    existing = s.select(F.col("s_suppkey").alias("paper"), (F.col("s_suppkey") * 11).alias("item_key"), doi("s_nationkey", "s_acctbal").alias("doi_key"), F.concat(F.lit("BUILDING"), "s_nationkey").alias("title_key"), (F.col("s_suppkey") % 7).cast("int").alias("year"))
    return resolve.matched(records, existing, ["item_key"]).select("item_key", "outcome", "reason", "paper")


@query("""with l as (select s_suppkey as k, case when s_nationkey < 5 then null when s_nationkey < 15 then s_name else 'edited ' || s_name end as name, s_acctbal as balance from supplier),
    b as (select s_suppkey as k, s_name as name, s_acctbal as balance from supplier), i as (select c_custkey as k, c_name as name, c_acctbal as balance from customer),
    m as (select coalesce(l.k, i.k) as k, l.k is null as no_l, i.k is null as no_i, case when i.k is null then l.name when l.name is null or l.name is not distinct from b.name then i.name else l.name end as name, case when i.k is null then l.balance when l.balance is null or l.balance is not distinct from b.balance then i.balance else l.balance end as balance, l.name as ln, l.balance as lb
        from l full join i on l.k = i.k left join b on b.k = coalesce(l.k, i.k))
    select k, name, balance, case when no_l then 'created' when no_i then 'missing' when name is not distinct from ln and balance is not distinct from lb then 'unchanged' else 'updated' end as change from m""")
def three_way_merge(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    base = s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), "s_nationkey")
    name = F.when(F.col("s_nationkey") >= 15, F.concat(F.lit("edited "), "name")).when(F.col("s_nationkey") >= 5, F.col("name"))
    local = base.withColumn("name", name).drop("s_nationkey")
    incoming = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return resolve.merged_rows(local, base.drop("s_nationkey"), incoming, "k", ("name", "balance"))


VERSIONS_SQL = "o as (select doc_id as k, text as t, lang, source from documents where lang <> 'es'), n as (select doc_id as k, case when lang = 'de' then regexp_replace(text, '[0-9]', '#', 'g') else text end as t, lang, case when lang = 'fr' then source || '!' else source end as source from documents where source <> 'src0')"


def _versions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("lang <> 'es'").select(F.col("doc_id").alias("k"), F.col("text").alias("t"), "lang", "source")
    new = d.where("source <> 'src0'").select(F.col("doc_id").alias("k"), F.when(F.col("lang") == "de", F.regexp_replace("text", "[0-9]", "#")).otherwise(F.col("text")).alias("t"), "lang", F.when(F.col("lang") == "fr", F.concat("source", F.lit("!"))).otherwise(F.col("source")).alias("source"))
    return old, new


@query(f"with {VERSIONS_SQL} select coalesce(o.k, n.k) as k, case when o.k is null then 'NEW' when n.k is null then 'REMOVED' when o.t <> n.t or o.lang <> n.lang then 'MATERIAL' when o.source <> n.source then 'NONMATERIAL' else 'EXACT' end as change from o full join n on o.k = n.k")
def snapshot_diff(spark, sf_dir):
    return evaluate.snapshot_diff(*_versions(spark, sf_dir), "k", ("t", "lang"), ("source",))


@query(f"with {VERSIONS_SQL}, a as (from o except all from n), b as (from n except all from o) select (select count(*) from a) as only_a, (select count(*) from b) as only_b, (select count(*) from a) = 0 and (select count(*) from b) = 0 as equal")
def signature_equality(spark, sf_dir):
    return evaluate.same_rows(*_versions(spark, sf_dir))


@query(f"""with {VERSIONS_SQL}, c as (select n.k as new_id, count(o.k) as c, count(o.k) filter (o.source = n.source) as cs, min(o.k) filter (o.source = n.source) as same, min(o.k) as any_ from n left join o on md5(n.t) = md5(o.t) and n.lang = o.lang group by 1),
    s as (select *, case when c = 0 then 'NEW' when cs = 1 or (cs = 0 and c = 1) then 'PAIRED' else 'AMBIGUOUS' end as state from c) select new_id, case when state = 'PAIRED' then coalesce(same, any_) end as old_id, state from s""")
def version_mapping(spark, sf_dir):
    old, new = (df.select(F.col("k").alias("id"), F.md5("t").alias("m"), "lang", F.col("source").alias("type")) for df in _versions(spark, sf_dir))
    return evaluate.predecessors(old, new, ["m", "lang"])


@query(f"with {VERSIONS_SQL} select coalesce(o.k, n.k) as id, case when o.k is null then 'added' when n.k is null then 'kept' when o.lang = n.lang and o.t = n.t and o.source = n.source then 'untouched' when o.lang = 'fr' and n.lang = 'fr' then 'updated' else 'refused' end as action, case when o.k is null then 1 when n.k is null then 1 when o.lang = 'fr' and not (o.t = n.t and o.source = n.source) then 2 else 1 end::int as version from o full join n on o.k = n.k")
def incremental_rebuild(spark, sf_dir):
    old, new = (df.select(F.col("k").alias("id"), F.col("lang").alias("type"), F.lit(1).alias("version"), "t", "source") for df in _versions(spark, sf_dir))
    return evaluate.rebuilt(old, new, ["t", "source"], ("fr",))


@query("""select doc_id as node_id, basis <> 'unreviewed' as correct, basis from (select d.doc_id, case when l.quality = 1 and l.toxic = 0 then 'direct accept' when l.toxic = 1 and l.quality = 1 then 'historical accept' when l.toxic = 1 then 'explained revise' else 'unreviewed' end as basis from documents d left join labels l using (doc_id))""")
def adjudication_credit(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    direct = labels.where("toxic = 0").select(F.col("doc_id").alias("node_id"), F.when(F.col("quality") == 1, "ACCEPT").otherwise("REJECT").alias("decision"))
    bound = labels.where("toxic = 1").select(F.col("doc_id").alias("node_id"), F.when(F.col("quality") == 1, "ACCEPT").otherwise("REVISE").alias("decision"), F.col("doc_id").alias("decision_id"))
    predictions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"))
    return evaluate.credited(predictions, direct, bound, bound.where("decision = 'REVISE'").select("decision_id"))


@query("""with m as (select * from documents join labels using (doc_id)) select name, passed, total, passed / total as rate, passed / total >= t as ok from (
    select 'precision' as name, count(*) filter (quality = 1) as passed, count(*) as total, 0.9 as t from m union all select 'recall', count(*) filter (toxic = 0), count(*), 0.8 from m union all select 'type', count(*) filter (lang = 'en'), count(*), 0.9 from m)""")
def gold_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.metrics(rows, precision=F.col("quality") == 1, recall=F.col("toxic") == 0, type=F.col("lang") == "en")


@query("""with g as (select doc_id as id, source || '/' || doc_id as old_path, sha256(text) as h from documents where lang = 'de'), f as (select lang || '/' || doc_id as new_path, sha256(text) as h from documents where lang <> 'es'),
    a as (select *, count(*) over (partition by h) as n from g), b as (select *, count(*) over (partition by h) as n from f) select id, old_path, new_path from a join b using (h) where a.n = 1 and b.n = 1""")
def move_detection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("content_hash", F.sha2("text", 256))
    registered = d.where("lang = 'de'").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "doc_id").alias("path"), "content_hash")
    present = d.where("lang <> 'es'").select(F.concat_ws("/", "lang", "doc_id").alias("path"), "content_hash")
    return catalog.moves(registered, present)


@query("""with r as (select sha256(text) as id, 'doc/' || lpad(doc_id::varchar, 12, '0') as path, row_number() over (partition by sha256(text) order by 'doc/' || lpad(doc_id::varchar, 12, '0')) as n from documents)
    select id, min(path) as path, count(*) - 1 as repeats from r group by 1""")
def artifact_index(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("id"), F.lit("paper").alias("kind"), F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"))
    records, repeats = catalog.index([rows])
    n = repeats.groupBy("id").agg(F.count("*").alias("n"))
    return records.join(n, "id", "left").select("id", "path", F.coalesce("n", F.lit(0)).alias("repeats"))


@query("with o as (select source || '/' || doc_id as path, md5(text) as h from documents where lang <> 'fr'), n as (select source || '/' || doc_id as path, md5(case when lang = 'de' then upper(text) else text end) as h from documents where lang <> 'es') select case when n.h is null then 'copy' when o.h is null then 'new only' when o.h = n.h then 'equal' else 'conflict' end as state, count(*) as n from o full join n on o.path = n.path group by 1")
def migration_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "doc_id"))
    old = d.where("lang <> 'fr'").select("path", F.md5("text").alias("hash"))
    new = d.where("lang <> 'es'").select("path", F.md5(F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text"))).alias("hash"))
    return catalog.migration(old, new).groupBy("state").agg(F.count("*").alias("n"))


def _keyed_events(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("kind"))


JOBS_SQL = """with e as (select user_id as key, epoch_us(ts) as us, event_type as kind, coalesce(max((event_type = 'purchase')::int) over (partition by user_id order by ts, event_type rows between unbounded preceding and 1 preceding), 0) = 1 as dead, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_type) > 300000000 as gap from events)
    select key, max(us) filter (not dead) as last_us, arg_max(kind, (us, kind)) filter (not dead) as status, count(*) filter (not dead) as events, count(*) filter (not dead and gap) as lapses, count(*) filter (dead) as late, bool_or(kind = 'purchase') as terminal from e group by 1"""


@query(JOBS_SQL)
def job_states(spark, sf_dir):
    return jobs.batch_states(_keyed_events(spark, sf_dir), TERMINAL)


@query(JOBS_SQL)
def stream_job_states(spark, sf_dir):
    """The same states from a drained stream over the events files."""
    table_ = events(spark, sf_dir)
    single = table_.inputFiles()[0].endswith("/events.parquet")  # a stream reads folders: the one file by its name, or the table's folder
    path, name = (sf_dir, "events.parquet") if single else (f"{sf_dir}/events.parquet", "*.parquet")
    return jobs.drained(spark, path, table_.schema, TERMINAL, new_path(spark, "stream"), name=name)


DELAY_MINUTES, LEASE = 60, 6 * 3600


def _events_stream(spark, sf_dir):
    """The events files as a stream of (key, ts, event_type)."""
    table_ = events(spark, sf_dir)
    single = table_.inputFiles()[0].endswith("/events.parquet")
    path, name = (sf_dir, "events.parquet") if single else (f"{sf_dir}/events.parquet", "*.parquet")
    raw = spark.readStream.schema(table_.schema).option("pathGlobFilter", name).parquet(path)
    return raw.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_type")


LAPSES_SQL = f"""with m as (select epoch_us(max(ts)) // 1000 - {60_000 * DELAY_MINUTES} as mark from events),
    e as (select cast(user_id as varchar) as key, epoch_us(ts) // 1000 as ms, event_type = 'purchase' as terminal from events where user_id is not null and ts is not null),
    o as (select *, coalesce(bool_or(terminal) over (partition by key order by ms, terminal rows between unbounded preceding and 1 preceding), false) as over from e, m where ms <= mark),
    n as (select *, row_number() over w as n, coalesce(lead(ms) over w, mark + 1) > ms + {1000 * LEASE} and not terminal as lapse from o where not over window w as (partition by key order by ms, terminal))
    select key, ms + {1000 * LEASE} as deadline_ms, n - coalesce(lag(n) over (partition by key order by n), 0) as beats from n where lapse"""


@query(LAPSES_SQL)
def stream_lease_lapses(spark, sf_dir):
    """Users as jobs: each event is a heartbeat, a purchase ends the job; silence over six hours loses the lease when the watermark passes the deadline."""
    rows = leases.lapses(_events_stream(spark, sf_dir), F.col("event_type").isin(*TERMINAL), f"{DELAY_MINUTES} minutes", LEASE)
    return leases.drained(spark, rows, new_path(spark, "leases"))


@query(LAPSES_SQL)
def lease_lapses(spark, sf_dir):
    """The same from the finished table."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    mark = rows.agg((F.unix_millis(F.max("ts")) - 60_000 * DELAY_MINUTES).alias("mark"))
    return leases.batch_lapses(rows.join(F.broadcast(mark)), F.col("event_type").isin(*TERMINAL), F.col("mark"), LEASE)


@query(f"with {LAST_SQL} select user_id, case status when 'error' then 'FAILED' when 'purchase' then 'READY' else 'PARSING' end as status, status = 'error' as retry from l")
def job_retries(spark, sf_dir):
    """A user's last event as a job's state: only failed jobs may be tried again."""
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "READY").otherwise("PARSING")
    last = history.latest(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")
    return history.retryable(last.select("user_id", status.alias("status")))
