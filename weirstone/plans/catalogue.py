"""The registered queries over the driver's tables, and their SQL.

Each query stands on the library's operators; its SQL says the same independently for another engine.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.config import Config, Entity, Source, Storage
from weirstone.contracts import Contract, breaks, observed_fields
from weirstone.functions import dot, epoch_ms
from weirstone.governance import pii_in_rows, privileges_by_principal
from weirstone.observability import detectors as D
from weirstone.observability import metrics as M
from weirstone.operators import dedup, enforcement, envelope, gold, marts, merge, reconcile, scd2
from weirstone.quality.runner import run_suite, suite_summary
from weirstone.quality.suite import Suite
from weirstone.retrieval import chunks, embed, index, ngrams
from weirstone.sources.files import Feed, copy_into
from weirstone.storage.export import export_table
from weirstone.storage.scratch import scratch_folder
from weirstone.storage.table import Files, Layout, Table
from weirstone.streaming import histories
from weirstone.streaming.ingest import bronze, run_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The reference time of freshness checks: nothing here reads a clock.
NOW = datetime(2030, 1, 1, tzinfo=timezone.utc)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def enter(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return enter


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- account days -------------------------------------------------------------------------------

#: Thresholds that fit the events' amounts.
LIMITS = gold.Thresholds(large=100.0, near=0.85, velocity=3, structuring=1)


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions: errors are reversed, purchases are deposits."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "deposit").otherwise(F.col("event_type"))
    return e.select(F.col("event_id").alias("transaction_id"), F.col("user_id").alias("account_id"), F.col("value").alias("amount"), kind.alias("txn_type"), F.col("event_type").alias("channel"), F.when(F.col("event_type") == "error", "reversed").otherwise("posted").alias("status"), F.col("ts").alias("booked_at"))


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("account_id"), F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("account_type"), F.lit("JPY").alias("currency"), (F.col("c_custkey") % 7 != 0).alias("is_current"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") < 0, "high").otherwise("low").alias("risk_rating"), (F.col("c_custkey") % 5 != 0).alias("is_current"))


@query("""
with t as (select user_id as account_id, cast(ts as date) as txn_date, value as amount, event_type as channel,
             case when event_type = 'purchase' then 'deposit' else event_type end as txn_type
           from events where event_type <> 'error'),
d as (select account_id, txn_date, count(*) as txn_count,
        sum(case when txn_type = 'deposit' then amount else 0 end) as total_credits,
        sum(case when txn_type = 'deposit' then 0 else amount end) as total_debits,
        max(amount) as max_txn_amount, count(distinct channel) as distinct_channels,
        count(*) filter (amount >= 100) as large, count(*) filter (amount >= 85 and amount < 100) as near
      from t group by all)
select d.account_id, d.txn_date, a.c_custkey as customer_id, a.c_mktsegment as account_type, case when a.c_custkey is not null then 'JPY' end as currency,
  c.c_mktsegment as segment, case when c.c_custkey is null then null when c.c_acctbal < 0 then 'high' else 'low' end as risk_rating,
  txn_count, round(total_credits, 4) as total_credits, round(total_debits, 4) as total_debits, round(total_credits - total_debits, 4) as net_amount, max_txn_amount,
  distinct_channels, large > 0 as large_txn_flag, txn_count >= 3 as high_velocity_flag, near >= 1 as structuring_flag
from d left join customer a on a.c_custkey = d.account_id and a.c_custkey % 7 <> 0
left join customer c on c.c_custkey = a.c_custkey and c.c_custkey % 5 <> 0
""")
def account_day_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gold.account_daily_metrics(_transactions(spark, sf_dir), _accounts(spark, sf_dir), _customers(spark, sf_dir), LIMITS)
    return out.withColumns({c: F.round(c, 4) for c in ("total_credits", "total_debits", "net_amount")})


@query("""
select event_type, count(*) as n, round(sum(value), 3) as total, max(value) as largest, count(distinct user_id) as users from events group by event_type
""")
def event_type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.max("value").alias("largest"), F.countDistinct("user_id").alias("users"))


# --- envelopes and contracts --------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change-event lines, broken in as many ways as there are reasons, by event_id % 20."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "d").otherwise("u")
    body = lambda op, ts, source: F.concat(F.lit('{"op":'), op, F.lit(',"ts_ms":'), ts, F.lit(',"source":'), source, F.lit("}"))
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    ts, source = F.col("event_id").cast("string"), F.concat(F.lit('{"table":"events","lsn":'), F.col("event_id").cast("string"), F.lit("}"))
    good = body(text(op), ts, source)
    kind = F.col("event_id") % 20
    raw = (
        F.when(kind == 0, F.lit("")).when(kind == 1, F.substring(good, 1, 15)).when(kind == 2, F.concat(F.lit("GARBAGE "), good)).when(kind == 3, F.lit("[1]"))
        .when(kind == 4, body(text(op), text(F.lit("soon")), source)).when(kind == 5, body(F.lit("null"), ts, source)).when(kind == 6, body(text(F.lit("x")), ts, source))
        .when(kind == 7, body(text(op), F.lit("null"), source)).when(kind == 8, body(text(op), ts, F.lit("{}"))).when(kind == 9, F.lit(None).cast("string")).otherwise(good)
    )
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, "orders").otherwise("events").alias("entity"), F.lit(None).cast("string").alias("event_key"), raw.alias("raw_value"), F.lit("mem").alias("source_ref"))


_REASON = """case event_id % 20 when 0 then 'unparseable_json' when 9 then 'unparseable_json' when 1 then 'corrupt_envelope' when 2 then 'corrupt_envelope'
  when 3 then 'corrupt_envelope' when 4 then 'corrupt_envelope' when 5 then 'missing_op' when 6 then 'unknown_op' when 7 then 'missing_or_invalid_ts_ms'
  when 8 then 'missing_source_table' end"""


@query(f"""
select event_id, {_REASON} as error_reason,
  case when {_REASON} is null then case when event_type = 'error' then 'd' else 'u' end end as op,
  case when {_REASON} is null then event_id end as lsn
from events
""")
def envelope_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = F.col("error_reason").isNull()
    out = envelope.parse_envelope(_lines(spark, sf_dir))
    return out.select("event_id", "error_reason", F.when(sound, F.col("envelope.op")).alias("op"), F.when(sound, F.col("envelope.source.lsn")).alias("lsn"))


@query(f"""
select coalesce({_REASON}, case when event_id % 3 = 0 then 'unknown_entity' else 'valid' end) as outcome, count(*) as n from events group by 1
""")
def envelope_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = envelope.mark_unknown_entities(envelope.parse_envelope(_lines(spark, sf_dir)), ["events"])
    bad = envelope.quarantined(parsed).select(F.col("error_reason").alias("outcome"))
    good = envelope.events_of(parsed, "events").select(F.lit("valid").alias("outcome"))
    return bad.union(good).groupBy("outcome").agg(F.count("*").alias("n"))


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k, ts as at, user_id from events")
def payload_typed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.concat(F.lit('{"after":'), "props", F.lit("}")).alias("raw_value"))
    typed = Contract.model_validate({"contract": "props", "version": 1, "owner": "x", "primary_key": ["k"], "event_time_field": "k", "sla": {"freshness_hours": 1}, "fields": [{"name": "k", "type": "integer", "nullable": False}]})
    return enforcement.parse_payloads(raw, typed).select("event_id", "after.k", F.col("ts").alias("at"), "user_id")


ORDER_CONTRACT = Contract.model_validate({
    "contract": "orders", "version": 1, "owner": "x", "primary_key": ["id"], "event_time_field": "id", "sla": {"freshness_hours": 1},
    "fields": [
        {"name": "id", "type": "bigint", "nullable": False},
        {"name": "status", "type": "string", "nullable": False, "allowed_values": ["F", "O"]},
        {"name": "price", "type": "decimal(18,2)", "nullable": False},
        {"name": "note", "type": "string"},
    ],
})


def _order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as change events: every 11th without a price, every 13th without an after image, every 17th a delete."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.when(key % 11 == 0, F.lit("null")).otherwise(F.format_string("%.2f", "o_totalprice"))
    after = F.concat(F.lit('{"id":'), key.cast("string"), F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('","price":'), price, F.lit("}"))
    raw = F.concat(F.lit('{"before":null,"after":'), F.when((key % 13 == 0) | (key % 17 == 0), F.lit("null")).otherwise(after), F.lit("}"))
    return o.select(raw.alias("raw_value"), F.when(key % 17 == 0, "d").otherwise("c").alias("op"), key.alias("ts_ms"), key.alias("lsn"), F.lit("run").alias("run_id"))


_VIOLATIONS = """case when o_orderkey % 17 = 0 then '' when o_orderkey % 13 = 0 then 'payload_violation:after_missing_or_unparseable'
  else concat_ws(',', case when o_orderstatus not in ('F', 'O') then 'enum_violation:status' end, case when o_orderkey % 11 = 0 then 'null_violation:price' end) end"""


@query(f"select o_orderkey as id, {_VIOLATIONS} as violations from orders where {_VIOLATIONS} <> ''")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, broken, _ = enforcement.enforce_contract(_order_events(spark, sf_dir), ORDER_CONTRACT, before=False)
    return broken.select(F.col("lsn").alias("id"), F.array_join("violations", ",").alias("violations"))


@query(f"select case when {_VIOLATIONS} = '' then 'valid' else 'quarantined' end as side, count(*) as n from orders group by 1")
def contract_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, broken, _ = enforcement.enforce_contract(_order_events(spark, sf_dir), ORDER_CONTRACT, before=False)
    sides = valid.select(F.lit("valid").alias("side")).union(broken.select(F.lit("quarantined").alias("side")))
    return sides.groupBy("side").agg(F.count("*").alias("n"))


@query(f"select o_orderkey as id, round(cast(o_totalprice as decimal(18,2)), 2) as price from orders where {_VIOLATIONS} = '' and o_orderkey % 17 <> 0")
def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _, _ = enforcement.enforce_contract(_order_events(spark, sf_dir), ORDER_CONTRACT, before=False)
    return scd2.fact_rows(valid, ORDER_CONTRACT).select("id", "price")


_DAY = "datediff('day', date '2023-12-31', cast(valid_at as date))"


@query(f"""
with rows as (select coalesce(source, '') as contract, cast({_DAY} as int) as version, op, segment, balance from client_changes where valid_at is not null),
seen as (select contract, version, 'op' as field, op as value, 'string' as type from rows union all select contract, version, 'segment', segment, 'string' from rows
  union all select contract, version, 'balance', cast(balance as varchar), case when balance is not null then case when balance = floor(balance) then 'bigint' else 'double' end end from rows),
f as (select contract, version, field, max(type) as type, bool_or(value is null) as nullable, case when field <> 'balance' then list_sort(list(distinct value) filter (value is not null)) end as vals
  from seen group by contract, version, field having count(value) > 0),
steps as (select contract, version, lag(version) over (partition by contract order by version) as old_version from (select distinct contract, version from f)),
b as (select s.contract, s.old_version, s.version, coalesce(n.field, o.field) as field, o.type as otype, n.type as ntype, o.nullable as onull, n.nullable as nnull,
    list_sort(list_filter(coalesce(o.vals, []), lambda x: not list_contains(coalesce(n.vals, []), x))) as lost, o.field is null as fresh, n.field is null as gone
  from steps s join (select distinct contract, field from f) k on k.contract = s.contract
  left join f n on n.contract = s.contract and n.version = s.version and n.field = k.field left join f o on o.contract = s.contract and o.version = s.old_version and o.field = k.field
  where s.old_version is not null and (n.field is not null or o.field is not null))
select contract, old_version, version, field, 'removed' as kind, '' as detail from b where gone
union all select contract, old_version, version, field, 'added_required', '' from b where fresh and not nnull
union all select contract, old_version, version, field, 'type_changed', otype || ' to ' || ntype from b where otype <> ntype
union all select contract, old_version, version, field, 'became_required', '' from b where onull and not nnull
union all select contract, old_version, version, field, 'values_lost', array_to_string(lost, ',') from b where len(lost) > 0 and not gone
""")
def contract_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract that each source's changes keep on a day, as their rows show it, and what each day breaks of the one before."""
    rows = table(spark, sf_dir, "client_changes").where("valid_at is not null")
    day = F.date_diff(F.col("valid_at").cast("date"), F.lit("2023-12-31").cast("date"))
    return breaks(observed_fields(rows, F.coalesce("source", F.lit("")), day, ("op", "segment"), ("balance",)))


# --- histories ----------------------------------------------------------------------------------


def _versions(spark: SparkSession, sf_dir: str, rows: Column | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.where(rows) if rows is not None else e
    e = e.withColumn("op", F.when(F.col("event_type") == "error", "d").otherwise("u"))
    made = scd2.intervals(e, "user_id", ("ts", "event_id"), "ts", identity=("event_id", "op"))
    return made.select("user_id", "event_id", "value", "valid_from", "valid_to", "is_current", "is_deleted")


_SCD2 = """select user_id, event_id, value, ts as valid_from, nts as valid_to, nts is null as is_current, coalesce(ntype = 'error', false) as is_deleted
  from (select *, lead(ts) over w as nts, lead(event_type) over w as ntype from events window w as (partition by user_id order by ts, event_id))
  where event_type <> 'error' and (nts is null or nts <> ts)"""


@query(_SCD2)
def scd2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir)


@query(_SCD2)
def scd2_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same histories from a stream that delivers the events shuffled, in three batches, with each key's latest event in state."""
    folder, schema = scratch_folder(spark, "histories"), table(spark, sf_dir, "events").schema
    timeline = Table(spark, f"{folder}/timeline")
    for batch in range(3):
        table(spark, sf_dir, "events").where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch).write.mode("append").parquet(f"{folder}/landing")
        events = spark.readStream.schema(schema).parquet(f"{folder}/landing").withColumn("op", F.when(F.col("event_type") == "error", "d").otherwise("u"))
        histories.historize_stream(events, timeline, f"{folder}/checkpoint", key="user_id", at="ts", tie="event_id", buckets=8)
    return histories.versions(timeline.read()).select("user_id", "event_id", "value", "valid_from", "valid_to", "is_current", "is_deleted")


@query(f"select * from ({_SCD2}) where is_current and not is_deleted")
def scd2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2.current(_versions(spark, sf_dir))


@query(f"select user_id, cast(0 as bigint) as overlaps, count(*) as n_current from ({_SCD2}) where is_current group by user_id having count(*) > 1")
def scd2_chain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2.chain_violations(_versions(spark, sf_dir), "user_id")


@query(f"""
with v as ({_SCD2}) select p.c_custkey as user_id, p.at, v.event_id, v.value
from (select c_custkey, timestamp '2024-01-15 00:00:00' + to_days(cast(c_custkey % 10 as int)) as at from customer) p
left join v on v.user_id = p.c_custkey and v.valid_from <= p.at and (v.valid_to is null or p.at < v.valid_to)
""")
def scd2_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestamp_ntz'2024-01-15 00:00:00' + make_dt_interval(int(c_custkey % 10))")
    probes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), at.alias("at"))
    return scd2.as_of(_versions(spark, sf_dir), probes, "user_id", "at").select("user_id", "at", "event_id", "value")


_EARLY = _SCD2.replace("from events window", "from events where event_id % 3 <> 0 window")


@query(f"with whole as ({_SCD2}), early as ({_EARLY}) select * from whole union all select * from early where (user_id, event_id, valid_from) not in (select (user_id, event_id, valid_from) from whole)")
def scd2_merge_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with the history of two thirds of the events, into which the whole one is merged: late events close and split
    versions. What only the early history has (versions that the whole one gives no time) stays as it was."""
    held = Table(spark, scratch_folder(spark, "history"))
    keys = ["user_id", "event_id", "valid_from"]
    held.overwrite(_versions(spark, sf_dir, F.col("event_id") % 3 != 0), layout=Layout(tuple(keys), 8))
    held.merge(_versions(spark, sf_dir), keys, ["valid_to", "is_current", "is_deleted"])
    return held.read()


@query(f"select * from ({_SCD2}) where user_id in (select user_id from events where event_id % 50 = 0)")
def scd2_touched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("op", F.when(F.col("event_type") == "error", "d").otherwise("u"))
    held = scd2.touched_history(e, e.where(F.col("event_id") % 50 == 0), "user_id")
    made = scd2.intervals(held, "user_id", ("ts", "event_id"), "ts", identity=("event_id", "op"))
    return made.select("user_id", "event_id", "value", "valid_from", "valid_to", "is_current", "is_deleted")


#: What a client's change must hold; deletes carry the image before.
CLIENT_CONTRACT = Contract.model_validate({
    "contract": "clients", "version": 1, "owner": "x", "primary_key": ["client_id"], "event_time_field": "seq", "sla": {"freshness_hours": 1},
    "fields": [
        {"name": "client_id", "type": "bigint", "nullable": False},
        {"name": "seq", "type": "bigint", "nullable": False},
        {"name": "source", "type": "string", "nullable": False, "allowed_values": ["crm", "partner", "store", "web"]},
        {"name": "segment", "type": "string", "allowed_values": ["online", "public", "retail", "wholesale"]},
        {"name": "city", "type": "string"},
        {"name": "balance", "type": "double", "nullable": False},
    ],
})


@query("""
with e as (select distinct client_id, seq, source, segment, city, balance, epoch_ms(valid_at) as ms, case op when 'I' then 'c' when 'U' then 'u' else 'd' end as o, coalesce(change_id, 1000000000000 + seq) as lsn
  from client_changes where valid_at is not null and client_id is not null and op in ('I', 'U', 'D')),
ok as (select * from e where o = 'd' or (seq is not null and coalesce(source in ('crm', 'partner', 'store', 'web'), false) and coalesce(segment in ('online', 'public', 'retail', 'wholesale'), true) and balance is not null)),
n as (select *, lead(ms) over w as nms, lead(o) over w as no from ok window w as (partition by client_id order by ms, lsn))
select client_id, seq, source, segment, city, balance, ms as from_ms, nms as to_ms, nms is null as is_current, coalesce(no = 'd', false) as is_deleted from n where o <> 'd' and (nms is null or nms <> ms)
""")
def client_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients' changes as lines, held against a contract, and the history of what keeps it: from payload to version."""
    c = table(spark, sf_dir, "client_changes").where("valid_at is not null and client_id is not null and op in ('I', 'U', 'D')")
    gone, image = F.col("op") == "D", F.struct("client_id", "seq", "source", "segment", "city", "balance")
    line = F.to_json(F.struct(F.when(gone, image).alias("before"), F.when(~gone, image).alias("after")))
    events = c.select(line.alias("raw_value"), F.when(gone, "d").when(F.col("op") == "I", "c").otherwise("u").alias("op"), epoch_ms(F.col("valid_at")).alias("ts_ms"), F.coalesce("change_id", F.lit(10**12) + F.col("seq")).alias("lsn"), F.lit("run").alias("run_id"))
    valid, _, _ = enforcement.enforce_contract(events, CLIENT_CONTRACT)
    made = scd2.build_versions(valid, CLIENT_CONTRACT)
    return made.select("client_id", "seq", "source", "segment", "city", "balance", F.unix_millis("valid_from").alias("from_ms"), F.unix_millis("valid_to").alias("to_ms"), "is_current", "is_deleted")


@query("select l_orderkey, l_linenumber, count(*) > 0 as there from lineitem group by 1, 2")
def append_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping parts of lineitem, the second merged into the first by key."""
    rows, keys = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]
    first = rows.where(F.col("l_orderkey") % 3 != 0).dropDuplicates(keys)
    more = merge.insert_absent(first, rows.where(F.col("l_orderkey") % 2 == 0).unionByName(rows.where(F.col("l_orderkey") % 3 == 0)), keys)
    return first.unionByName(more).withColumn("there", F.lit(True))


@query("select count(*) as n from (select distinct l_orderkey, l_linenumber, l_partkey from lineitem)")
def exact_dup_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return dedup.exact_duplicates_dropped(rows.unionAll(rows), ["l_orderkey", "l_linenumber", "l_partkey"]).agg(F.count("*").alias("n"))


@query("""
select o_custkey, o_orderkey, o_orderdate, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1
""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return dedup.latest_per_key(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 40)")
def ledger_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return merge.set_difference(table(spark, sf_dir, "part").select("p_partkey"), known, "p_partkey")


@query("select 'region_' || n_regionkey as _source_file, count(*) as rows_loaded from nation group by 1")
def per_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("_source_file", F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")))
    return reconcile.per_file_counts(n)


@query("""
select coalesce(o.k, l.k) as o_orderkey, coalesce(o.n, 0) as expected, coalesce(l.n, 0) as actual, coalesce(o.n, 0) = coalesce(l.n, 0) as matches
from (select o_orderkey as k, count(*) as n from orders where o_orderkey % 2 = 0 group by 1) o
full join (select l_orderkey as k, count(*) as n from lineitem where l_linenumber = 1 group by 1) l on o.k = l.k
""")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select("o_orderkey")
    actual = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return reconcile.reconcile_counts(expected, actual, "o_orderkey")


# --- marts --------------------------------------------------------------------------------------

_FX = [("JPY", "USD", 0.0064, "2026-01-01"), ("JPY", "EUR", 0.0059, "2026-01-01"), ("JPY", "GBP", 0.0, "2026-01-01")]


@query("""
select c_custkey as customer_id, c_mktsegment as segment, case when c_acctbal < 0 then 'high' else 'low' end as risk_rating, date '2024-01-01' as customer_since,
  count(distinct o_orderkey) as active_accounts, round(coalesce(sum(o_totalprice), 0), 2) as total_balance
from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by all
""")
def dim_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir).drop("is_current").withColumn("created_at", F.to_timestamp_ntz(F.lit("2024-01-01 10:00:00")))
    o = table(spark, sf_dir, "orders")
    accounts = o.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("account_id"), F.col("o_totalprice").alias("balance"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("closed").alias("status"))
    return marts.dim_customers(c, accounts).withColumn("total_balance", F.round(F.col("total_balance").cast("double"), 2))


@query("""
select o_orderkey as transaction_id, o_custkey as account_id, case when o_custkey % 4 <> 0 then o_custkey end as customer_id, cast(o_orderdate as date) as booked_date,
  cur as currency, o_totalprice as amount, case cur when 'JPY' then o_totalprice when 'USD' then o_totalprice / 0.0064 when 'EUR' then o_totalprice / 0.0059 end as amount_jpy
from (select *, case o_orderkey % 5 when 0 then 'JPY' when 1 then 'USD' when 2 then 'EUR' when 3 then 'GBP' else 'CHF' end as cur from orders)
""")
def fct_fx_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    currency = F.element_at(F.array(*(F.lit(x) for x in ("JPY", "USD", "EUR", "GBP", "CHF"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    none = F.lit(None).cast("string")
    t = o.select(F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("account_id"), F.col("o_totalprice").alias("amount"), currency.alias("currency"), none.alias("txn_type"), none.alias("channel"), none.alias("status"), F.col("o_orderdate").alias("booked_at"), F.to_date("o_orderdate").alias("booked_date"))
    accounts = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("account_id"), F.col("c_custkey").alias("customer_id"))
    out = marts.fct_transactions(t, accounts, spark.createDataFrame(_FX, "base_currency string, quote_currency string, rate double, business_date string"), digits=None)  # the SQL side doesn't round
    return out.select("transaction_id", "account_id", "customer_id", "booked_date", "currency", "amount", "amount_jpy")


@query("""
select o_orderpriority as product, count(*) as applications, count(*) filter (o_orderstatus = 'P') as submitted, cast(0 as bigint) as under_review,
  count(*) filter (o_orderstatus = 'F') as approved, count(*) filter (o_orderstatus = 'O') as rejected,
  round(count(*) filter (o_orderstatus = 'F') / nullif(count(*) filter (o_orderstatus in ('F', 'O')), 0), 3) as approval_rate, round(avg(o_totalprice), 2) as avg_amount
from orders group by 1
""")
def status_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.create_map(*(F.lit(x) for x in ("P", "submitted", "F", "approved", "O", "rejected"))), F.col("o_orderstatus"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("product"), state.alias("status"), F.col("o_totalprice").alias("amount"))
    return marts.funnel(o, "product", "status", "amount", None)


@query("""
select c_custkey as account_id, c_nationkey as customer_id, c_mktsegment as account_type, 'JPY' as currency, c_acctbal as balance,
  case when c_acctbal < 0 then 'frozen' else 'active' end as status from customer where c_custkey % 3 <> 0 and c_custkey % 7 <> 0
""")
def stg_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, at = table(spark, sf_dir, "customer"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    held = c.select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("customer_id"), F.col("c_mktsegment").alias("account_type"), F.lit("JPY").alias("currency"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_acctbal") < 0, "frozen").otherwise("active").alias("status"), at.alias("opened_at"), at.alias("updated_at"), (F.col("c_custkey") % 3 != 0).alias("is_current"), (F.col("c_custkey") % 7 == 0).alias("is_deleted"))
    return marts.stg_accounts(held).drop("opened_at", "updated_at")


@query("""
select s_suppkey as branch_id, s_name as branch_name, 'n' || s_nationkey as region, date '2020-01-01' as opened_date, date '2024-01-01' + cast(s_suppkey % 3 as int) as business_date from supplier
""")
def stg_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier sent three times; the latest load wins, and of one load the last file."""
    s = table(spark, sf_dir, "supplier")
    sent = s.select(F.col("s_suppkey").alias("branch_id"), F.col("s_name").alias("branch_name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("region"), F.lit("2020-01-01").alias("opened_date"), F.explode(F.array(*(F.struct(F.lit(at).alias("_ingest_ts"), F.lit(f).alias("_source_file"), F.lit(shift).alias("shift")) for at, f, shift in ((1, "a", -2), (2, "a", -1), (2, "b", 0))))).alias("x"))
    sent = sent.select("branch_id", "branch_name", "region", "opened_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("branch_id") % 3).cast("int") + F.col("x.shift")).cast("string").alias("business_date"), "x._ingest_ts", "x._source_file")
    return marts.stg_branches(sent)


@query("""
select c_custkey as customer_id, c_name as full_name, c_mktsegment as segment, case when c_acctbal < 0 then 'high' else 'low' end as risk_rating,
  timestamp '2024-01-01 10:00:00' as created_at, timestamp '2024-01-02 10:00:00' as valid_from, cast(c_custkey as varchar) as business_key
from customer where c_custkey % 3 <> 0 and c_custkey % 7 <> 0
""")
def stg_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current customers, neither closed nor deleted. The tables have no mail, phone or address, so these columns are left out."""
    c, at = table(spark, sf_dir, "customer"), lambda day: F.to_timestamp_ntz(F.lit(f"2024-01-0{day} 10:00:00"))
    held = c.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("full_name"), *(F.lit(None).cast("string").alias(x) for x in ("email", "phone", "address")),
        F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") < 0, "high").otherwise("low").alias("risk_rating"), at(1).alias("created_at"), at(1).alias("updated_at"), at(2).alias("valid_from"),
        F.col("c_custkey").cast("string").alias("business_key"), (F.col("c_custkey") % 3 != 0).alias("is_current"), (F.col("c_custkey") % 7 == 0).alias("is_deleted"),
    )
    return marts.stg_customers(held).drop("email", "phone", "address", "updated_at")


@query("""
select client_id as customer_id, name as full_name, email, 'n' || nation_id as phone, city as address, segment, case when balance < 0 then 'high' else 'low' end as risk_rating,
  updated_at as created_at, updated_at, updated_at as valid_from, cast(client_id as varchar) as business_key from clients where client_id = master_id and nation_id % 5 <> 0
""")
def stg_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staging view with all its columns, over clients that are their own master and live in four nations of five."""
    c, at = table(spark, sf_dir, "clients"), F.col("updated_at")
    held = c.select(
        F.col("client_id").alias("customer_id"), F.col("name").alias("full_name"), "email", F.concat(F.lit("n"), F.col("nation_id").cast("string")).alias("phone"), F.col("city").alias("address"), "segment",
        F.when(F.col("balance") < 0, "high").otherwise("low").alias("risk_rating"), at.alias("created_at"), at.alias("updated_at"), at.alias("valid_from"), F.col("client_id").cast("string").alias("business_key"),
        (F.col("client_id") == F.col("master_id")).alias("is_current"), (F.col("nation_id") % 5 == 0).alias("is_deleted"),
    )
    return marts.stg_customers(held)


def _loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as loan applications: even keys are current, every eleventh is deleted."""
    o = table(spark, sf_dir, "orders")
    state = F.element_at(F.create_map(*(F.lit(x) for x in ("P", "submitted", "F", "approved", "O", "rejected"))), F.col("o_orderstatus"))
    return o.select(
        F.col("o_orderkey").alias("application_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("product"), F.col("o_totalprice").alias("amount"),
        (F.col("o_orderkey") % 48).alias("term_months"), state.alias("status"), (F.col("o_orderkey") % 500 + 300).alias("credit_score"), F.col("o_orderdate").alias("submitted_at"), F.col("o_orderdate").alias("updated_at"),
        (F.col("o_orderkey") % 2 == 0).alias("is_current"), (F.col("o_orderkey") % 11 == 0).alias("is_deleted"),
    )


_LOANS = """(select o_orderkey as application_id, o_custkey as customer_id, o_orderpriority as product, o_totalprice as amount, o_orderkey % 48 as term_months,
  case o_orderstatus when 'P' then 'submitted' when 'F' then 'approved' when 'O' then 'rejected' end as status, o_orderkey % 500 + 300 as credit_score, o_orderdate as submitted_at
  from orders where o_orderkey % 2 = 0 and o_orderkey % 11 <> 0)"""


@query(f"select * from {_LOANS}")
def stg_loan_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.stg_loan_applications(_loans(spark, sf_dir)).drop("updated_at")


@query(f"""
select product, count(*) as applications, count(*) filter (status = 'submitted') as submitted, cast(0 as bigint) as under_review, count(*) filter (status = 'approved') as approved,
  count(*) filter (status = 'rejected') as rejected, round(count(*) filter (status = 'approved') / nullif(count(*) filter (status in ('approved', 'rejected')), 0), 3) as approval_rate,
  round(avg(amount), 2) as avg_amount, round(avg(credit_score), 0) as avg_credit_score from {_LOANS} group by product
""")
def mart_loan_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.mart_loan_funnel(marts.stg_loan_applications(_loans(spark, sf_dir)))


@query("""
select l_orderkey * 10 + l_linenumber as transaction_id, l_suppkey as account_id, l_extendedprice as amount, 'JPY' as currency, l_returnflag as txn_type, 'part ' || l_partkey as counterparty,
  'line ' || l_linenumber as channel, l_linestatus as status, cast(l_shipdate as date) as booked_date from lineitem
""")
def stg_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"), F.col("l_suppkey").alias("account_id"), F.col("l_extendedprice").alias("amount"), F.lit("JPY").alias("currency"),
        F.col("l_returnflag").alias("txn_type"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("counterparty"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("channel"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("booked_at"),
    )
    return marts.stg_transactions(rows).drop("booked_at")


@query("""
select 'JPY' as base_currency, 'C' || n_nationkey as quote_currency, cast(n_nationkey * 0.5 + 2 as double) as rate, date '2024-01-01' + cast(d as int) as business_date from nation, range(3) t(d)
""")
def stg_fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of three days by currency, each sent twice; the later load wins."""
    sent = table(spark, sf_dir, "nation").select(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("quote_currency"), F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("d"))
    sent = sent.withColumn("_ingest_ts", F.explode(F.array(F.lit(1), F.lit(2))))
    rate = F.col("k") * F.lit(0.5) + F.col("_ingest_ts")
    return marts.stg_fx_rates(sent.select(F.lit("JPY").alias("base_currency"), "quote_currency", rate.alias("rate"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).cast("string").alias("business_date"), "_ingest_ts"))


# --- data quality -------------------------------------------------------------------------------

ORDER_SUITE = Suite.model_validate({
    "table": "orders", "layer": "silver", "filter": "o_totalprice > 1000",
    "checks": [
        {"type": "not_null", "column": "o_orderkey"},
        {"type": "accepted_values", "column": "o_orderstatus", "values": ["F", "O"]},
        {"type": "row_count_between", "min_rows": 1, "max_rows": 100},
        {"type": "freshness", "column": "o_orderdate", "max_age_hours": 48, "severity": "warn"},
        {"type": "unique", "columns": ["o_custkey", "o_orderstatus"]},
        {"type": "referential_integrity", "column": "o_custkey", "ref_table": "customer", "ref_column": "c_custkey", "ref_filter": "c_acctbal > 0", "severity": "warn"},
    ],
})

_DQ_PARTS = {
    "dq_not_null": ("0", "count(*) filter (o_orderkey is null)", "' null values'", "fail", "not_null(o_orderkey)"),
    "dq_accepted": ("1", "count(*) filter (o_orderstatus not in ('F', 'O'))", "' out-of-domain values'", "fail", "accepted_values(o_orderstatus)"),
    "dq_row_count": ("2", "count(*)", "' rows'", "fail", "row_count_between(1, 100)"),
    "dq_unique": ("4", "count(*) - count(distinct (o_custkey, o_orderstatus))", "' duplicate keys'", "fail", "unique(o_custkey, o_orderstatus)"),
    "dq_referential": ("5", "count(*) filter (o_custkey is not null and not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_acctbal > 0))", "' orphaned values'", "warn", "referential_integrity(o_custkey -> customer.c_custkey)"),
}


def _dq_sql(name: str) -> str:
    number, measure, what, bad, text = _DQ_PARTS[name]
    holds = "v between 1 and 100" if name == "dq_row_count" else "v = 0"
    if name == "dq_referential":
        inner = "select count(*) as v from orders o left join (select c_custkey from customer where c_acctbal > 0) c on c.c_custkey = o.o_custkey where o_totalprice > 1000 and c.c_custkey is null"
    else:
        inner = f"select {measure} as v from orders where o_totalprice > 1000"
    severity = "warn" if bad == "warn" else "error"
    return f"select cast({number} as int) as check_no, '{text}' as description, '{severity}' as severity, case when {holds} then 'pass' else '{bad}' end as status, {holds} as passed, v || {what} as observed from ({inner})"


def _dq_fresh_sql() -> str:
    hours = "(epoch_ms(timestamp '2030-01-01 00:00:00') - epoch_ms(max(o_orderdate))) / 3600000.0"
    return f"select cast(3 as int) as check_no, 'freshness(o_orderdate, 48h)' as description, 'warn' as severity, case when age <= 48 then 'pass' else 'warn' end as status, age <= 48 as passed, printf('latest event %.1fh old', age) as observed from (select {hours} as age from orders where o_totalprice > 1000)"


def _order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_suite(table(spark, sf_dir, "orders"), ORDER_SUITE, lambda name: table(spark, sf_dir, name), NOW)


def _one_check(number: int) -> Query:
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        suite = ORDER_SUITE.model_copy(update={"checks": [ORDER_SUITE.checks[number]]})
        return run_suite(table(spark, sf_dir, "orders"), suite, lambda name: table(spark, sf_dir, name), NOW).withColumn("check_no", F.lit(number))

    return one


for _name, (_number, *_) in _DQ_PARTS.items():
    _QUERIES[_name], _SQL[_name] = _one_check(int(_number)), _dq_sql(_name)
_QUERIES["dq_freshness"], _SQL["dq_freshness"] = _one_check(3), _dq_fresh_sql()
_EVERY_CHECK = " union all ".join([*(_dq_sql(n) for n in _DQ_PARTS), _dq_fresh_sql()])


@query(_EVERY_CHECK)
def dq_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_checks(spark, sf_dir)


@query(f"select count(*) filter (status = 'pass') as n_passed, count(*) filter (status = 'fail') as n_failed, count(*) filter (status = 'warn') as n_warned, count(*) filter (status = 'pass') / count(*) as pass_rate from ({_EVERY_CHECK})")
def dq_suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite_summary(_order_checks(spark, sf_dir))


# --- run metrics and detectors ------------------------------------------------------------------


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metrics from events: a run by day, a step by event type."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_type").alias("step")).agg(
        F.min("ts").alias("started_at"), F.count("*").alias("rows_read"), F.count_if(F.col("value") > 100).alias("rows_quarantined"), F.max("value").alias("duration_s"), F.sum(F.col("event_id") % 7).alias("h"),
    )
    return rows.select("run_id", F.lit("p").alias("pipeline"), "step", F.when(F.col("step") == "purchase", "gold").otherwise("silver").alias("layer"), F.when(F.col("h") % 5 == 0, "failed").otherwise("success").alias("status"), "started_at", "duration_s", "rows_read", (F.col("rows_read") - F.col("rows_quarantined")).alias("rows_written"), "rows_quarantined", F.when(F.col("h") % 5 == 0, "Boom").alias("error"))


_METRICS = """m as (select strftime(ts, '%Y-%m-%d') as run_id, event_type as step, min(ts) as started_at, count(*) as rows_read, count(*) filter (value > 100) as rows_quarantined,
  max(value) as duration_s, sum(event_id % 7) as h, case when event_type = 'purchase' then 'gold' else 'silver' end as layer, case when sum(event_id % 7) % 5 = 0 then 'failed' else 'success' end as status
  from events group by 1, 2),
last as (select arg_max(run_id, started_at) as run_id from m), run as (select * from m where run_id in (select run_id from last)), hist as (select * from m where run_id not in (select run_id from last))"""

_FAILED = "select case when layer = 'gold' then 'critical' else 'high' end as severity, 'Pipeline step failed: p/' || step as title, 'p/' || step as affected from run where status = 'failed'"
_SPIKES = """select 'medium' as severity, 'Quarantine spike in p/' || step as title, step as affected from (select run.*, case when n >= 3 then mean + greatest(2 * sd, 0.01) else 0.05 end as threshold
  from run left join (select step, count(*) as n, avg(rows_quarantined / rows_read) as mean, stddev_pop(rows_quarantined / rows_read) as sd from hist where rows_read > 0 group by step) b using (step))
  where rows_quarantined > 0 and rows_quarantined / rows_read > threshold"""
_SLOW = """select 'low' as severity, 'Duration anomaly in p/' || step as title, step as affected from run
  join (select step, count(*) as n, avg(duration_s) as mean, stddev_pop(duration_s) as sd from hist group by step) b using (step) where n >= 3 and duration_s > mean + greatest(3 * sd, 0.5)"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("severity", "title", "affected")


@query(f"with {_METRICS} select run_id, min(started_at) as started_at, cast(sum(rows_read - rows_quarantined) as bigint) as rows_written, count(*) filter (status = 'failed') as failed_steps from m group by 1")
def runs_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.runs_over_time(_metrics(spark, sf_dir))


@query(f"with {_METRICS} select run_id, step, status, started_at, rows_read from run")
def latest_run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latest_run(_metrics(spark, sf_dir)).select("run_id", "step", "status", "started_at", "rows_read")


@query(f"with {_METRICS} select count(*) as steps, count(*) filter (status = 'failed') as failed_steps, cast(sum(rows_read - rows_quarantined) as bigint) as rows_written, cast(sum(rows_quarantined) as bigint) as rows_quarantined from run")
def run_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.run_kpis(M.latest_run(_metrics(spark, sf_dir)))


@query(f"with {_METRICS} {_FAILED.replace('from run', 'from m')}")
def failed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(D.failed_steps(_metrics(spark, sf_dir)))


def _every_run_against_history(sql: str) -> str:
    """A detector's SQL with all runs as the one looked at, and those of odd days as history."""
    return f"with {_METRICS.replace('run as (select * from m where run_id in (select run_id from last))', 'run as (select * from m)').replace('hist as (select * from m where run_id not in (select run_id from last))', 'hist as (select * from m where cast(right(run_id, 2) as int) % 2 = 1)')} {sql}"


def _kept_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run metrics as a table, so that detectors don't work them out anew."""
    folder = scratch_folder(spark, "run-metrics")
    _metrics(spark, sf_dir).write.parquet(folder)
    return spark.read.parquet(folder)


def _last_and_past(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(the last run's rows, what is merged from the moments of each other run)."""
    run, history = D.split_runs(_kept_metrics(spark, sf_dir))
    return run, D.merged(D.moments(history, "run_id"))


def _odd_days(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.right("run_id", F.lit(2)).cast("int") % 2 == 1)


@query(_every_run_against_history(_SPIKES))
def quarantine_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _kept_metrics(spark, sf_dir)
    return _shown(D.quarantine_spikes(m, D.merged(D.moments(_odd_days(m), "run_id"))))


@query(_every_run_against_history(_SLOW))
def duration_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _kept_metrics(spark, sf_dir)
    return _shown(D.duration_anomalies(m, D.merged(D.moments(_odd_days(m), "run_id"))))


@query(f"""with {_METRICS}, f as ({_FAILED} union all {_SPIKES} union all {_SLOW}
  union all select case status when 'fail' then 'high' else case when description like 'referential_integrity%' then 'medium' else 'low' end end, case status when 'fail' then 'DQ check failed on orders: ' else 'DQ warning on orders: ' end || description, 'orders' from ({_EVERY_CHECK}) where status <> 'pass')
select severity, title, affected from f""")
def incident_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(D.all_findings(*_last_and_past(spark, sf_dir), _order_checks(spark, sf_dir).withColumn("table", F.lit("orders"))))


_STATUS = """case min(case severity when 'critical' then 1 when 'high' then 2 when 'medium' then 3 when 'low' then 4 end) when 1 then 'SEV-1 CANDIDATE' when 2 then 'SEV-2 CANDIDATE'
  when 3 then 'SEV-3 / DEGRADED' when 4 then 'HEALTHY WITH NOTES' else 'HEALTHY' end"""


@query(f"with {_METRICS}, f as ({_FAILED} union all {_SPIKES} union all {_SLOW}) select {_STATUS} as status, count(*) as n_findings from f")
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.overall_status(D.all_findings(*_last_and_past(spark, sf_dir)))


@query(f"with {_METRICS} select severity, count(*) as n from ({_FAILED.replace('from run', 'from m')}) group by 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.severity_counts(D.failed_steps(_metrics(spark, sf_dir)))


# --- retrieval and governance -------------------------------------------------------------------


@query("""
with q as (select cast(embedding as double[]) as qe from embeddings where vec_id = 0), s as (select vec_id, list_inner_product(cast(embedding as double[]), qe) as score from embeddings, q)
select vec_id, round(score, 9) as score from s order by s.score desc, vec_id desc limit 10
""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id = 0").first()["embedding"]
    return index.top_k(e, asked, 10, "embedding", "vec_id").select("vec_id", F.round("score", 9).alias("score"))


@query("""
with q as (select vec_id as question, cast(embedding as double[]) as qe from embeddings where vec_id % 20 = 0), r as (select vec_id as id, cast(embedding as double[]) as e from embeddings where embedding is not null),
s as (select question, id, list_inner_product(e, qe) as score from r, q where qe is not null),
k as (select *, cast(row_number() over (partition by question order by score desc, id desc) as int) as rank from s)
select question, id, round(score, 9) as score, rank from k where rank <= 10
""")
def vector_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for each whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    return index.top_k_many(e, e.where("vec_id % 20 = 0"), 10, "embedding", "vec_id").withColumn("score", F.round("score", 9))


def _pages_as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a Markdown frame: the first line under a title, the rest as paragraphs."""
    d = table(spark, sf_dir, "documents")
    body = F.regexp_replace(F.regexp_replace("text", "#", ""), "\n", "\n\n")
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_slug"), F.concat(F.lit("# Title "), F.col("source"), F.lit("\n\nIntro.\n\n## Body Part\n\n"), body).alias("text"))


#: White space, as Java's patterns have it, and a text without it at either end.
_SPACE = r"[\t\n\x0B\f\r ]+"


def _stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACE}|{_SPACE}$', '', 'g')"


@query(f"""
with recursive d as (select 'doc-' || doc_id as slug, 'Title ' || source as title, {_stripped("replace(replace(text, '#', ''), chr(10), chr(10) || chr(10))")} as body from documents),
p as (select slug, body, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda x: {_stripped("x")}), lambda x: x <> '') as ps from d where length(body) > {chunks.MAX_CHARS}),
walk as (select slug, ps, 0 as k, '' as held, cast(null as varchar) as done from p
  union all select slug, ps, k + 1, case when full_up then right(held, {chunks.OVERLAP}) || chr(10) || chr(10) else held end || ps[k + 1] || chr(10) || chr(10), case when full_up then held end
  from (select *, held <> '' and length(held) + length(ps[k + 1]) + 2 > {chunks.MAX_CHARS} as full_up from walk where k < len(ps))),
long as (select slug, k, {_stripped("done")} as text from walk where done is not null union all select slug, k + 1, {_stripped("held")} from walk where k = len(ps)),
pieces as (select slug, row_number() over (partition by slug order by k) - 1 as piece, text from long
  union all select slug, 0, body from d where body <> '' and length(body) <= {chunks.MAX_CHARS}),
every as (select slug, title as heading, 0 as piece, 'Intro.' as text from d where body is not null union all select slug, 'Body Part', piece, text from pieces)
select e.slug || '/' || trim(regexp_replace(lower(e.heading), '[^a-z0-9]+', '-', 'g'), '-') || case when piece > 0 then '-' || piece else '' end as chunk_id,
  title as doc_title, e.heading, length(e.text) as n_chars, sha256(e.text) as text_sha256 from every e join d using (slug)
""")
def chunk_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_documents(_pages_as_markdown(spark, sf_dir)).select("chunk_id", "doc_title", "heading", F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query()
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = embed.embedded(F.col("text"), embed.HashingEmbedder())
    rows = table(spark, sf_dir, "documents").select("doc_id", made.alias("vec"))
    filled = F.filter(F.sequence(F.lit(0), F.size("vec") - 1), lambda i: F.col("vec")[i] > 0)
    return rows.select("doc_id", F.size("vec").alias("dim"), F.round(dot(F.col("vec"), F.col("vec")), 4).alias("norm"), F.size(filled).alias("filled"), F.array_join(filled.cast("array<string>"), ",").alias("buckets"))


@query("""
with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from documents),
s as (select doc_id, word, n, unnest(range(1, greatest(length(word) + 4 - n, 2))) as i from w, (values (3), (4), (5)) t(n)),
g as (select doc_id, substr('^' || word || '$', cast(i as int), n) as gram from s)
select gram, count(*) as n, count(distinct doc_id) as docs from g group by gram
""")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.gram_counts(table(spark, sf_dir, "documents"))


@query("""
with held as (select coalesce(source, '') as principal, coalesce(segment, '') as securable, op from client_changes),
cells as (select principal, securable, string_agg(distinct op, ', ' order by op) as shown from held where op is not null group by 1, 2)
select principal, case when min(n) over () > 0 then 'source' end as kind, coalesce(export, '—') as export, coalesce(online, '—') as online, coalesce(public, '—') as public, coalesce(retail, '—') as retail, coalesce(wholesale, '—') as wholesale
from (select principal, count(*) as n, max(shown) filter (securable = 'export') as export, max(shown) filter (securable = 'online') as online, max(shown) filter (securable = 'public') as public,
  max(shown) filter (securable = 'retail') as retail, max(shown) filter (securable = 'wholesale') as wholesale from (select distinct principal from held) p left join cells using (principal) group by principal)
""")
def grants_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source does to clients of each segment, as a matrix: the kinds of its changes stand for privileges."""
    c = table(spark, sf_dir, "client_changes").select(F.coalesce("source", F.lit("")).alias("principal"), F.coalesce("segment", F.lit("")).alias("securable"), "op")
    held = c.groupBy("principal", "securable").agg(F.sort_array(F.collect_set("op")).alias("privileges"))
    return privileges_by_principal(c.select("principal", F.lit("source").alias("kind")).distinct(), held, ("export", "online", "public", "retail", "wholesale"))


@query("""
select 'name' as column_name, 'direct_identifier' as category, count(name) as filled, count(distinct name) as distinct_values from clients union all select 'email', 'direct_identifier', count(email), count(distinct email) from clients
union all select 'city', 'quasi_identifier', count(city), count(distinct city) from clients union all select 'balance', 'financial', count(balance), count(distinct balance) from clients
""")
def pii_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged columns of clients, and how many values of them the table holds."""
    return pii_in_rows(table(spark, sf_dir, "clients"), {"name": "direct_identifier", "email": "direct_identifier", "city": "quasi_identifier", "balance": "financial"})


# --- streaming and tables -----------------------------------------------------------------------


@query("""
select case when event_id % 20 between 0 and 9 then '_quarantine' else 'events' end as table_name, count(*) as n from events where event_id % 3 <> 0 or event_id % 20 between 0 and 9 group by 1
""")
def stream_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines in files, taken in by the streaming ingest twice; rows by table. The second time finds nothing new.

    Valid lines of an entity that nobody configured go nowhere, unless the ingest is told to be strict.
    """
    folder = scratch_folder(spark, "stream")
    for entity in ("events", "orders"):
        _lines(spark, sf_dir).where(F.col("entity") == entity).select("raw_value").write.text(f"{folder}/cdc/{entity}")
    config = Config(source=Source(cdc_landing_dir=f"{folder}/cdc", cdc_pattern="*.txt"), storage=Storage(lakehouse_root=f"{folder}/lake", checkpoints_dir=f"{folder}/checkpoints"), entities=[Entity(name="events", primary_key="event_id", scd="type2")])
    run_stream(spark, config, "run-1")
    run_stream(spark, config, "run-2")
    read = lambda name: bronze(spark, config).read(name).select(F.lit(name).alias("table_name"))
    return read("events").union(read("_quarantine")).groupBy("table_name").agg(F.count("*").alias("n"))


@query("select c_custkey, case when c_custkey % 2 = 0 then 'new' else c_mktsegment end as segment, c_custkey % 2 = 0 as seen from customer where c_custkey % 3 <> 0 or c_custkey % 2 = 0")
def table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A versioned table: two thirds of the customers, into which the even ones are merged with a new column."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    held = Table(spark, scratch_folder(spark, "table"))
    held.append(c.where("c_custkey % 3 <> 0"))
    held.merge(c.where("c_custkey % 2 = 0").withColumns({"segment": F.lit("new"), "seen": F.lit(True)}), ["c_custkey"], ["segment", "seen"])
    return held.read().select("c_custkey", "segment", F.coalesce("seen", F.lit(False)).alias("seen"))


@query("select s_suppkey, s_acctbal from supplier where s_acctbal > 0")
def table_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A versioned table that is replaced while its rows are read; the first version can be read on."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    held = Table(spark, scratch_folder(spark, "replaced"))
    held.append(s)
    held.overwrite(held.read().where("s_acctbal > 0"), on=held.latest())
    if held.read(1).count() != s.count():
        raise RuntimeError("the first version is gone")
    return held.read()


@query("""
select 'load' as step, 'success' as status, (select count(*) from nation) as rows_read, cast(null as bigint) as rows_written, cast(null as varchar) as error
union all select 'build', 'failed', null, (select count(*) from region), 'ValueError: broken'
""")
def run_metrics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step that succeeds and one that fails, as the metrics table and its export have them."""
    lake = scratch_folder(spark, "metrics")
    with M.track_step(spark, lake, "run", "p", "load", "bronze") as step:
        step.rows_read = table(spark, sf_dir, "nation").count()
    try:
        with M.track_step(spark, lake, "run", "p", "build", "gold") as step:
            step.rows_written = table(spark, sf_dir, "region").count()
            raise ValueError("broken")
    except ValueError:
        M.export_metrics(spark, lake, f"{lake}/export")
    return spark.read.parquet(f"{lake}/export").select("step", "status", "rows_read", "rows_written", "error")


@query("select n_nationkey, n_name, n_regionkey, 'run' as _run_id from nation")
def copy_into_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations landed as CSV files and loaded by the ledger, twice; the second load adds nothing. CSV columns are strings."""
    folder = scratch_folder(spark, "copy")
    table(spark, sf_dir, "nation").write.option("header", "true").csv(f"{folder}/landing/nation")
    feeds = {"nation": Feed("csv", "*.csv", {"header": "true"})}
    for _ in range(2):
        copy_into(spark, f"{folder}/landing", f"{folder}/lake", "run", feeds)
    rows = Table(spark, f"{folder}/lake/nation").read()
    return rows.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"), "_run_id")


@query("select p_partkey, p_name, p_brand, p_size, cast(4 as bigint) as n_files from part")
def copy_into_odd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in four files whose names and folder have blanks, percent signs and letters beyond ASCII, loaded twice: by a URI, then by a path."""
    folder = scratch_folder(spark, "odd names %20 é")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    rows.repartition(4, "p_partkey").write.option("header", "true").csv(f"{folder}/landing/part")
    files = Files(spark, f"{folder}/landing/part")
    for old, new in zip([n for n in files.names("") if n.startswith("part-")], ("a b.csv", "a%41.csv", "a+b%20.csv", "日 é.csv"), strict=True):
        files.rename(old, new)
    feeds = {"part": Feed("csv", "*.csv", {"header": "true"})}
    for root in (folder if ":" in folder else f"file:{folder}", folder):
        copy_into(spark, f"{root}/landing", f"{folder}/lake", "run", feeds)
    ledger = Table(spark, f"{folder}/lake/_copy_ledger").read().where("rows_loaded > 0").agg(F.count("*").alias("n_files"))
    loaded = Table(spark, f"{folder}/lake/part").read().select(F.col("p_partkey").cast(rows.schema["p_partkey"].dataType).alias("p_partkey"), "p_name", "p_brand", F.col("p_size").cast(rows.schema["p_size"].dataType).alias("p_size"))
    return loaded.withColumn("n_files", F.lit(ledger.first()["n_files"]))


@query("select c_custkey, case when c_custkey % 100 = 0 then 'new' else c_mktsegment end as segment from customer")
def table_merge_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in buckets of its keys, into which a hundredth of the keys is merged: only the buckets of these are read and written."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    held = Table(spark, scratch_folder(spark, "touched"))
    held.overwrite(c, layout=Layout(("c_custkey",)))
    held.merge(c.where("c_custkey % 100 = 0").withColumn("segment", F.lit("new")), ["c_custkey"], ["segment"])
    return held.read()


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, true as sized from lineitem")
def export_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items exported from a table in files of half a megabyte: as many as their bytes ask for, and all rows."""
    folder, size = scratch_folder(spark, "export"), 1 << 19
    held = Table(spark, f"{folder}/table")
    held.append(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    n = export_table(held, f"{folder}/out", size)
    files = [x for x in Files(spark, f"{folder}/out").names("") if x.startswith("part-")]
    out = spark.read.parquet(f"{folder}/out")
    return out.withColumn("sized", F.lit(len(files) == max(1, -(-held.bytes() // size)) and n == held.read().count()))
