"""Queries W1-W7: the event table read as a stream and drained to files.

The reference SQL keeps what the watermark lets through: windows that end before
the newest event minus the allowed delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.plans.registry import query
from faultline.plans.signal_queries import rounded
from faultline.plans.views import Telemetry, derive_span_events, log_columns
from faultline.streaming import jobs, silence


def event_stream(t: Telemetry) -> DataFrame:
    schema = t.table("events").schema
    return t.spark.readStream.schema(schema).parquet(f"{t.dir}/events.parquet*")


def span_stream(t: Telemetry) -> DataFrame:
    return derive_span_events(event_stream(t)).withColumn("event_ts", F.col("ts").cast("timestamp")).drop("ts")


def log_stream(t: Telemetry) -> DataFrame:
    return derive_span_events(event_stream(t)).select(*log_columns(), "span_id", F.col("ts").cast("timestamp").alias("event_ts"))


def epoch(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def streaming_views(*extra: tuple[str, str], body: str) -> str:
    """Span rows with their timestamp, and the final watermark in microseconds."""
    from faultline.plans.views import with_views

    ctes = {
        "se": "select s.*, epoch_us(e.ts) as us from spanev s join events e using (event_id)",
        "mark": "select (max(epoch_us(ts)) // 1000) * 1000 - 60000000 as m from events",
    }
    return with_views("spanev", "logs", extra=ctes | dict(extra), body=body)


@query("w1_windowed_red", streaming_views(
    ("slots", "select *, (us // 15000000) * 15 - 15 * k as ws from se, range(12) r(k) where (us // 15000000) * 15 - 15 * k + 180 > us / 1000000.0"),
    body="""select incident_id, service, ws as window_start, ws + 180 as window_end, count(*) as requests, round(count(*) filter (where status='ERROR') / count(*), 6) as error_rate,
  round(list_sort(list(duration_ms))[cast(ceil(cast(0.95 as double) * count(*)) as bigint)], 6) as p95_ms, round(max(duration_ms), 6) as max_ms from slots where (ws + 180) * 1000000 <= (select m from mark) group by 1, 2, 3, 4"""))
def _(t: Telemetry) -> DataFrame:
    found = jobs.run_available(jobs.windowed_red(span_stream(t)), "red")
    return rounded(epoch(found, "window_start", "window_end"), "error_rate", "p95_ms", "max_ms")


@query("w2_level_counts", streaming_views(("lg", "select l.*, epoch_us(e.ts) as us from logs l join events e on l.span_id = concat('s', cast(e.event_id as varchar))"), body="""
select incident_id, (us // 3600000000) * 3600 as window_start, lower(severity) as level, count(*) as count from lg
where ((us // 3600000000) + 1) * 3600000000 <= (select m from mark) group by all"""))
def _(t: Telemetry) -> DataFrame:
    return epoch(jobs.run_available(jobs.level_counts(log_stream(t), bucket="1 hour"), "levels"), "window_start")


@query("w3_streaming_dedup", streaming_views(body="select incident_id, span_id, time, service from se"))
def _(t: Telemetry) -> DataFrame:
    copies = span_stream(t).withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(1) + F.col("time") % 5))).drop("_c")
    return jobs.run_available(jobs.dedup_spans(copies), "dedup").select("incident_id", "span_id", "time", "service")


_STREAM_RULES = [(1, "duration", 150.0, ">", 7200), (2, "duration", 90.0, "<=", 10800)]


@query("w4_stateful_alerts", streaming_views(
    ("top", "select incident_id, (us // 3600000000) * 3600 as ts, max(duration_ms) as value from se where ((us // 3600000000) + 1) * 3600000000 <= (select m from mark) group by 1, 2"),
    ("hits", """select *, case rule_id when 1 then value > 150.0 else value <= 90.0 end as hit from top, (values (1, 7200), (2, 10800)) r(rule_id, need)"""),
    ("runs", "select *, sum((not hit)::int) over (partition by incident_id, rule_id order by ts) as run from hits"),
    ("spans2", "select incident_id, rule_id, run, min(ts) as start, max(ts) - min(ts) as lasted, arg_min(value, ts) as value, max(need) as need from runs where hit group by 1, 2, 3"),
    body="select incident_id, rule_id, min(start) as fired_epoch, round(arg_min(value, start), 6) as value from spans2 where lasted >= need group by 1, 2"))
def _(t: Telemetry) -> DataFrame:
    points = span_stream(t).select("incident_id", F.lit("duration").alias("metric"), "event_ts", F.col("duration_ms").alias("value"))
    rules = t.spark.createDataFrame(_STREAM_RULES, "rule_id int, metric string, threshold double, comparison string, for_seconds int")
    maxima = jobs.step_maxima(points, step="1 hour")
    samples = t.spark.readStream.schema(maxima.schema).parquet(jobs.drain(maxima, "maxima"))
    return rounded(jobs.run_available(jobs.sustained_alerts(samples, rules), "alerts"), "value")


@query("w5_activity_sessions", streaming_views(
    ("g", "select *, case when us - lag(us) over w < 3600000000 then 0 else 1 end as new from se window w as (partition by incident_id, service order by us)"),
    ("s", "select *, sum(new) over (partition by incident_id, service order by us rows unbounded preceding) as sid from g"),
    body="""select incident_id, service, min(us) // 1000000 as active_from, max(us) // 1000000 as last_seen, count(*) as spans from s group by incident_id, service, sid
having max(us) + 3600000000 <= (select m from mark)"""))
def _(t: Telemetry) -> DataFrame:
    return epoch(jobs.run_available(jobs.activity_sessions(span_stream(t), gap="1 hour"), "sessions"), "active_from", "last_seen")


@query("w5_silences", streaming_views(
    ("pane", """select incident_id, service, us // 15000000 as p, min(us) as first, max(us) as last from se
      where (us // 15000000 + 1) * 15000000 <= (select m from mark) group by 1, 2, 3"""),
    ("g", "select *, lead(first) over (partition by incident_id, service order by p) as next from pane"),
    body="""select incident_id, service, last as silent_since, next as resumed_at from g where next - last > 3600000000
union all select incident_id, service, last, null from g where next is null and last + 3600000000 < (select m from mark)"""))
def _(t: Telemetry) -> DataFrame:
    return jobs.run_available(silence.silences(span_stream(t), gap_seconds=3600), "silences", timers=True)


_TTL_SECONDS = 2 * 86400


@query("w6_journal_stream", streaming_views(
    ("jr", """select concat('act_', cast(user_id as varchar)) as action_id, event_id as seq, value < 40 as ok, epoch_us(ts) // 1000 as ms,
      case event_type when 'signup' then 'proposed' when 'view' then 'posted' when 'click' then 'approved' when 'purchase' then 'execute_started' else 'execute_result' end as kind from events"""),
    ("p", f"select action_id, max(seq) as p, arg_max(ms, seq) + {_TTL_SECONDS * 1000} as due from jr where kind='proposed' group by 1"),
    ("e", "select action_id, min(seq) as e from jr join p using (action_id) where seq > p and ms > due group by 1"),
    ("j", "select jr.*, p, due, coalesce(e, 9223372036854775807) as e from jr join p using (action_id) left join e using (action_id)"),
    ("d", "select action_id, min(seq) as d from j where kind='approved' and seq > p and seq < e group by 1"),
    ("x", "select action_id, min(seq) as x from j join d using (action_id) where kind='execute_started' and seq > d and seq < e group by 1"),
    ("r", "select action_id, arg_min(ok, seq) as ok, min(seq) as r from j join x using (action_id) where kind='execute_result' and seq > x group by 1"),
    ("o", "select distinct action_id, true as posted from j where kind='posted' and seq > p and seq < e"),
    body="""select action_id, case when r is not null then case when ok then 'done' else 'failed' end when x is not null then 'executing'
  when e.e is not null or due < (select m // 1000 from mark) then 'expired' when d is not null then 'approved' when posted then 'posted' else 'proposed' end as status
  from p left join e using (action_id) left join d using (action_id) left join x using (action_id) left join r using (action_id) left join o using (action_id)"""))
def _(t: Telemetry) -> DataFrame:
    kinds = F.create_map(*[F.lit(v) for v in ("signup", "proposed", "view", "posted", "click", "approved", "purchase", "execute_started")])
    events = event_stream(t).select(
        F.concat(F.lit("act_"), F.col("user_id").cast("string")).alias("action_id"), F.col("event_id").alias("seq"),
        F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("execute_result")).alias("kind"), (F.col("value") < 40).alias("ok"),
        F.col("ts").cast("timestamp").alias("event_ts"))
    moves = jobs.run_available(jobs.journal_transitions(events, ttl_seconds=_TTL_SECONDS), "journal")
    # An action expires at the last transition it had, so the order tells the two apart.
    return moves.groupBy("action_id").agg(F.max_by("status", F.struct("seq", F.col("status") == "expired")).alias("status"))


@query("w7_log_enrichment", streaming_views(
    ("lg", "select l.*, epoch_us(e.ts) as us from logs l join events e on l.span_id = concat('s', cast(e.event_id as varchar))"), body="""
select l.incident_id, l.trace_id, s.span_id, s.service, l.message from lg l join se s on s.incident_id=l.incident_id and s.trace_id=l.trace_id and l.us between s.us and s.us + 300000000"""))
def _(t: Telemetry) -> DataFrame:
    logs, spans = log_stream(t), span_stream(t)
    joined = jobs.run_available(jobs.enrich_logs(logs, spans), "enrich")
    return joined.select("incident_id", "trace_id", "span_id", "service", "message")
