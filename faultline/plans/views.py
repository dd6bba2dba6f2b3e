"""Telemetry views derived from the test tables: SQL for the oracle, frames for Spark."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.session import store

# Each entry runs unchanged in Spark and in DuckDB.
_CTES = {
    "ev": """
select event_id, user_id, event_type, value, t, pos, tpl, tr,
       cast(floor(t/432000) as bigint) as inc,
       t - 432000*cast(floor(t/432000) as bigint) as time
from (select event_id, user_id, event_type, value,
        cast((day(ts)-1)*86400 + hour(ts)*3600 + minute(ts)*60 + second(ts) as bigint) as t,
        cast(event_id - 8*cast(floor(event_id/8) as bigint) as int) as pos,
        cast(cast(floor(event_id/8) as bigint) % 3 as int) as tpl,
        cast(floor(event_id/8) as bigint) as tr
      from events)""",
    "spanev": """
select concat('inc_', cast(inc as string)) as incident_id, concat('t', cast(tr as string)) as trace_id,
  concat('s', cast(event_id as string)) as span_id,
  case pos when 0 then null when 1 then concat('s',cast(event_id-1 as string)) when 2 then concat('s',cast(event_id-1 as string))
    when 3 then concat('s',cast(event_id-1 as string)) when 4 then concat('s',cast(event_id-1 as string))
    when 5 then concat('s',cast(event_id-3 as string)) when 6 then concat('s',cast(event_id-1 as string)) else concat('s',cast(event_id-7 as string)) end as parent_span_id,
  time, service, operation, span_kind,
  value * (case when time>=216000 and fault then 5 else 1 end) as duration_ms,
  case when event_type='error' and (value>60 or (time>=216000 and fault)) then 'ERROR' else 'OK' end as status,
  event_type, user_id, event_id
from (select *, service = (case inc when 0 then 'payment' when 1 then 'cart' when 2 then 'checkout' when 3 then 'ad' when 4 then 'currency' else 'shipping' end) as fault from (
 select *, case when pos in (0,1,7) then 'frontend'
   when pos in (2,3,5) then (case tpl when 0 then 'checkout' when 1 then 'cart' else 'recommendation' end)
   when pos=4 then (case tpl when 0 then 'payment' when 1 then 'currency' else 'product-catalog' end)
   else (case tpl when 0 then 'shipping' when 1 then 'ad' else 'product-catalog' end) end as service,
  case when pos in (0,2,4,6) then 'server' else 'client' end as span_kind,
  case when pos=7 then 'oteldemo.AdService/GetAds' when pos=3 and tpl=0 then 'oteldemo.PaymentService/Charge' else concat('op', cast(pos as string)) end as operation
 from ev))""",
    "spans": """
select incident_id, trace_id, span_id, parent_span_id, time, service, operation, span_kind, duration_ms, status from spanev""",
    "metrics": """
select incident_id, service, metric, bucket*7200 as time, value from (
 select incident_id, service, cast(floor(time/7200) as bigint) bucket, 'request_error_rate' as metric, avg(case when status='ERROR' then 1.0e0 else 0.0e0 end) as value from spans group by 1,2,3,4
 union all
 select incident_id, service, cast(floor(time/7200) as bigint) bucket, 'latency_p95_ms' as metric, max(duration_ms) as value from spans group by 1,2,3,4
 union all
 select incident_id, service, cast(floor(time/7200) as bigint) bucket, 'cpu_cores' as metric, sum(duration_ms)/100 as value from spans group by 1,2,3,4)""",
    "changes": """
select concat('inc_', cast(o_orderkey % 6 as string)) as incident_id, concat('chg_', cast(o_orderkey as string)) as id,
  cast((o_custkey*7919) % 432000 as bigint) as time,
  case o_orderkey % 5 when 0 then 'payment' when 1 then 'cart' when 2 then 'checkout' when 3 then 'ad' else 'shipping' end as service,
  case when o_orderstatus='F' then 'deploy' else 'runtime_config_change' end as kind, o_orderpriority as summary
 from orders""",
    "logs": """
select incident_id, time, service,
  case event_type when 'error' then 'ERROR' when 'signup' then 'Warn' when 'view' then 'info' when 'click' then 'INFO' else 'debug' end as severity,
  concat(event_type, ' in ', operation, ' for user ', cast(user_id as string), ' req ', substr(md5(cast(user_id as string)),1,12)) as message,
  trace_id, span_id
 from spanev""",
    "incidents": """
select distinct incident_id, cast(0 as bigint) as window_start, cast(432000 as bigint) as window_end, cast(216000 as bigint) as onset_second from spans""",
    "truth": """
select incident_id, 'service' as kind, case incident_id when 'inc_0' then 'payment' when 'inc_1' then 'cart' when 'inc_2' then 'checkout' when 'inc_3' then 'ad' when 'inc_4' then 'currency' else 'shipping' end as service from incidents""",
    "graded_runs": """
select concat('scn_', cast(o_custkey % 12 as string)) as scenario_id, o_orderkey as run_id,
 o_orderstatus='F' as correct, o_orderstatus<>'P' as location_correct, o_orderpriority<>'5-LOW' as culprit_correct,
 o_orderpriority='2-HIGH' as decoys_ruled_out, o_orderpriority='1-URGENT' as type_match,
 o_totalprice/100000 as cost, cast(o_orderkey % 60 as bigint) as calls from orders""",
    "journal": """
select concat('act_', cast(user_id as string)) as action_id, event_id as seq,
 case event_type when 'signup' then 'proposed' when 'view' then 'posted' when 'click' then 'approved' when 'purchase' then 'execute_started' else 'execute_result' end as kind,
 value < 40 as ok from events""",
}

_ORDER = list(_CTES)
_NEEDS = {
    "ev": [], "spanev": ["ev"], "spans": ["spanev"], "metrics": ["spans"], "changes": [], "logs": ["spanev"],
    "incidents": ["spans"], "truth": ["incidents"], "graded_runs": [], "journal": [],
}


def with_views(*names: str, extra: dict[str, str] | None = None, body: str) -> str:
    """A query whose WITH clause holds the named views, what they need, and ``extra``."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        wanted.add(name)
        for needed in _NEEDS[name]:
            add(needed)

    for n in names:
        add(n)
    parts = [f"{n} as ({_CTES[n].strip()})" for n in _ORDER if n in wanted]
    parts += [f"{n} as ({sql.strip()})" for n, sql in (extra or {}).items()]
    return f"with recursive {', '.join(parts)}\n{body.strip()}" if parts else body.strip()


STATIC_EDGES = [
    ("frontend", "checkout"), ("frontend", "cart"), ("frontend", "recommendation"), ("checkout", "payment"),
    ("checkout", "shipping"), ("cart", "ad"), ("cart", "currency"), ("recommendation", "product-catalog"),
]


# fixed values of the test views: parent distance, service per position and template, planted faults
PARENT_OFFSET = [None, 1, 1, 1, 1, 3, 1, 7]
SERVICE_BY_POSITION = [
    ("frontend", "frontend", "frontend"), ("frontend", "frontend", "frontend"),
    ("checkout", "cart", "recommendation"), ("checkout", "cart", "recommendation"),
    ("payment", "currency", "product-catalog"), ("checkout", "cart", "recommendation"),
    ("shipping", "ad", "product-catalog"), ("frontend", "frontend", "frontend"),
]
FAULT_BY_INCIDENT = ["payment", "cart", "checkout", "ad", "currency"]
SEVERITY_BY_EVENT = {"error": "ERROR", "signup": "Warn", "view": "info", "click": "INFO"}


def log_columns() -> list[Column]:
    """Columns of the ``logs`` view over ``span_events``."""
    user = F.col("user_id").cast("string")
    names = F.create_map(*[F.lit(x) for pair in SEVERITY_BY_EVENT.items() for x in pair])
    severity = F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("debug"))
    message = F.concat("event_type", F.lit(" in "), "operation", F.lit(" for user "), user, F.lit(" req "), F.substring(F.md5(user), 1, 12))
    return [F.col("incident_id"), F.col("time"), F.col("service"), severity.alias("severity"), message.alias("message"), F.col("trace_id")]


def derive_span_events(events: DataFrame) -> DataFrame:
    """The ``spanev`` view over a batch or streaming events frame, with ``ts`` kept.

    Array look-ups stand where the SQL has CASE chains: same rows, and the short
    expressions keep planning of the operators quick.
    """
    def pick(values: list, index: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))

    ts = F.col("ts")
    second = (F.dayofmonth(ts) - 1) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    group = F.floor(F.col("event_id") / 8)
    ev = events.select(
        "ts", "event_id", "user_id", "event_type", "value", second.cast("long").alias("t"),
        (F.col("event_id") % 8).alias("pos"), (group % 3).alias("tpl"), group.alias("tr"))
    ev = ev.withColumns({"inc": F.floor(F.col("t") / 432000), "time": F.col("t") % 432000})
    service = pick([name for row in SERVICE_BY_POSITION for name in row], F.col("pos") * 3 + F.col("tpl"))
    ev = ev.withColumn("service", service)
    broken = F.coalesce(pick(FAULT_BY_INCIDENT, F.col("inc")), F.lit("shipping")) == F.col("service")
    ev = ev.withColumn("fault", broken & (F.col("time") >= 216000))
    parent = F.concat(F.lit("s"), (F.col("event_id") - pick(PARENT_OFFSET, F.col("pos"))).cast("string"))
    operation = (
        F.when(F.col("pos") == 7, "oteldemo.AdService/GetAds")
        .when((F.col("pos") == 3) & (F.col("tpl") == 0), "oteldemo.PaymentService/Charge")
        .otherwise(F.concat(F.lit("op"), F.col("pos").cast("string"))))
    failed = (F.col("event_type") == "error") & ((F.col("value") > 60) | F.col("fault"))
    return ev.select(
        F.concat(F.lit("inc_"), F.col("inc").cast("string")).alias("incident_id"),
        F.concat(F.lit("t"), F.col("tr").cast("string")).alias("trace_id"),
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("span_id"), parent.alias("parent_span_id"),
        "time", "service", operation.alias("operation"),
        F.when(F.col("pos").isin(0, 2, 4, 6), "server").otherwise("client").alias("span_kind"),
        (F.col("value") * F.when(F.col("fault"), 5).otherwise(1)).alias("duration_ms"),
        F.when(failed, "ERROR").otherwise("OK").alias("status"), "event_type", "user_id", "event_id", "ts")


class Telemetry:
    """Lazy canonical frames over one test folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _sql(self, name: str, source: str, cols: str = "*") -> DataFrame:
        sql = with_views(name, body=f"select {cols} from {name}").replace("with recursive", "with")
        return self.spark.sql(sql.replace(f"from {source})", f"from {{{source}}})").replace(
            f"from {source}\n", f"from {{{source}}}\n"), **{source: self.table(source)})

    @cached_property
    def span_events(self) -> DataFrame:
        return derive_span_events(self.table("events")).drop("ts")

    @cached_property
    def spans(self) -> DataFrame:
        return self.span_events.drop("event_type", "user_id", "event_id")

    @cached_property
    def metrics(self) -> DataFrame:
        """Three metrics from one aggregation instead of three scans, stored like a metrics table."""
        buckets = self.spans.groupBy("incident_id", "service", F.floor(F.col("time") / 7200).alias("bucket")).agg(
            F.avg(F.when(F.col("status") == "ERROR", 1.0).otherwise(0.0)).alias("request_error_rate"),
            F.max("duration_ms").alias("latency_p95_ms"), (F.sum("duration_ms") / 100).alias("cpu_cores"))
        return store(buckets.unpivot(
            ["incident_id", "service", "bucket"], ["request_error_rate", "latency_p95_ms", "cpu_cores"], "metric", "value"
        ).select("incident_id", "service", "metric", (F.col("bucket") * 7200).alias("time"), "value"), "metrics")

    @cached_property
    def changes(self) -> DataFrame:
        return self._sql("changes", "orders")

    @cached_property
    def logs(self) -> DataFrame:
        return self.span_events.select(*log_columns())

    @cached_property
    def incidents(self) -> DataFrame:
        return store(self.spans.select("incident_id").distinct().select(
            "incident_id", F.lit(0).cast("long").alias("window_start"), F.lit(432000).cast("long").alias("window_end"),
            F.lit(216000).cast("long").alias("onset_second")), "incidents")

    @cached_property
    def truth(self) -> DataFrame:
        number = F.substring_index("incident_id", "_", -1).cast("int")
        planted = F.get(F.array(*[F.lit(v) for v in FAULT_BY_INCIDENT]), number)
        return self.incidents.select(
            "incident_id", F.lit("service").alias("kind"), F.coalesce(planted, F.lit("shipping")).alias("service"))

    @cached_property
    def graded_runs(self) -> DataFrame:
        return self._sql("graded_runs", "orders")

    @cached_property
    def journal(self) -> DataFrame:
        return self._sql("journal", "events")

    @cached_property
    def static_edges(self) -> DataFrame:
        """The declared call graph, repeated for every incident."""
        pairs = F.array(*[F.struct(F.lit(a).alias("caller"), F.lit(b).alias("callee")) for a, b in STATIC_EDGES])
        return self.incidents.select("incident_id", F.explode(pairs).alias("e")).select("incident_id", "e.caller", "e.callee")
