"""Fragments of reference SQL shared by several queries."""

from __future__ import annotations

from faultline.plans.views import STATIC_EDGES

CALLEE = """coalesce(k.child, case when contains(s.operation, '/') then nullif(lower(ltrim(regexp_replace(
  left(list_filter(string_split(split_part(s.operation, '/', 1), '.'), lambda x: lower(x) like '%service')[-1], -7),
  '([A-Z])', '-\\1', 'g'), '-')), '') end)"""

RESOLVED = {
    "kid": """select incident_id, parent_span_id as span_id, arg_min(service, row(time, trace_id, span_id)) as child
      from spans where span_kind='server' and parent_span_id is not null group by 1, 2""",
    "resolved": f"""select s.*, {CALLEE} as callee from spans s left join kid k using (incident_id, span_id)""",
}

EDGES = RESOLVED | {
    "edges": """select distinct incident_id, service as caller, callee from resolved
      where span_kind='client' and callee is not null and callee <> service"""
}


def p95(value: str = "duration_ms", condition: str = "true") -> str:
    picked = f"list({value}) filter (where {condition})"
    n = f"count(*) filter (where {condition})"
    return f"list_sort({picked})[least({n}, cast(floor(cast(0.95 as double)*{n}) as bigint)+1)]"


def values(rows: list[tuple[str, ...]], *columns: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else ("null" if x is None else str(x)) for x in r) + ")" for r in rows)
    return f"select * from (values {body}) as v({', '.join(columns)})"


STATIC = {
    "pairs": values(STATIC_EDGES, "caller", "callee"),
    "static_edges": "select incident_id, caller, callee from incidents cross join pairs",
}


def effect_ctes(points: str, prefix: str = "z") -> dict[str, str]:
    """CTEs computing ``effect_z`` per (incident_id, service, metric) from a points CTE.

    ``points`` has side (pre or post), time and value.
    """
    k = "incident_id, service, metric"
    med = "coalesce(list_median({0}), 0.0)".replace("list_median(", "list_aggregate(").replace("{0})", "{0}, 'median')")

    def m(e: str) -> str:
        return med.format(e)

    def sigma(e: str, c: str) -> str:
        return f"1.4826 * {m(f'list_transform({e}, lambda x: abs(x - {c}))')}"

    ctes = {
        f"{prefix}_arr": f"""select {k}, coalesce(list(value order by time, value) filter (where side='pre'), []) as pre,
          coalesce(list(value order by time, value) filter (where side='post'), []) as post from {points} group by all""",
        f"{prefix}_two": f"""select {k}, 'l' as p, pre, post, len(pre) as n0, len(post) as n1 from {prefix}_arr
          union all select {k}, 'd' as p,
          list_transform(range(1, len(pre)), lambda i: pre[i+1] - pre[i]) as pre,
          list_transform(range(1, len(post)), lambda i: post[i+1] - post[i]) as post, len(pre) as n0, len(post) as n1 from {prefix}_arr""",
        f"{prefix}_cut": f"""select *, len(pre) as np, len(post) as nq, cast(floor(len(pre)/3) as bigint) as c1,
          2*cast(floor(len(pre)/3) as bigint) as c2 from {prefix}_two""",
        f"{prefix}_med": f"""select *, {m('pre')} as pm, {m('post')} as qm, {m('pre[1:c1]')} as a1, {m('pre[c1+1:]')} as b1,
          {m('pre[1:c2]')} as a2, {m('pre[c2+1:]')} as b2 from {prefix}_cut""",
        f"{prefix}_sig": f"""select *, {sigma('pre', 'pm')} as ps, {sigma('pre[1:c1]', 'a1')} as s1, {sigma('pre[1:c2]', 'a2')} as s2,
          case when metric='request_error_rate' then 0.002e0 when metric='latency_p95_ms' then 2.0e0 else 1e-9 end
            / (case p when 'd' then 10.0e0 else 1.0e0 end) as eps,
          case when p='d' then 0.0e0 when metric='request_error_rate' then 0.01e0 when metric='latency_p95_ms' then 15.0e0 else 0.0e0 end as dabs,
          case when p='d' then 0.0e0 when metric='request_error_rate' then 0.5e0 else 0.15e0 end as drel from {prefix}_med""",
        f"{prefix}_lvl": f"""select *, qm - pm as delta, (qm - pm) / greatest(ps, eps, 0.01e0*abs(pm)) as z,
          greatest(0.0e0, case when c1 between 4 and np-4 then abs(b1-a1)/greatest(s1, eps, 0.01e0*abs(a1)) else 0.0e0 end,
            case when c2 between 4 and np-4 then abs(b2-a2)/greatest(s2, eps, 0.01e0*abs(a2)) else 0.0e0 end) as placebo from {prefix}_sig""",
        f"{prefix}_one": f"""select {k}, p, n0, n1, case when np < 4 or nq = 0 or delta <= 0 then 0.0e0
          when not (delta >= dabs or (pm > 0 and delta >= drel*pm)) then 0.0e0
          when placebo > 0 and z <= 1.25e0*placebo then z*0.25e0 else z end as z from {prefix}_lvl""",
        f"{prefix}": f"""select {k}, max(n0) as n_pre, max(n1) as n_post,
          max(case when p='l' or (n0 >= 6 and n1 >= 3) then z else 0.0e0 end) as effect_z from {prefix}_one group by all""",
    }
    return ctes


ONSET_POINTS = {
    "points": """select m.incident_id, m.service, m.metric, m.time, m.value,
      case when m.time >= i.onset_second then 'post' else 'pre' end as side from metrics m join incidents i using (incident_id)"""
}
ONSET_EFFECTS = ONSET_POINTS | effect_ctes("points") | {
    "shifts": """select z.*, m.pre_mean, m.post_mean from z join (select incident_id, service, metric,
      coalesce(avg(value) filter (where side='pre'), 0.0) as pre_mean, coalesce(avg(value) filter (where side='post'), 0.0) as post_mean
      from points group by all) m using (incident_id, service, metric)"""
}
