"""Runbook matching: equal rows compete, rows without a hit, and what travels."""

from __future__ import annotations

import re

from faultline.operators import hypothesis

SYMPTOMS = "incident_id string, query string"


def plain_match(rows: list[tuple], limit: int) -> list[tuple]:
    """Each (incident, text) group's runbooks by points, then place; copies compete, and no group of a null incident is found again."""
    out, groups = [], {}
    for incident, text in rows:
        terms = {w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if len(w) >= 3}
        scores = [(sum(any(t in k or k in t for k in words) for t in terms), place, rid) for place, (rid, _, words) in enumerate(hypothesis.RUNBOOKS)]
        hits = [(-s, p, rid) for s, p, rid in scores if s]
        groups.setdefault((incident, text), []).extend(hits)
        if not hits or incident is None:
            out.append((incident, text, 1, hypothesis.DEFAULT_RUNBOOK, 0))
    for (incident, text), hits in groups.items():
        out += [(incident, text, i + 1, rid, -s) for i, (s, _, rid) in enumerate(sorted(hits)[:limit])]
    return sorted(out, key=repr)


def test_runbooks_of_odd_rows_without_moving_texts(spark):
    texts = ["Errors and ERROR and err", "slow latency after the deploy\tpage", "ten ate age era", "nothing here", "", " ", None, "p95 5xx gc cpu", "unavailable: memory-load config.rollback"]
    rows = [(incident, text) for incident in ("a", "b", None) for text in texts]
    rows += rows[:5] * 2 + [("a", texts[1])] + [(None, texts[0])]
    for limit in (1, 3):
        found = hypothesis.match_runbooks(spark.createDataFrame(rows, SYMPTOMS), limit)
        assert sorted(map(tuple, found.collect()), key=repr) == plain_match(rows, limit)
    plan = found.select("incident_id", "id", "position")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "first(query" not in plan
    assert hypothesis.match_runbooks(spark.createDataFrame([], SYMPTOMS)).collect() == []
