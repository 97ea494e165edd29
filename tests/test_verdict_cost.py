"""Responses are parsed as far as needed, and once however many outputs read the verdicts."""

import re

import pytest

from seclog.operators.verdicts import parse_verdicts
from seclog.plans import queries as q

#: text, is_threat, error
LADDER = [
    ("Error: timeout", None, "llm_json_parse_failed"),
    ("", None, "llm_json_parse_failed"),
    (None, None, "llm_json_parse_failed"),
    ("],[1", None, "llm_json_parse_failed"),
    ("+1", None, "llm_json_parse_failed"),
    ('{"is_threat":1} {"is_threat":0}', None, "llm_json_parse_failed"),
    ("null", None, "llm_json_parse_failed"),
    (" 5\n", None, "'int' object does not support item assignment"),
    ('{"is_threat":"false"}', True, None),
    ('{"is_threat":0.0}', False, None),
    ('```json\n{"is_threat":true,}\n```', True, None),
    ('```json\n5\n``` {"is_threat":true}', None, "'int' object does not support item assignment"),
    ('see {"is_threat":[],"is_threat":[0],} end', True, None),
    ('{"is_threat":true', None, "llm_json_parse_failed"),
]


def _parses(df) -> list[str]:
    """Columns that parse JSON in every row, whatever the row's other texts gave."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"(?:\[|, )(?:static_invoke\(VariantExpressionEvalUtils\.parseJson|try_parse_json|parse_json)\(", plan)


def test_candidates_are_parsed_only_when_needed(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LADDER)], "i int, raw string")
    out = parse_verdicts(df)
    assert [(r.is_threat, r.error) for r in out.orderBy("i").collect()] == [(t, e) for _, t, e in LADDER]
    assert not _parses(out)


@pytest.mark.parametrize("name", ["run_summary", "result_sink"])
def test_verdicts_are_attached_once(spark, sf, monkeypatch, name):
    """What the run rows are made from holds no responses to parse: it was written."""
    seen = []
    summary = q.run_summary
    monkeypatch.setattr(q, "run_summary", lambda totals, s, clusters, events: seen.extend([clusters, events]) or summary(totals, s, clusters, events))
    q.queries()[name](spark, sf)
    assert len(seen) == 2
    assert not any(re.search("parse_?json", d._jdf.queryExecution().optimizedPlan().toString(), re.I) for d in seen)
