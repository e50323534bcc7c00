"""Contracts of every record kind: its columns, and conditions that hold for each row.

Payloads are JSON text, as their keys are free; instants are ``timestamp`` columns, which carry their zone.  A table
must have exactly the columns of its kind; columns that are not optional must not be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.operators.contracts import FORBIDDEN, normal_sql, violations

#: Enumerations of the records.
RECOMMENDATIONS = ["close", "escalate", "insufficient_evidence", "novel_pattern", "budget_exhausted", "critic_unresolved"]
DISPOSITIONS = ["confirmed_suspicious", "closed_legitimate"]
POLICY_STATUSES = ["done", "not_done", "n/a"]
TOOL_STATUSES = ["ok", "error", "timeout", "budget_exhausted"]
HUMAN_DECISIONS = ["confirm_close", "escalate", "request_more_info", "override_close"]
RELIABILITY = ["reliable", "low_support", "out_of_range"]
SIDES = ["prosecution", "defence"]


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def one_of(column: str, values: list[str]) -> str:
    return f"{column} IN ({_quoted(values)})"


def open_keys(payload: str) -> str:
    """No key of a JSON text, at any depth, is forbidden; a null payload has none."""
    keys = f"regexp_extract_all({payload}, '\"((?:[^\"\\\\\\\\]|\\\\\\\\.)*)\"\\\\s*:', 1)"
    return f"coalesce(NOT exists({keys}, k -> {normal_sql('k')} IN ({_quoted(sorted(FORBIDDEN))})), true)"


_BAND = "lo double, hi double, n_support long, reliability_flag string"
_PART = "name string, value string, contribution double"
_EVIDENCE = "evidence_id string, source_tool string, tool_call_id string, as_of timestamp, claim_type string, payload string, human_summary string"
_BUDGET = "steps long, llm_calls long, input_tokens long, output_tokens long, cost_eur double"
_OUTPUT = "agent_name string, run_id string, evidence_ids_used array<string>, conclusion string, rationale string, confidence_note string"
_CITATION = "claim_id string, evidence_id string, doc_section_id string"
_STEP = "status string, evidence_id string"
_CALL = "tool_call_id string, run_id string, tool_name string, tool_version string, as_of timestamp, input string, input_hash string, output_hash string, duration_ms double, status string, error_code string"


def _struct(fields: str) -> str:
    return "struct<" + fields.replace(" ", ":").replace(",:", ",") + ">"


_SPEAKER = _struct(_OUTPUT).removesuffix(">") + f",budget_used:{_struct(_BUDGET)}>"
_DELIBERATION = f"struct<prosecution:{_SPEAKER},defence:{_SPEAKER},adjudication:{_SPEAKER},argument_order:array<string>>"


def _within(prefix: str, conditions: dict[str, str], *columns: str) -> dict[str, str]:
    """Conditions of a nested record, its columns seen through ``prefix``."""
    import re

    return {f"{prefix}: {n}": re.sub(rf"\b({'|'.join(columns)})\b(?!')", rf"{prefix}.\1", c) for n, c in conditions.items()}


_BAND_RULES = {"bounds are shares": "lo BETWEEN 0 AND 1 AND hi BETWEEN 0 AND 1", "bounds in order": "lo <= hi", "support": "n_support >= 0", "flag": one_of("reliability_flag", RELIABILITY)}
_BUDGET_RULES = {"no negative use": "least(steps, llm_calls, input_tokens, output_tokens, cost_eur) >= 0 AND steps IS NOT NULL AND llm_calls IS NOT NULL AND input_tokens IS NOT NULL AND output_tokens IS NOT NULL AND cost_eur IS NOT NULL"}
_STEP_RULE = "{s}.status IN (" + _quoted(POLICY_STATUSES) + ") AND ({s}.status <> 'done' OR coalesce({s}.evidence_id, '') <> '')"
_ONE_SOURCE = "({c}.evidence_id IS NULL) <> ({c}.doc_section_id IS NULL)"
_KNOWN = "transform(evidence, e -> e.evidence_id)"

#: kind: (columns, optional columns, conditions)
RECORDS: dict[str, tuple[str, set[str], dict[str, str]]] = {
    "alert": (
        "alert_id string, account_key string, window_start timestamp, window_end timestamp, as_of timestamp, triggered_rules array<string>, rule_features string, created_at timestamp",
        {"rule_features"},
        {"composite key": "account_key RLIKE '^[^|]+[|][^|]+$'", "one rule at least": "size(triggered_rules) >= 1", "window in order": "window_start <= window_end", "window closed": "window_end < as_of", "open keys": open_keys("rule_features")},
    ),
    "calibration_band": (_BAND, set(), _BAND_RULES),
    "feature_contribution": (_PART, {"value"}, {}),
    "score_result": (
        f"alert_id string, model_id string, model_version_hash string, calibrator_hash string, score double, raw_score double, calibration_band {_struct(_BAND)}, top_features array<{_struct(_PART)}>, explain_output_space string",
        set(),
        {"a probability": "score BETWEEN 0 AND 1", "inside its band": "score BETWEEN calibration_band.lo AND calibration_band.hi"} | _within("calibration_band", _BAND_RULES, "lo", "hi", "n_support", "reliability_flag"),
    ),
    "evidence_item": (_EVIDENCE, set(), {"open keys": open_keys("payload")}),
    "budget_used": (_BUDGET, set(), _BUDGET_RULES),
    "agent_output": (f"{_OUTPUT}, budget_used {_struct(_BUDGET)}", set(), _within("budget_used", _BUDGET_RULES, "steps", "llm_calls", "input_tokens", "output_tokens", "cost_eur")),
    "deliberation": (
        _DELIBERATION.removeprefix("struct<").removesuffix(">"),
        {"prosecution", "defence", "adjudication"},
        {"known sides": f"forall(argument_order, s -> {one_of('s', SIDES)})"},
    ),
    "citation": (_CITATION, {"evidence_id", "doc_section_id"}, {"exactly one source": "(evidence_id IS NULL) <> (doc_section_id IS NULL)"}),
    "policy_step": (_STEP, {"evidence_id"}, {"status": one_of("status", POLICY_STATUSES), "done needs evidence": "status <> 'done' OR coalesce(evidence_id, '') <> ''"}),
    "case_file": (
        f"alert_id string, recommendation string, evidence array<{_struct(_EVIDENCE)}>, deliberation {_DELIBERATION}, narrative string, citations array<{_struct(_CITATION)}>, policy_steps map<string, {_struct(_STEP)}>, critic_report string, trajectory_ref string",
        {"critic_report"},
        {
            "recommendation": one_of("recommendation", RECOMMENDATIONS),
            "exactly one source": f"forall(citations, c -> {_ONE_SOURCE.format(c='c')})",
            "steps": f"forall(map_values(policy_steps), s -> {_STEP_RULE.format(s='s')})",
            "citations resolve": f"forall(citations, c -> coalesce(c.evidence_id, '') = '' OR coalesce(array_contains({_KNOWN}, c.evidence_id), false))",
            "steps resolve": f"forall(map_values(policy_steps), s -> coalesce(s.evidence_id, '') = '' OR coalesce(array_contains({_KNOWN}, s.evidence_id), false))",
            "open keys": f"forall(evidence, e -> {open_keys('e.payload')})",
        },
    ),
    "tool_call": (_CALL, {"output_hash", "error_code"}, {"duration": "duration_ms >= 0", "status": one_of("status", TOOL_STATUSES)}),
    "trajectory_record": (
        f"run_id string, config_id string, agent string, prompt_id string, prompt_hash string, model_id string, temperature double, inputs string, outputs string, tool_calls array<{_struct(_CALL)}>, input_tokens long, output_tokens long, cost_eur double, latency_ms double, error string, ts timestamp",
        {"prompt_id", "prompt_hash", "model_id", "temperature", "outputs", "error"},
        {"no negative use": "least(input_tokens, output_tokens, cost_eur, latency_ms) >= 0", "calls": f"forall(tool_calls, c -> c.duration_ms >= 0 AND {one_of('c.status', TOOL_STATUSES)})"},
    ),
    "graph_query": ("account_key string, as_of timestamp, lookback_hours double, max_hops int", set(), {"lookback": "lookback_hours > 0", "hops": "max_hops BETWEEN 1 AND 3"}),
    "historical_disposition": ("alert_id string, account_key string, disposition string, closed_at timestamp", set(), {"disposition": one_of("disposition", DISPOSITIONS)}),
    "decision_record": (
        "case_id string, recommendation string, reliability_flag string, evidence_ids array<string>, agent_run_id string, human_decision string, human_reason string, decided_at timestamp",
        {"human_decision", "human_reason", "decided_at"},
        {
            "recommendation": one_of("recommendation", RECOMMENDATIONS),
            "flag": one_of("reliability_flag", RELIABILITY),
            "decision": f"human_decision IS NULL OR {one_of('human_decision', HUMAN_DECISIONS)}",
            "a decision has a reason and an instant": "human_decision IS NULL OR (coalesce(human_reason, '') <> '' AND decided_at IS NOT NULL)",
        },
    ),
    "run_manifest": (
        "run_id string, config_hash string, prompt_hashes map<string, string>, model_ids map<string, string>, model_revisions map<string, string>, temperature double, top_p double, seeds map<string, long>, dataset_hash string, feature_registry_hash string, model_hash string, calibrator_hash string, band_table_hash string, retrieval_index_hash string, tool_versions map<string, string>, code_commit string, llm_cache_enabled boolean, contracts_version string, started_at timestamp",
        {"top_p", "feature_registry_hash", "model_hash", "calibrator_hash", "band_table_hash", "retrieval_index_hash"},
        {},
    ),
}


def schema_of(kind: str) -> T.StructType:
    return T.StructType.fromDDL(RECORDS[kind][0])


def broken_records(df: DataFrame, kind: str) -> DataFrame:
    """Rows of ``df`` that break the contract of their kind; a table with other columns or types is refused."""
    _, optional, conditions = RECORDS[kind]
    expected = {f.name: f.dataType.simpleString() for f in schema_of(kind)}
    if dict(df.dtypes) != expected:
        apart = sorted(set(df.dtypes) ^ set(expected.items()))
        raise ValueError(f"columns that do not fit {kind}: {apart}")
    return violations(df, {f"{c} is given": f"{c} IS NOT NULL" for c in expected if c not in optional} | conditions)
