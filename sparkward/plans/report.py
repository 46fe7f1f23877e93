"""Reports of a result: one JSON document or text."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.finding import COLUMNS
from ..functions.text import CONFIDENCES, SEVERITIES, label
from ..operators.gate import blind_spots, mark, shown
from ..operators.interpret import ranked, summary
from .scan import Result

SCHEMA_VERSION, TOOL = "3.0", "sparkward"
LIMITS = [
    "Static pattern analysis only: nothing that is scanned is ever run, so flaws of logic or behaviour stay unseen.",
    "Secrets are found by known formats and entropy; new or disguised formats can be missed.",
    "Imported code and dependency findings are as complete as the tools that made them.",
    "A clean result means that nothing matched these rules, not that the code is safe.",
]


def exported(findings: DataFrame) -> DataFrame:
    """Findings with severities and confidences as words, without the internal order."""
    return findings.withColumns({"severity": label(F.col("severity"), SEVERITIES), "confidence": label(F.col("confidence"), CONFIDENCES)}).select(*COLUMNS[:-1])


def report_rows(findings: DataFrame, min_severity: int = 0) -> DataFrame:
    """The report as one row per finding: what a large result is written as, by any Spark sink."""
    return exported(ranked(shown(findings, min_severity)))


def now_iso() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _meta(result: Result, target: str) -> dict:
    engines = {r.engine: {"status": r.status, "detail": r.detail} for r in result.status.collect()}
    return {"target": target, "timestamp": now_iso(), "version": "1", "file_count": result.file_count, "secret_file_count": result.secret_file_count, "engines": engines}


def as_json(result: Result, target: str, min_severity: int = 0) -> str:
    """The JSON document. It gathers the findings on the driver: for a tree's report, not for a corpus's (see report_rows)."""
    kept = shown(result.findings, min_severity)
    counts = summary(kept).first()
    rows = [json.loads(r) for r in exported(ranked(kept)).toJSON().collect()]
    doc = {
        "schema_version": SCHEMA_VERSION, "tool": TOOL, "meta": _meta(result, target),
        "summary": {"active": counts.total_active, "filtered": counts.total_filtered, "by_severity": {s: counts[s.lower()] for s in SEVERITIES}},
        "findings": [r for r in rows if not r["filtered"]], "filtered": [r for r in rows if r["filtered"]], "limits": LIMITS,
    }
    return json.dumps(doc, indent=2)


def as_text(result: Result, target: str, min_severity: int = 0) -> str:
    doc = json.loads(as_json(result, target, min_severity))
    meta, counts = doc["meta"], doc["summary"]["by_severity"]
    marks = {r.engine: r.m for r in result.status.select("engine", mark(F.col("status")).alias("m")).collect()}
    blind = [r.engine for r in blind_spots(result.status).collect()]
    both = meta["secret_file_count"] not in (None, meta["file_count"])
    out = [f"Target : {meta['target']}", f"Scanned: {meta['timestamp']}", f"Files  : {meta['file_count']}" + (f"  (secrets scanned {meta['secret_file_count']}, incl. vendored/build dirs)" if both else ""), "", "Engine status:"]
    out += [f"  {marks[e]:10}{e:8} {s['detail']}" for e, s in meta["engines"].items()]
    if blind:
        out += ["", "  SCAN DEGRADED -- " + ", ".join(blind) + " did not measure; a zero there is not evidence of anything."]
    out += ["", f"Findings (active): {doc['summary']['active']}    " + "  ".join(f"{s}={counts[s]}" for s in reversed(SEVERITIES)), f"Filtered: {doc['summary']['filtered']}", ""]
    if not doc["findings"]:
        out.append("No active findings at or above the reporting threshold; nothing matched is not proven safe.")
    for i, f in enumerate(doc["findings"], 1):
        at = f"{f['file']}:{f['line']}" + (f"-{f['end_line']}" if f["end_line"] and f["end_line"] != f["line"] else "")
        out.append(f"[{i}] {f['severity']}/{f['confidence']} ({f['engine']}) {f['title']}  {f['rule_id']}  {at}")
        rows = [("category", f["category"]), ("cwe", f["cwe"]), ("owasp", f["owasp"]), ("with", ", ".join(f["corroborated_by"])), ("detail", f["description"]), ("code", f["snippet"]), ("fix", f["fix"]), ("see", (f["references"] or [""])[0])]
        out += [f"     {k:8}: {v}" for k, v in rows if v]
    if doc["filtered"]:
        out += ["", "FILTERED (suppressed with a reason)"]
        out += [f"  ({i}) {f['severity']}/{f['confidence']} {f['title']} @ {f['file']}:{f['line']}\n      reason: {f['filter_reason']}" for i, f in enumerate(doc["filtered"], 1)]
    return "\n".join([*out, "", "LIMITS", *("  * " + x for x in LIMITS)])
