"""Small literal inputs."""

from __future__ import annotations

import json

from lintharbor import schemas

RUN = {
    "project": "p", "scan_id": "s", "run_no": 0, "tool": "Bandit", "unit": None, "exit_code": 1,
    "stdout": "", "stderr": "", "duration_s": 1.0, "file_count": 1, "target_exists": True,
    "timed_out": False,
}
FINDING = {
    "project": "p", "scan_id": "s", "seq": 0, "tool": "Bandit", "severity": "high", "title": "T",
    "description": "D", "file": "/srv/p/a.py", "line": 1, "column": 1, "code": "", "fix": "",
    "rule_id": "R", "cwe": None, "owasp": None, "references": None,
}


def runs(spark, *changes, **common):
    """Tool runs from partial dicts; a dict or list as stdout is rendered as JSON."""
    rows = []
    for i, change in enumerate(changes):
        row = {**RUN, "run_no": i, **common, **change}
        if not isinstance(row["stdout"], (str, type(None))):
            row["stdout"] = json.dumps(row["stdout"])
        rows.append(tuple(row[k] for k in RUN))
    return spark.createDataFrame(rows, schemas.SCAN_RUNS)


def findings(spark, *changes, **common):
    rows = []
    for i, change in enumerate(changes):
        row = {**FINDING, "seq": i, **common, **change}
        rows.append(tuple(row[k] for k in schemas.FINDING_COLUMNS))
    return spark.createDataFrame(rows, schemas.FINDINGS)


def dicts(df, *order):
    rows = df.orderBy(*order) if order else df
    return [r.asDict(recursive=True) for r in rows.collect()]


def documents(pieces):
    """Pieces joined per scan, in piece order."""
    out = {}
    for r in pieces.orderBy("project", "scan_id", "slot", "section", "chunk").collect():
        out[(r.project, r.scan_id)] = out.get((r.project, r.scan_id), "") + r.text
    return out
