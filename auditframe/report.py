"""HTML report of one run, from its small result tables."""

from __future__ import annotations

from datetime import datetime
from html import escape
from pathlib import Path

_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:3px 8px}.ok{background:#cfc}.warn{background:#fec}.err{background:#fcc}"


def bucket(score: float, ok: float = 0.95, fair: float = 0.8) -> str:
    """The report's thresholds by default; the command line takes 0.9 and 0.7."""
    return "ok" if score >= ok else "warn" if score >= fair else "err"


def severity_class(severity: str) -> str:
    return {"critical": "err", "error": "err", "warning": "warn"}.get(severity, "ok")


def duration(started: datetime | None, ended: datetime | None) -> str:
    if not started or not ended:
        return "-"
    s = (ended - started).total_seconds()
    return f"{s:.1f}s" if s < 60 else f"{int(s // 60)}m {int(s % 60)}s"


def _table(head: list[str], rows: list[list[tuple[str, str]]]) -> str:
    cells = lambda row: "".join(f'<td class="{cls}">{escape(str(text))}</td>' for text, cls in row)
    return "<table><tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr>" + "".join(f"<tr>{cells(r)}</tr>" for r in rows) + "</table>"


def render(result) -> str:
    """A page with a summary, the tables' and columns' completeness and all issues."""
    profiles = sorted(result.profiles.collect(), key=lambda r: (r.schema_name, r.table_name))
    issues = sorted(result.issues.collect(), key=lambda r: (r.severity, r.table_name or "", r.column_name or ""))
    score = lambda r: 1 - r.null_count / r.row_count if r.row_count else 1.0
    names = sorted({(r.schema_name, r.table_name) for r in profiles})
    per_table = []
    for s, t in names:
        scores = [score(r) for r in profiles if (r.schema_name, r.table_name) == (s, t) and r.column_name is not None]
        mean = sum(scores) / len(scores) if scores else 1.0
        n = sum((i.schema_name, i.table_name) == (s, t) for i in issues)
        per_table.append([(f"{s}.{t}", ""), (f"{100 * mean:.1f} %", bucket(mean)), (n, "")])
    columns = [[(f"{r.schema_name}.{r.table_name}.{r.column_name}", ""), (r.data_type, ""), (r.row_count, ""), (r.null_count, ""), (f"{100 * score(r):.1f} %", bucket(score(r)))] for r in profiles if r.column_name is not None]
    listed = [[(i.severity, severity_class(i.severity)), (i.dimension, ""), (i.table_name, ""), (i.column_name, ""), (i.rule_name or "", ""), (i.message, "")] for i in issues]
    head = f"<p>Run {escape(result.run_id)} on {escape(result.connection_id)}: {escape(result.status)}, {duration(result.started_at, result.ended_at)}, {len(names)} tables, {len(columns)} columns, {len(issues)} issues</p>"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Data quality {escape(result.run_id)}</title><style>{_STYLE}</style></head><body><h1>Data quality</h1>{head}<h2>Tables</h2>{_table(['table', 'completeness', 'issues'], per_table)}<h2>Columns</h2>{_table(['column', 'type', 'rows', 'nulls', 'completeness'], columns)}<h2>Issues</h2>{_table(['severity', 'dimension', 'table', 'column', 'rule', 'message'], listed)}</body></html>"


def write_report(result, path: str | Path | None = None) -> dict[str, str]:
    path = Path(path or f"report-{result.run_id}.html")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(render(result), encoding="utf-8")
    return {"status": "success", "run_id": result.run_id, "report_path": str(path)}
