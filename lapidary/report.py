"""Reports of a run as a dict, JSON and HTML, with the standard library only."""

from __future__ import annotations

import html
import json

STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}"


def build(meta: dict, dataset: dict, cleaning: dict, memory: dict, columns: dict, validation: dict, export: list, logs: list) -> dict:
    before, after = memory.get("before", 0), memory.get("after", 0)
    memory = memory | {"reduction_percent": round(100 * (before - after) / before, 1) if before else 0.0}
    return {
        "meta": meta,
        "dataset": dataset,
        "cleaning": cleaning,
        "memory": memory,
        "per_column": columns,
        "validation": validation,
        "export": export,
        "logs": logs,
    }


def _cell(v) -> str:
    if isinstance(v, dict):
        return "<table>" + "".join(f"<tr><th>{html.escape(str(k))}</th><td>{_cell(x)}</td></tr>" for k, x in v.items()) + "</table>"
    if isinstance(v, list):
        return "<br>".join(_cell(x) for x in v)
    return html.escape(str(v))


def to_html(report: dict, title: str = "Data refinement report") -> str:
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>"]
    parts.append(f"<p>{report['memory']['reduction_percent']}% RAM Reduction</p>")
    review = report["validation"].get("review_queue") or []
    parts.append("<h2>Review queue</h2>" + (_cell(review) if review else "<p>Nothing to review.</p>"))
    drift = report["validation"].get("schema_drift") or {}
    parts.append("<h2>Schema drift</h2>" + (_cell(drift) if drift.get("drift_detected") else "<p>No drift.</p>"))
    for name in ("meta", "dataset", "cleaning", "memory", "per_column", "validation", "export", "logs"):
        parts.append(f"<h2>{name.replace('_', ' ').capitalize()}</h2>{_cell(report[name])}")
    return "".join(parts) + "</body></html>"


def write(report: dict, path: str, kind: str = "html") -> str:
    """html or json; pdf needs weasyprint."""
    if kind == "pdf":
        try:
            import weasyprint
        except ImportError as e:
            raise ImportError("PDF reports need weasyprint") from e
        weasyprint.HTML(string=to_html(report)).write_pdf(path)
        return path
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(report, indent=2, default=str) if kind == "json" else to_html(report))
    return path
