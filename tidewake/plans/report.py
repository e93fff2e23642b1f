"""HTML dossier of a case."""

from __future__ import annotations

from html import escape
from typing import Any


def text(value: Any) -> str:
    return escape("–" if value is None else str(value))


def number(value: Any, digits: int = 2) -> str:
    return f"{value:,.{digits}f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else text(value)


def _table(head: list[str], rows: list[list[str]]) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{''.join(f'<th>{escape(h)}</th>' for h in head)}</tr></thead><tbody>{cells}</tbody></table>"


def render(bundle: dict[str, Any]) -> str:
    """The case's export bundle as one page without outside resources."""
    case, hindcast, run = bundle["case"], bundle.get("hindcast"), bundle.get("attribution")
    parts = [f"<h1>{text(case['name'])}</h1><p class='mode'>{text(case['data_mode']).upper()} data · status {text(case['status'])}</p><p>{text(bundle['disclaimer'])}</p>"]
    slicks = bundle["slicks"]["features"]
    rows = [[text(f["id"]), text(p.get("class")), number(p.get("confidence")), number(p.get("area_km2")), number(p.get("elongation"), 1), text(p.get("look_alike_risk")), text(p.get("review_status"))] for f in slicks for p in [f["properties"]]]
    parts.append("<h2>Slicks</h2>" + (_table(["id", "class", "confidence", "km²", "elongation", "look-alike risk", "review"], rows) if rows else "<p>None found.</p>"))
    if hindcast:
        m = hindcast["metrics"]
        areas = ", ".join(f"{k} %: {number(v)} km²" for k, v in sorted(m.get("origin_areas_km2", {}).items()))
        parts.append(f"<h2>Origin</h2><p>Released between {text(hindcast['release_start'])} and {text(hindcast['release_end'])} UTC ({text(m.get('window_basis'))}).</p><p>Regions: {areas or '–'}</p>")
    if run:
        rows = [[number(c["rank"], 0), text(c["mmsi"]), text(c["vessel"].get("name")), text(c["vessel"].get("type")), number(c["score"], 1), text(c["priority"]), "<br>".join(map(text, c["evidence"])), text(c.get("review_status"))] for c in run["candidates"]]
        parts.append("<h2>Vessels to look at</h2>" + _table(["rank", "MMSI", "name", "type", "score", "priority", "rests on", "review"], rows))
    imports = bundle.get("ais_imports") or []
    parts.append("<h2>Vessel data</h2>" + _table(["file", "mode", "rows", "valid", "quarantined"], [[text(i["filename"]), text(i["data_mode"]), number(i["rows_total"], 0), number(i["rows_valid"], 0), number(i["rows_quarantined"], 0)] for i in imports]))
    parts.append("<h2>Audit</h2>" + _table(["time", "who", "what"], [[text(a["ts"]), text(a["actor"]), text(a["action"])] for a in reversed(bundle.get("audit_log") or [])]))
    parts.append(f"<footer>Parameters {text(case.get('config_hash'))}</footer>")
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:.3em;vertical-align:top}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{text(case['name'])}</title><style>{style}</style></head><body>{''.join(parts)}</body></html>"
