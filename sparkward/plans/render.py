"""Reports as JSON, Markdown, HTML and terminal text. They render collected rows of a report, on the driver; what may be of
any number is streamed, so a written report is never held whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import escape as _escape

from pyspark.sql import SparkSession

from ..functions.catalog import CATEGORIES
from ..sources.storage import local_uri, write_text
from .scan import Report, Streamed


def esc(text) -> str:
    return _escape(str(text), quote=True).replace("&#x27;", "&#39;")


def _label(value: float) -> str:
    return "High" if value >= 0.75 else "Medium" if value >= 0.5 else "Low"


def _severity(s: str) -> str:
    return s.upper() if s in ("critical", "high", "medium", "low") else "UNKNOWN"


def _head(g: dict) -> str:
    return f"{_severity(g['severity'])} {g['rule_id']} - {g['title']}"


def _preview(g: dict, n: int) -> tuple[list[str], int]:
    shown = [f"{o['file']}:{o['line']}" for o in g["occurrences"][:n]]
    return shown, max(0, g["n_occurrences"] - len(shown))


def actions(report: Report, n: int = 3) -> list[str]:
    return [f"{_severity(g['severity'])} {g['rule_id']}: {g['told_short_fix']}" for g in report.top[:n]]


def _categorized(report: Report) -> list[tuple[str, list[dict]]]:
    by_rule = {g["rule_id"]: g for g in report.groups}
    return [(c["category"], [by_rule[x["rule_id"]] for x in c["groups"]]) for c in sorted(report.categories, key=lambda c: CATEGORIES.index(c["category"]))]


def _json(value, pad: str = "") -> Iterator[str]:
    """As json.dumps with an indent of 2, in parts."""
    lead = {dict: "{", list: "[", Streamed: "["}.get(type(value)) if value else None
    if lead is None:
        yield json.dumps([] if isinstance(value, Streamed) else value)
        return
    for x in value:
        yield f"{lead}\n{pad}  " + (f"{json.dumps(x)}: " if isinstance(value, dict) else "")
        yield from _json(value[x] if isinstance(value, dict) else x, pad + "  ")
        lead = ","
    yield f"\n{pad}{'}' if isinstance(value, dict) else ']'}"


def json_parts(report: Report) -> Iterator[str]:
    strip = lambda g: {k: v for k, v in g.items() if not k.startswith("told_") and k != "first_place"} | {"occurrences": report.occurrences(g)}
    return _json(
        {
            "meta": report.meta, "summary": {"total": report.summary["total"], "bySeverity": {s: report.summary[s] for s in ("critical", "high", "medium", "low")}}, "baselineDiff": report.baseline,
            "prioritizedFindings": [*map(strip, report.top)], "allFindings": [*map(strip, report.groups)], "informational": [*map(strip, report.informational)], "ignoredFindings": report.ignored,
        }
    )


def _md_snippet(snippet: list[dict] | None) -> list[str]:
    if not snippet:
        return []
    return ["```ts", *(f"{'>>' if s['highlight'] else '  '} {str(s['line_number']).rjust(4)} | {s['text']}" for s in snippet), "```"]


def _html_snippet(snippet: list[dict] | None) -> str:
    if not snippet:
        return ""
    return '<pre class="code">' + "".join(f'<div class="row{" hit" if s["highlight"] else ""}"><b>{s["line_number"]}</b> {esc(s["text"])}</div>' for s in snippet) + "</pre>"


def _markdown_lines(report: Report) -> Iterator[str]:
    s, out = report.summary, ["# Code risk report", "", "## 1. Summary", ""]
    out += [f"**Scanned at:** {report.meta['scannedAt']}", f"**Risk posture:** {s['posture']}", f"**Findings:** {s['total']} (critical {s['critical']}, high {s['high']}, medium {s['medium']}, low {s['low']})"]
    if b := report.baseline:
        out.append(f"**Baseline:** created now with {b['current_count']} findings" if b["created"] else f"**Baseline:** {b['new_or_regressed_count']} new or worse, {b['unchanged_count']} unchanged (baseline {b['baseline_count']}, now {b['current_count']})")
    out += ["", s["narrative"], "", "### Release decision", "", f"- Status: **{s['decision']}**", f"- Must be fixed first: **{s['must_fix']}**", *(f"- {a}" for a in actions(report)), "", "## 2. Priority risks", ""]
    for g in report.top:
        out += [f"**{_head(g)}**", f"Impact: {g['told_impact']}", f"Fix now: {g['told_short_fix']}", f"Confidence: {_label(g['confidence_max'])} ({g['range']})", ""]
    out += ([] if report.top else ["No issues found.", ""]) + ["## 3. Fix plan", "", *([f"- {a}" for a in actions(report)] or ["Nothing to fix."]), "", "## 4. Findings", ""]
    yield from out
    for name, groups in _categorized(report):
        yield from (f"### {name}", "")
        for g in groups:
            yield from (f"**{_head(g)}**", f"Impact: {g['told_impact']}", f"Confidence: {_label(g['confidence_max'])} ({g['range']})", f"Risk: {g['reason']}", "Flagged because:", *(f"- {x}" for x in g["told_flagged"]))
            yield from ["Note: some of these are flagged on the safe side."] * (g["rule_id"] == "AI004")
            yield from ("Exploit path:", f"- Trigger: {g['told_trigger']}", f"- Exposure: {g['told_exposure']}", f"- Effect: {g['told_effect']}", f"- Mitigation: {g['told_mitigation']}", f"Fix: {g['recommendation']}", "**Evidence:**")
            for n, o in enumerate(report.occurrences(g)):
                if n == 2:
                    yield f"More occurrences ({g['n_occurrences'] - 2}):"
                yield f"- {o['file']}:{o['line']}"
                if n < 2:
                    yield from _md_snippet(o["snippet"])
            yield ""
    yield from ([] if report.groups else ["No issues found.", ""]) + ["## 5. Ignored", ""]
    for x in report.ignored:
        yield from (f"- {_severity(x['severity'])} {x['rule_id']} {x['file']}:{x['line']}", f"  Reason: {x['reason']} (directive in line {x['annotation_line']})", *_md_snippet(x["snippet"]))
    yield from ([] if report.ignored else ["None."]) + ["", "## 6. Informational", ""]
    for g in report.informational:
        shown, remaining = _preview(g, 6)
        yield from (f"### {g['title']} (not a vulnerability)", "", f"Occurrences: {g['n_occurrences']}", *(f"- {x}" for x in shown), *([f"- and {remaining} more"] if remaining else []), "")
    yield from [] if report.informational else ["None.", ""]


def markdown_parts(report: Report) -> Iterator[str]:
    return (f"{chr(10) if n else ''}{line}" for n, line in enumerate(_markdown_lines(report)))


_CSS = "body{font:15px sans-serif;margin:2em auto;max-width:60em}.card{border:1px solid #ccc;border-left:6px solid #888;padding:.6em 1em;margin:1em 0}.critical{border-left-color:#a00}.high{border-left-color:#d60}.medium{border-left-color:#cb0}.code{background:#f4f4f4;padding:.5em}.hit{background:#fdd}.muted{color:#666}.mix{height:1em;border-radius:.5em}"
_COLOURS = {"critical": "#a00", "high": "#d60", "medium": "#cb0", "low": "#5a5"}


def _card(report: Report, g: dict) -> Iterator[str]:
    li = lambda rows: "".join(f"<li>{x}</li>" for x in rows)
    note = "<p class='muted'>Some of these are flagged on the safe side.</p>" if g["rule_id"] == "AI004" else ""
    path = li(f"<b>{k}:</b> {esc(g[f])}" for k, f in (("Trigger", "told_trigger"), ("Exposure", "told_exposure"), ("Effect", "told_effect"), ("Mitigation", "told_mitigation")))
    yield f"<div class='card {g['severity']}'><h4>{esc(_head(g))}</h4><p class='muted'>Confidence: {_label(g['confidence_max'])} ({g['range']})</p><p>{esc(g['reason'])}</p><ul>{li(map(esc, g['told_flagged']))}</ul><ul>{path}</ul>{note}<p><b>Fix:</b> {esc(g['recommendation'])}</p><ul>"
    for n, o in enumerate(report.occurrences(g)):
        if n == 2:
            yield f"</ul><p>More occurrences ({g['n_occurrences'] - 2}):</p><ul>"
        yield f"<li>{esc(o['file'])}:{o['line']}{_html_snippet(o['snippet']) if n < 2 else ''}</li>"
    yield "</ul></div>"


def html_parts(report: Report) -> Iterator[str]:
    s = report.summary
    li = lambda rows, none: "".join(f"<li>{x}</li>" for x in rows) or f"<li class='muted'>{none}</li>"
    stops = ", ".join(f"{_COLOURS[m['severity']]} {m['from_percent']:.2f}% {m['to_percent']:.2f}%" for m in report.mix) if s["total"] else f"{_COLOURS['low']} 0% 100%"
    b = report.baseline
    base = "not used" if b is None else f"created now, {b['current_count']} findings" if b["created"] else f"{b['new_or_regressed_count']} new or worse, {b['unchanged_count']} unchanged"
    top = "".join(f"<div class='card {g['severity']}'><h4>{esc(_head(g))}</h4><p>{esc(g['told_impact'])}</p><p><b>Fix now:</b> {esc(g['told_short_fix'])}</p><p class='muted'>Confidence: {_label(g['confidence_max'])} ({g['range']})</p></div>" for g in report.top)
    ignored = (f"<b>{_severity(x['severity'])} {esc(x['rule_id'])}</b> {esc(x['file'])}:{x['line']} <span class='muted'>{esc(x['reason'])} (directive in line {x['annotation_line']})</span>{_html_snippet(x['snippet'])}" for x in report.ignored)
    info = []
    for g in report.informational:
        shown, remaining = _preview(g, 6)
        info.append(f"{esc(g['title'])} <i>not a vulnerability</i> ({g['n_occurrences']})<ul>{li(map(esc, shown), 'None.')}{f'<li>and {remaining} more</li>' if remaining else ''}</ul>")
    mix = li((f"{m['severity']}: {m['n']} ({m['percent']}%)" for m in report.mix), "None.")
    yield (
        f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>Code risk report</title><style>{_CSS}</style></head><body><h1>Code risk report</h1><p class='muted'>Scanned at {esc(report.meta['scannedAt'])}</p>"
        f"<section id='summary'><h2>1. Summary</h2><p>Risk posture <b>{s['posture']}</b>, {s['total']} findings</p><div class='mix' style='background:linear-gradient(90deg, {stops})'></div><ul>{mix}</ul><p>{esc(s['narrative'])}</p>"
        f"<p>Decision: <b>{s['decision']}</b>; must be fixed first: {s['must_fix']}; baseline: {base}</p><ul>{li(map(esc, actions(report)), 'Nothing urgent.')}</ul></section>"
        f"<section id='priority'><h2>2. Priority risks</h2>{top or '<p>No issues found.</p>'}</section><section id='plan'><h2>3. Fix plan</h2><ul>{li(map(esc, actions(report)), 'Nothing to fix.')}</ul></section>"
        "<section id='findings'><h2>4. Findings</h2>"
    )
    for name, groups in _categorized(report):
        yield f"<h3>{esc(name)}</h3>"
        for g in groups:
            yield from _card(report, g)
    yield f"{'' if report.groups else '<p>No issues found.</p>'}</section><section id='ignored'><h2>5. Ignored</h2><ul>"
    yield from (f"<li>{x}</li>" for x in ignored)
    yield f"{'' if report.ignored else li([], 'None.')}</ul></section><section id='informational'><h2>6. Informational</h2><ul>{li(info, 'None.')}</ul></section></body></html>"


def to_terminal(report: Report, limit: int = 3) -> str:
    s = report.summary
    out = ["Code risk report", "=" * 16, f"Scanned at    : {report.meta['scannedAt']}", f"Risk posture  : {s['posture']}", f"Total issues  : {s['total']}", f"Severity      : critical {s['critical']}, high {s['high']}, medium {s['medium']}, low {s['low']}"]
    out += [f"Ignored       : {len(report.ignored)}"] * bool(report.ignored) + [f"Informational : {len(report.informational)}"] * bool(report.informational) + [""]
    if not s["total"]:
        return "\n".join([*out, "No issues found."])
    top = report.top[: max(0, limit)]
    for n, g in enumerate(top, 1):
        out += [f"{n}. {_head(g)}", f"   Confidence: {_label(g['confidence_max'])} ({g['confidence_max']:.2f})", f"   Impact    : {g['told_impact']}", f"   Why risky : {g['reason']}"]
    if len(top) < s["total"]:
        out += ["", f"Shown: {len(top)} rules of {s['total']} findings. --output writes all."]
    for g in report.informational:
        shown, remaining = _preview(g, 5)
        out += ["", f"- INFO {g['title']} (not a vulnerability)", *(f"  {x}" for x in shown), *([f"  and {remaining} more"] if remaining else [])]
    return "\n".join(out)


def to_json(report: Report) -> str:
    return "".join(json_parts(report))


def to_markdown(report: Report) -> str:
    return "".join(markdown_parts(report))


def to_html(report: Report) -> str:
    return "".join(html_parts(report))


FORMATS = {".json": json_parts, ".md": markdown_parts, ".html": html_parts}


def write_report(report: Report, path: str, spark: SparkSession | None = None) -> None:
    """The format goes by the ending. With a session the path may lie in any storage."""
    ending = next((e for e in FORMATS if path.lower().endswith(e)), None)
    if ending is None:
        raise ValueError(f"{path}: use .json, .md or .html")
    write_text(spark, local_uri(path), FORMATS[ending](report))
