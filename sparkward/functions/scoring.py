"""Severities, confidence, keys and labels of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("low", "medium", "high", "critical")
_SOURCE_ENDING = r"\.(ts|tsx|js|jsx)$"


def severity_rank(severity: Column) -> Column:
    """critical 4, high 3, medium 2, low 1, anything else (null too) 0."""
    ranked = F.lit(0)
    for rank, name in enumerate(SEVERITIES, 1):
        ranked = F.when(severity == name, rank).otherwise(ranked)
    return ranked


def severity_label(severity: Column) -> Column:
    return F.upper(severity)


def severity_label_plain(severity: Column) -> Column:
    return F.when(severity.isin(*SEVERITIES), F.upper(severity)).otherwise("UNKNOWN")


def is_informational(rule_id: Column) -> Column:
    return rule_id.startswith("LLM_")


def confidence(direct: Column, built: Column, request: Column, llm: Column) -> Column:
    """0.3 for direct user input, 0.3 for a concatenated or templated string, 0.2 for a request object, 0.2 for an LLM call."""
    tenths = direct.cast("int") * 3 + built.cast("int") * 3 + request.cast("int") * 2 + llm.cast("int") * 2
    return F.least(F.round(tenths / 10.0, 2), F.lit(1.0))


def confidence_label(value: Column) -> Column:
    return F.when(value >= 0.75, "High").when(value >= 0.5, "Medium").otherwise("Low")


def confidence_range(low: Column, high: Column) -> Column:
    return F.when(low == high, F.format_string("%.2f", low)).otherwise(F.format_string("%.2f-%.2f", low, high))


def file_key(file: Column) -> Column:
    """The file as dedupe sees it: forward slashes, lower case, no source ending."""
    return F.regexp_replace(F.lower(F.replace(file, F.lit("\\"), F.lit("/"))), _SOURCE_ENDING, "")


def finding_key(rule_id: Column, file: Column, line: Column) -> Column:
    """The finding as the baseline sees it: the path in lower case, its ending kept."""
    return F.concat_ws("|", rule_id, F.lower(F.replace(file, F.lit("\\"), F.lit("/"))), line.cast("string"))


def posture(critical: Column, high: Column, medium: Column) -> Column:
    return F.when((critical > 0) | (high > 0), "High").when(medium > 0, "Medium").otherwise("Low")


def release_decision(critical: Column, high: Column, medium: Column) -> Column:
    return F.when((critical > 0) | (high > 0), "Block Release").when(medium > 0, "Proceed with Caution").otherwise("Ready for Release")


def risk_percentage(part: Column, total: Column) -> Column:
    """Rounded half up; 0 where there is nothing."""
    return F.when(total > 0, F.floor(part * (100.0 / total) + 0.5)).otherwise(F.lit(0)).cast("long")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def resolve_path(root: Column, path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path))


def relative_path(root: Column, path: Column) -> Column:
    """path below root, or path itself if it lies elsewhere."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(path)


def valid_package_name(name: Column, scoped: bool = True) -> Column:
    """scoped=False leaves out npm's @scope/name, as a check by plain registry names does."""
    return name.rlike(r"^(@[\w.-]+/)?[\w.@-]{1,214}$" if scoped else r"^[\w.@-]{1,214}$")
