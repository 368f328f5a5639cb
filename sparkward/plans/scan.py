"""Scanning: files -> facts -> rules -> distinct findings -> ignore directives -> dependencies -> severity -> baseline."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dependencies as D
from ..operators import directives as I
from ..operators import findings as A
from ..operators import rules as R
from ..operators.snippets import with_snippets
from ..sources.baseline import read_baseline, write_baseline
from ..sources.extract import extract
from ..sources.manifests import package_candidates
from ..sources.repository import manifest_files, source_files
from ..sources.storage import exists, local_uri


@dataclass
class Scan:
    findings: DataFrame
    ignored: DataFrame
    files: DataFrame
    facts: DataFrame
    baseline: dict | None = None
    directives: DataFrame | None = None

    def release(self) -> None:
        """Free the cached facts and directives; what is derived from them is computed anew if it is read again."""
        self.facts.unpersist()
        if self.directives is not None:
            self.directives.unpersist()

    def unreadable(self) -> DataFrame:
        return self.facts.where("error IS NOT NULL").select("repo", "file", "error")


def scan_files(files: DataFrame, selected: list[str] | None = None, extra: dict | None = None, keyword: str = I.KEYWORD) -> Scan:
    """files: repo, file, text. The facts are cached: five rules read what is extracted once; so are the directives, read twice."""
    facts = extract(files).persist()
    found = A.distinct_findings(R.run_rules(facts, selected, extra))
    directives = I.parse_directives(files, keyword).persist()
    active, ignored = I.apply_directives(found, directives)
    return Scan(active, ignored, files, facts, directives=directives)


def scan_repository(spark: SparkSession, *paths: str, selected: list[str] | None = None) -> DataFrame:
    return scan_files(source_files(spark, *paths), selected).findings


def scan(spark: SparkSession, *paths: str, selected: list[str] | None = None, only_ai: bool = False, severity: str | None = None, baseline: str | None = None, check_dependencies: bool = False, registry: DataFrame | None = None) -> Scan:
    """As the command line does it: directives before severity, severity before baseline, dependencies after directives."""
    rules = R.select_rules(selected, only_ai)
    out = scan_files(source_files(spark, *paths), rules)
    if check_dependencies:
        out.findings = out.findings.unionByName(D.dependency_findings(package_candidates(manifest_files(spark, *paths)), registry))
    out.findings = A.at_least(out.findings, severity)
    out.ignored = A.at_least(out.ignored, severity, "finding.severity")
    if baseline is not None:
        out.findings, out.baseline = apply_baseline(out.findings, baseline)
    return out


def apply_baseline(findings: DataFrame, path: str) -> tuple[DataFrame, dict]:
    """Against a baseline file only what is new or worse is left. Without one it is written, once, and all findings stay."""
    spark = findings.sparkSession
    if exists(spark, local_uri(path)):
        known = read_baseline(spark, path)
        return A.baseline_diff(findings, known), {"created": False, "path": path, **A.baseline_counts(findings, known).first().asDict()}
    write_baseline(findings, path)
    n = findings.count()
    return findings, {"created": True, "path": path, "baseline_count": n, "current_count": n, "new_or_regressed_count": n, "unchanged_count": 0}


ORDER = ("rule_ord", "file", "fn_pos", "call_pos", "node_ord")
PLACE = ("file", "line", *ORDER[:1], *ORDER[2:])
SHOWN = 200  # occurrences of a rule that a report holds; a written one lists all


class Streamed:
    """Rows of any number: how many, and they themselves as they are read, a partition at a time on the driver."""

    def __init__(self, rows: DataFrame, count: int):
        self.rows, self.count = rows, count

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[dict]:
        return (r.asDict(recursive=True) for r in self.rows.toLocalIterator())


@dataclass
class Report:
    """What a report shows: small by nature (a row per rule), collected once. places: all occurrences of all rules, in
    order once those of a rule are chosen; they and the ignored rows stay where they are until a report is written.
    """

    meta: dict
    summary: dict
    groups: list[dict] = field(default_factory=list)
    top: list[dict] = field(default_factory=list)
    categories: list[dict] = field(default_factory=list)
    informational: list[dict] = field(default_factory=list)
    ignored: list[dict] | Streamed = field(default_factory=list)
    mix: list[dict] = field(default_factory=list)
    baseline: dict | None = None
    places: DataFrame | None = None
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Free what is cached; occurrences that are read later are computed anew."""
        for rows in self.cached:
            rows.unpersist()

    def occurrences(self, group: dict) -> list[dict] | Streamed:
        """All occurrences of a group, in order."""
        if len(group["occurrences"]) == group["n_occurrences"]:
            return group["occurrences"]
        return Streamed(self.places.where(F.col("rule_id") == group["rule_id"]).orderBy(*PLACE).select("file", "line", "snippet"), group["n_occurrences"])


def build_report(result: Scan, version: str = "0.1.0", scanned_at: str | None = None, shown: int = SHOWN) -> Report:
    from ..functions.catalog import with_catalog

    findings = result.findings
    snipped = with_snippets(findings, result.files).persist()

    def grouped(rows: DataFrame) -> DataFrame:
        g = A.group_by_rule(rows, order=PLACE, snippet=True, preview=shown)
        return with_catalog(g).withColumns({"told_short_fix": F.coalesce("told_short_fix", "recommendation"), "range": A.range_text(g)})

    groups = grouped(A.issues(snipped)).persist()  # a row per rule
    summary = A.with_decision(A.severity_summary(A.issues(snipped)))
    told = summary.withColumn("narrative", A.narrative(summary))
    ignored = with_snippets(result.ignored.select("finding.*", "reason", "annotation_line"), result.files).persist()
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    report = Report(
        meta={"tool": "sparkward", "version": version, "scannedAt": scanned_at or datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")},
        summary=rows(told)[0], groups=rows(groups.orderBy("first_place")), top=rows(A.top_groups(groups)), categories=rows(A.by_category(groups)),
        informational=rows(grouped(A.informational(snipped)).orderBy("first_place")), ignored=Streamed(ignored.orderBy("file", "line", "rule_id", "annotation_line"), ignored.count()), mix=rows(A.risk_mix(summary)), baseline=result.baseline, places=snipped, cached=[snipped, ignored],
    )
    groups.unpersist()
    return report
