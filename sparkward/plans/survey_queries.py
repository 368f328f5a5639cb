"""Further registered queries: whole scans, reports, baselines, joins with lines and prose, and the command line.

Sources are written around the rows of part and nation, so they grow with the tables; findings are made of events.
"""

from __future__ import annotations

import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as K
from ..functions import scoring as S
from ..operators import dependencies as D
from ..operators import findings as A
from ..operators import rules as R
from ..operators import snippets as N
from ..sources import extract as X
from ..sources.baseline import read_baseline, write_baseline
from ..sources.repository import source_files
from ..sources.state import read_state, write_state
from ..sources.storage import scratch_path, write_text
from . import queries as Q
from .cli import main, parse_limit, parse_rules, parse_severity
from .render import write_report
from .scan import Scan, apply_baseline, build_report, scan, scan_files, scan_repository

query, _F, _GROUPS, _RANK = Q.query, Q._F, Q._GROUPS, Q._RANK


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    return X.spread(Q._table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.lit("r").alias("repo"), F.concat(F.lit("src/"), key, F.lit(".ts")).alias("file"), F.format_string(Q._SOURCE, key).alias("text"))


_PART_FILE = "'src/p' || p_partkey || '.ts'"

# --- facts and rules over sources that grow with the tables


@query(f"SELECT {_PART_FILE} AS file, rule_id, line::INT AS line, c::DOUBLE AS confidence, severity FROM part, {Q._EXPECTED} v(rule_id, line, c, severity)")
def scan_part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per part through extraction, all rules, distinct and directives."""
    return scan_files(_part_files(spark, sf_dir)).findings.select("file", "rule_id", "line", F.col("confidence").cast("double").alias("confidence"), "severity")


@query(f"SELECT {_PART_FILE} AS file, callee, line::INT AS line, n::INT AS n_args FROM part, (VALUES ('console.log', 6, 2), ('openai.chat.completions.create', 7, 1), ('requireAuth', 8, 1), ('anthropic.messages.create', 9, 1), ('JSON.stringify', 9, 1)) v(callee, line, n)")
def source_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.calls(X.extract(_part_files(spark, sf_dir), ("calls",))).select("file", F.col("callee_text").alias("callee"), F.col("start_line").alias("line"), F.size("args").alias("n_args"))


@query(f"SELECT {_PART_FILE} AS file, callee FROM part, (VALUES ('openai.chat.completions.create'), ('anthropic.messages.create')) v(callee)")
def calls_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.calls_named(X.calls(X.extract(_part_files(spark, sf_dir), ("calls",))), "CREATE").select("file", F.col("callee_text").alias("callee"))


@query(f"SELECT {_PART_FILE} AS file, 'AI001' AS detector, 7 AS line, '`Hello ${{copy}}` + \"!\"' AS node FROM part UNION ALL SELECT {_PART_FILE}, 'AI004', 7, '`Hello ${{copy}}` + \"!\"' FROM part")
def prompt_concatenations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.concatenations(X.call_prompt_nodes(X.extract(_part_files(spark, sf_dir), ("nodes",)))).select("file", "detector", F.col("node_line").alias("line"), F.col("node_text").alias("node"))


@query(f"SELECT {_PART_FILE} AS file, name, origin FROM part, (VALUES ('body', 'unknown'), ('copy', 'identifier'), ('answer', 'call')) v(name, origin)")
def variable_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.variable_origins(X.decls(X.extract(_part_files(spark, sf_dir), ("decls",)))).select("file", F.col("name_text").alias("name"), "origin")


@query(f"SELECT {_PART_FILE} AS file, 'X1' AS rule_id, 8 AS line FROM part")
def extra_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of the caller's own beside a registered one that finds nothing here."""
    own = {"X1": lambda facts: R._findings(X.calls_named(X.calls(facts), "auth"), "AI100", "own", "low", "start_line", F.lit(0.5), rule_id=F.lit("X1"))}
    rows = R.run_rules(X.extract(_part_files(spark, sf_dir)), ["AI003"], own)
    return rows.where("rule_id != 'AI003'").select("file", "rule_id", "line")


@query("SELECT id, place FROM (VALUES ('AI001', 0), ('AI100', 1), ('AI002', 2), ('AI003', 3), ('AI004', 4)) v(id, place)")
def ai_only_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(zip(R.select_rules(only_ai=True), range(5))), "id string, place int")


# --- findings


@query(_F + f"SELECT ord, severity FROM f WHERE {_RANK} >= 3")
def ignored_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignored rows, whose finding is a struct, of a severity or above."""
    ignored = Q.findings_of(spark, sf_dir).select(F.struct("severity", "rule_id").alias("finding"), "ord")
    return A.at_least(ignored, "high", "finding.severity").select("ord", "finding.severity")


@query(_F + "SELECT ord, row_number() OVER (PARTITION BY replace(file, '\\', '/') ORDER BY line, ord) AS place FROM f")
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.findings_of(spark, sf_dir).select("ord", A.place_in_file().alias("place"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' ELSE 'ODD' END AS label, CASE event_id % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' ELSE 'UNKNOWN' END AS plain FROM events")
def severity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.element_at(F.array(*map(F.lit, (*S.SEVERITIES, "odd"))), (F.col("event_id") % 5 + 1).cast("int"))
    return Q._table(spark, sf_dir, "events").select("event_id", S.severity_label(severity).alias("label"), S.severity_label_plain(severity).alias("plain"))


@query(
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '/root/r' || user_id || '/a.ts' ELSE '/root/src/' || user_id END AS resolved, "
    "CASE WHEN event_id % 2 = 0 THEN '/root/r' || user_id || '/a.ts' ELSE 'src/' || user_id END AS relative FROM events"
)
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute paths stay, others are below the root; and back again."""
    user = F.col("user_id").cast("string")
    path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/root/r"), user, F.lit("/a.ts"))).otherwise(F.concat(F.lit("src/"), user))
    e = Q._table(spark, sf_dir, "events").select("event_id", S.resolve_path(F.lit("/root/"), path).alias("resolved"))
    # what lies elsewhere stays as it is
    return e.select("event_id", "resolved", F.when(F.col("event_id") % 2 == 0, S.relative_path(F.lit("/other"), F.col("resolved"))).otherwise(S.relative_path(F.lit("/root"), F.col("resolved"))).alias("relative"))


@query(
    _F + f", s AS (SELECT file, line, {Q._COUNTS} {Q._ISSUES} GROUP BY 1, 2) SELECT file, line, CASE WHEN critical + high > 0 THEN printf('The scan found %d issue(s), %d critical and %d high. Risk posture: High; fix the priority risks before a release.', total, critical, high) "
    "WHEN medium > 0 THEN printf('The scan found %d issue(s), mostly medium. Risk posture: Medium; plan fixes ahead of releases.', total) ELSE printf('The scan found %d low issue(s). Risk posture: Low; handle them in maintenance.', total) END AS narrative FROM s"
)
def risk_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.with_decision(A.severity_summary(A.issues(Q.findings_of(spark, sf_dir)), ("file", "line")))
    return s.select("file", "line", A.narrative(s).alias("narrative"))


@query(
    _F + f", s AS (SELECT file, {Q._COUNTS} {Q._ISSUES} GROUP BY 1), u AS (SELECT file, total, unnest([0, 1, 2, 3]) AS place, unnest(['critical', 'high', 'medium', 'low']) AS severity, unnest([critical, high, medium, low]) AS n FROM s), "
    "w AS (SELECT *, n * 100.0 / total AS share, sum(n * 100.0 / total) OVER (PARTITION BY file ORDER BY place) AS upto FROM u) SELECT file, place, n, floor(n * (100.0 / total) + 0.5)::BIGINT AS percent, round(upto, 2)::DOUBLE AS to_percent FROM w"
)
def risk_mix_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each file, many with equal totals."""
    return A.risk_mix(A.severity_summary(A.issues(Q.findings_of(spark, sf_dir)), ("file",)), ("file",)).select("file", "place", "n", "percent", "to_percent")


def _fixes() -> str:
    told = " ".join(f"WHEN '{r}' THEN {Q._quoted(t['short_fix'])}" for r, t in K.CATALOG.items())
    return f"CASE rule_id {told} ELSE recommendation END"


@query(_F + _GROUPS + f" SELECT rule_id, upper(severity) || ' ' || rule_id || ': ' || {_fixes()} AS action FROM g")
def top_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = K.with_catalog(A.group_by_rule(Q.findings_of(spark, sf_dir), preview=0))
    return g.select("rule_id", A.top_actions(g).alias("action"))


@query(_F + "SELECT rule_id, string_agg(file || ':' || line, ',' ORDER BY ord) FILTER (k <= 2) AS first_two, string_agg(file || ':' || line, ',' ORDER BY ord) FILTER (k > 2) AS overflow FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ord) AS k FROM f) WHERE k <= 6 GROUP BY 1")
def evidence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.group_by_rule(Q.findings_of(spark, sf_dir), preview=6).select("rule_id", A.split_evidence(F.col("occurrences")).alias("e"))
    told = lambda c: F.array_join(F.transform(c, lambda o: F.concat(o["file"], F.lit(":"), o["line"].cast("string"))), ",")
    return g.select("rule_id", told(F.col("e.primary")).alias("first_two"), told(F.col("e.overflow")).alias("overflow"))


@query(_F + _GROUPS + f" SELECT n, rule_id FROM (SELECT *, row_number() OVER (ORDER BY {_RANK} DESC, confidence_max DESC, first_place) AS k FROM g WHERE NOT starts_with(rule_id, 'LLM_')), (VALUES (1), (2), (9)) v(n) WHERE k <= least(3, n)")
def group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit lowers the three groups that are shown, never raises them."""
    g = A.group_by_rule(A.issues(Q.findings_of(spark, sf_dir)), preview=0)
    parts = [A.top_groups(g, limit=n).select(F.lit(n).alias("n"), "rule_id") for n in (1, 2, 9)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _prose_sql() -> str:
    row = lambda r, t: "(" + ", ".join([f"'{r}'", *(Q._quoted(t[f]) for f in ("impact", "short_fix", "trigger", "exposure", "effect", "mitigation")), Q._quoted("|".join(t["flagged"]))]) + ")"
    other = K.DEFAULT | {"short_fix": ""}
    names = ("impact", "short_fix", "trigger", "exposure", "effect", "mitigation", "flagged")
    told = ", ".join(f"coalesce(c.{n}, {Q._quoted('|'.join(other[n]) if n == 'flagged' else other[n])}) AS {n}" for n in names)
    return f"WITH f AS ({Q.FINDINGS}), c(rule_id, {', '.join(names)}) AS (VALUES {', '.join(row(r, t) for r, t in K.CATALOG.items())}) SELECT ord, rule_id, {told} FROM f LEFT JOIN c USING (rule_id)"


@query(_prose_sql())
def rule_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding with what the catalog tells of its rule, or what is told of rules that it hasn't."""
    f = K.with_catalog(Q.findings_of(spark, sf_dir))
    return f.select("ord", "rule_id", *[F.coalesce(f"told_{n}", F.lit("")).alias(n) for n in ("impact", "short_fix", "trigger", "exposure", "effect", "mitigation")], F.array_join("told_flagged", "|").alias("flagged"))


# --- lines around findings


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files, and findings on their lines: one of the first six, the first, and one in a file that isn't there."""
    d = Q._table(spark, sf_dir, "documents")
    file = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    files = d.select(F.lit("r").alias("repo"), file.alias("file"), "text")
    lines = F.explode(F.array((F.col("doc_id") % 6 + 1).cast("int"), F.lit(1), F.lit(-1))).alias("line")
    found = d.select(F.lit("r").alias("repo"), file.alias("file"), lines, "doc_id").select("repo", F.when(F.col("line") < 0, F.concat("file", F.lit("?"))).otherwise(F.col("file")).alias("file"), F.abs("line").alias("line"), "doc_id")
    return files, found


def _snippet_sql(row: str, head: str, tail: str, glue: str) -> str:
    return f"""
        WITH l AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents),
        f AS (SELECT doc_id, unnest([(doc_id % 6 + 1)::INT, 1, 1]) AS line, unnest([true, true, false]) AS there FROM documents),
        x AS (SELECT f.*, ls, greatest(1, line - 2) AS a, least(len(ls), line + 2) AS b FROM f JOIN l USING (doc_id))
        SELECT doc_id, line, there, CASE WHEN there AND line <= len(ls) THEN md5('{head}' || list_aggregate(list_transform(range(a, b + 1), lambda i: {row}), 'string_agg', {glue}) || '{tail}') END AS snippet_md5 FROM x"""


@query(_snippet_sql("CASE WHEN i = line THEN '>>' ELSE '  ' END || ' ' || lpad(i::VARCHAR, 4, ' ') || ' | ' || ls[i]", "```ts' || chr(10) || '", "' || chr(10) || '```", "chr(10)"))
def finding_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of findings with the lines around them; a file or a line that isn't there gives none."""
    files, found = _documents(spark, sf_dir)
    s = N.with_snippets(found, files)
    return s.select("doc_id", "line", (~F.col("file").endswith("?")).alias("there"), F.when(F.col("snippet").isNotNull(), F.md5(N.markdown_snippet(F.col("snippet")).cast("binary"))).alias("snippet_md5"))


_ESCAPED = "replace(replace(replace(replace(replace(ls[i], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(_snippet_sql(f"'<div class=\"row' || CASE WHEN i = line THEN ' hit' ELSE '' END || '\"><b>' || i || '</b> ' || {_ESCAPED} || '</div>'", '<pre class="code">', "</pre>", "''"))
def html_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, found = _documents(spark, sf_dir)
    s = N.with_snippets(found, files)
    return s.select("doc_id", "line", (~F.col("file").endswith("?")).alias("there"), F.when(F.col("snippet").isNotNull(), F.md5(N.html_snippet(F.col("snippet")).cast("binary"))).alias("snippet_md5"))


# --- baselines and dependencies


@query(_F + "SELECT rule_id, file, line, severity, confidence, (row_number() OVER (ORDER BY rule_id || '|' || lower(file) || '|' || line) - 1)::INT AS ord FROM (SELECT rule_id, file, line, arg_max(severity, ord) AS severity, max(confidence) AS confidence FROM f GROUP BY rule_id, file, line)")
def baseline_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as a baseline, one of each place, and read again in its order."""
    f = Q.findings_of(spark, sf_dir).groupBy("rule_id", "file", "line").agg(F.max_by("severity", "ord").alias("severity"), F.max("confidence").alias("confidence"))
    path = scratch_path(spark, "baseline") + "/base.json"
    write_baseline(f, path)
    return read_baseline(spark, path).select("rule_id", "file", "line", "severity", "confidence", "ord")


@query(
    Q._F2 + Q._BASE + f", w AS (SELECT count(*) AS n FROM n LEFT JOIN b USING (key) WHERE {Q._WORSE}), c AS (SELECT count(*) FILTER (old) AS o, count(*) FILTER (NOT old) AS c FROM k) ".replace("b.key IS NULL", "c0 IS NULL")
    + "SELECT 1 AS run, true AS created, o AS baseline_count, o AS current_count, o AS new_or_regressed_count, 0::BIGINT AS unchanged_count, o AS shown FROM c UNION ALL SELECT 2, false, o, c, n, greatest(0, c - n), n FROM w, c"
)
def baseline_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run makes the baseline, where of findings with one key the last counts, and shows all; a second one is held against it."""
    current, old = Q._split_baseline(spark, sf_dir)
    path = scratch_path(spark, "baseline") + "/base.json"
    rows = []
    for run, f in ((1, old), (2, current)):
        shown, info = apply_baseline(f, path)
        rows.append((run, info["created"], info["baseline_count"], info["current_count"], info["new_or_regressed_count"], info["unchanged_count"], shown.count()))
    return spark.createDataFrame(rows, "run int, created boolean, baseline_count long, current_count long, new_or_regressed_count long, unchanged_count long, shown long")


@query(
    f"""WITH c AS (SELECT p_partkey::INT AS ord, {Q._NAMES} AS name FROM part), t(trusted, k) AS (VALUES {Q._TRUSTED}),
    r AS (SELECT name, CASE WHEN ord % 10 = 0 THEN NULL ELSE ord % 5 <> 0 END AS found FROM c), known AS (SELECT DISTINCT name FROM r WHERE coalesce(found, true)),
    bad AS (SELECT * FROM c WHERE NOT regexp_full_match(name, '(@[A-Za-z0-9_.-]+/)?[A-Za-z0-9_.@-]{{1,214}}') OR name NOT IN (SELECT name FROM known))
    SELECT ord, 'LLM_DEP001' AS rule_id, name || ' was not found in npm.' AS summary FROM bad
    UNION ALL SELECT ord, 'LLM_DEP002', name || ' may be confused with ' || arg_min(trusted, k) || '.' FROM c JOIN t ON levenshtein(lower(name), trusted) = 1 WHERE lower(name) NOT IN (SELECT trusted FROM t) AND ord NOT IN (SELECT ord FROM bad) GROUP BY ord, name"""
)
def dependency_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages held against a registry some of whose lookups failed, which counts as found; a missing one is no look-alike too."""
    c = Q._packages(spark, sf_dir)
    registry = c.select("ecosystem", "name", F.when(F.col("ord") % 10 != 0, F.col("ord") % 5 != 0).alias("found"))
    return D.dependency_findings(c, registry).select(F.col("call_pos").alias("ord"), "rule_id", "summary")


# --- a repository in storage, scanned as the command line does


def _repository(spark: SparkSession, sf_dir: str) -> str:
    """A repository of its own folder: a source for each nation, and what isn't to be read."""
    root = scratch_path(spark, "repository")
    for r in Q._nation_files(spark, sf_dir).orderBy("file").collect():  # a row per nation
        write_text(spark, f"{root}/{r['file']}", [r["text"]])
    for name in ("node_modules/x/a.ts", "src/dist/b.ts", ".hidden/c.ts", "src/d.mjs", "src/.e.ts"):
        write_text(spark, f"{root}/{name}", ["openai.chat.completions.create({ prompt: `${a}` })"])
    write_text(spark, f"{root}/src/_app.tsx", ["export const x = 1;\n"])
    write_text(spark, f"{root}/package.json", [json.dumps({"dependencies": {"opena1": "1", "react": "1"}}, indent=1)])
    write_text(spark, f"{root}/requirements.txt", ["# c\nreqests>=1\n"])
    return root


@query(f"SELECT {Q._NATION_FILE} AS file FROM nation UNION ALL SELECT 'src/_app.tsx'")
def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files(spark, _repository(spark, sf_dir)).select("file")


@query(f"SELECT {Q._NATION_FILE} AS file, rule_id, line::INT AS line FROM nation, {Q._EXPECTED} v(rule_id, line, c, severity)")
def repository_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repository(spark, _repository(spark, sf_dir)).select("file", "rule_id", "line")


_REPOSITORY = f"""SELECT {Q._NATION_FILE} AS file, rule_id, line::INT AS line, severity FROM nation, {Q._EXPECTED} v(rule_id, line, c, severity) WHERE severity IN ('high', 'critical')"""


@query(_REPOSITORY)
def repository_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, directives and dependencies, of high severity or above."""
    registry = spark.createDataFrame([("npm", "react"), ("npm", "opena1")], "ecosystem string, name string")
    return scan(spark, _repository(spark, sf_dir), severity="high", check_dependencies=True, registry=registry).findings.select("file", "rule_id", "line", "severity")


@query("SELECT * FROM (VALUES ('package.json', 'LLM_DEP002', 3, 'low'), ('requirements.txt', 'LLM_DEP001', 2, 'low')) v(file, rule_id, line, severity)")
def repository_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency findings join a scan's after its directives, so none can be ignored."""
    registry = spark.createDataFrame([("npm", "react"), ("npm", "opena1")], "ecosystem string, name string")
    return scan(spark, _repository(spark, sf_dir), selected=["AI100"], check_dependencies=True, registry=registry).findings.where("rule_id LIKE 'LLM_DEP%'").select("file", "rule_id", "line", "severity")


# --- reports


def _written_report(spark: SparkSession, sf_dir: str, name: str) -> str:
    result: Scan = scan_files(Q._nation_files(spark, sf_dir))
    report = build_report(result, scanned_at="now", shown=4)
    path = f"{scratch_path(spark, 'report')}/{name}"
    write_report(report, path, spark)
    report.release()
    result.release()
    return path


@query(
    f"""SELECT part, rule_id, severity, n, {Q._NATION_FILE} AS file, line::INT AS line, hit FROM (SELECT count(*) AS n FROM nation), nation,
    (SELECT part, v.* FROM {Q._EXPECTED} v(rule_id, line, c, severity), (VALUES ('prioritizedFindings'), ('allFindings'), ('informational')) p(part) WHERE (part = 'informational') = starts_with(rule_id, 'LLM_')),
    LATERAL (SELECT line AS hit) UNION ALL SELECT 'ignoredFindings', 'AI004', 'high', 1, {Q._NATION_FILE}, 9, 2 FROM nation"""
)
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written JSON report, read back: all occurrences of all rules, beyond those that the report holds, and all ignored findings."""
    group = "array<struct<rule_id: string, severity: string, n_occurrences: long, occurrences: array<struct<file: string, line: int, snippet: array<struct<line_number: int, highlight: boolean>>>>>>"
    parts = ("prioritizedFindings", "allFindings", "informational")
    schema = ", ".join(f"{p} {group}" for p in parts) + ", ignoredFindings array<struct<rule_id: string, severity: string, file: string, line: int, annotation_line: int>>"
    told = spark.read.schema(schema).json(_written_report(spark, sf_dir, "report.json"), multiLine=True)
    hit = F.element_at(F.filter("o.snippet", lambda s: s["highlight"]), 1)["line_number"]
    rows = [told.select(F.explode(p).alias("g")).select(F.lit(p).alias("part"), "g.rule_id", "g.severity", F.col("g.n_occurrences").alias("n"), F.explode("g.occurrences").alias("o")).select("part", "rule_id", "severity", "n", "o.file", "o.line", hit.alias("hit")) for p in parts]
    ignored = told.select(F.explode("ignoredFindings").alias("i")).select(F.lit("ignoredFindings").alias("part"), "i.rule_id", "i.severity", F.lit(1).cast("long").alias("n"), "i.file", "i.line", F.col("i.annotation_line").alias("hit"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(ignored)


_EVIDENCE = f"""SELECT said, count(*) AS n FROM (SELECT {{before}} || {Q._NATION_FILE} || ':' || line || {{after}} AS said FROM nation, {Q._EXPECTED} v(rule_id, line, c, severity) WHERE NOT starts_with(rule_id, 'LLM_')) GROUP BY said"""


@query(_EVIDENCE.format(before="'- '", after="''"))
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of a written Markdown report: all occurrences of the issues, its informational previews aside."""
    lines = spark.read.text(_written_report(spark, sf_dir, "report.md"), wholetext=True).select(F.regexp_extract("value", r"(?s)## 4\. Findings(.*)## 5\. Ignored", 1).alias("t"))
    return lines.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?m)^- src/\S+:\d+$"), 0)).alias("said")).groupBy("said").agg(F.count("*").alias("n"))


@query(_EVIDENCE.format(before="'<li>'", after="''"))
def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of a written HTML report's cards."""
    page = spark.read.text(_written_report(spark, sf_dir, "report.html"), wholetext=True).select(F.regexp_extract("value", r"(?s)<section id='findings'>(.*)<section id='ignored'>", 1).alias("t"))
    return page.select(F.explode(F.regexp_extract_all("t", F.lit(r"<li>src/[^:<]+:\d+"), 0)).alias("said")).groupBy("said").agg(F.count("*").alias("n"))


@query(
    """SELECT line, text FROM (VALUES (1, 'Code risk report'), (2, '================'), (3, 'Scanned at    : now'), (4, 'Risk posture  : High')) v(line, text)
    UNION ALL SELECT 5, 'Total issues  : ' || 3 * count(*) FROM nation UNION ALL SELECT 6, 'Severity      : critical ' || count(*) || ', high ' || 2 * count(*) || ', medium 0, low 0' FROM nation
    UNION ALL SELECT 7, 'Ignored       : ' || count(*) FROM nation UNION ALL SELECT * FROM (VALUES (8, 'Informational : 2'), (10, '1. CRITICAL AI003 - LLM call before authentication'), (14, '2. HIGH AI001 - Prompt injection via user input')) w(line, text)"""
)
def report_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head and first groups of the terminal's text, with a limit of two."""
    from .render import to_terminal

    result = scan_files(Q._nation_files(spark, sf_dir))
    report = build_report(result, scanned_at="now", shown=4)
    lines = [(n, t) for n, t in enumerate(to_terminal(report, 2).split("\n"), 1)]
    report.release()
    result.release()
    return spark.createDataFrame([x for x in lines if x[0] <= 8 or x[1][:1].isdigit()], "line int, text string")


@query(f"SELECT {Q._NATION_FILE} AS file, 'AI004' AS rule_id, 'high' AS severity, 9 AS line, 2 AS annotation_line, 9 AS hit FROM nation")
def ignored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignored findings as a report has them: finding, reason, directive's line and snippet."""
    result = scan_files(Q._nation_files(spark, sf_dir))
    rows = N.with_snippets(result.ignored.select("finding.*", "reason", "annotation_line"), result.files)
    return rows.select("file", "rule_id", "severity", "line", "annotation_line", F.element_at(F.filter("snippet", lambda s: s["highlight"]), 1)["line_number"].alias("hit"))


@query("SELECT count(*) * 3 AS total, count(*) AS critical, 2 * count(*) AS high, 'Block Release' AS decision, count(*) AS n_ignored, 3 AS n_groups, 3 AS n_top, 2 AS n_informational, 'sparkward' AS tool, '0.1.0' AS version, true AS told_when FROM nation")
def report_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's parts: issues are summed, informational findings and ignored ones stand apart; it says when it was made."""
    import re

    result = scan_files(Q._nation_files(spark, sf_dir))
    r = build_report(result, shown=2)
    when = re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z", r.meta["scannedAt"]) is not None
    row = (r.summary["total"], r.summary["critical"], r.summary["high"], r.summary["decision"], len(r.ignored), len(r.groups), len(r.top), len(r.informational), r.meta["tool"], r.meta["version"], when)
    r.release()
    result.release()
    return spark.createDataFrame([row], "total long, critical long, high long, decision string, n_ignored long, n_groups int, n_top int, n_informational int, tool string, version string, told_when boolean")


# --- the command line


@query("SELECT * FROM (VALUES ('severity', ' High ', 'high'), ('severity', 'worst', NULL), ('rules', 'ai001, AI004,', 'AI001,AI004'), ('rules', ' , ', NULL), ('rules', 'AI001,AI999', NULL), ('limit', '10abc', '10'), ('limit', '0', '0'), ('limit', '-1', NULL), ('limit', 'abc', NULL)) v(kind, given, parsed)")
def cli_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    import argparse

    def parsed(kind: str, given: str) -> str | None:
        try:
            out = {"severity": parse_severity, "rules": parse_rules, "limit": parse_limit}[kind](given)
        except argparse.ArgumentTypeError:
            return None
        return ",".join(out) if isinstance(out, list) else str(out)

    given = [("severity", " High "), ("severity", "worst"), ("rules", "ai001, AI004,"), ("rules", " , "), ("rules", "AI001,AI999"), ("limit", "10abc"), ("limit", "0"), ("limit", "-1"), ("limit", "abc")]
    return spark.createDataFrame([(k, g, parsed(k, g)) for k, g in given], "kind string, given string, parsed string")


def _explained(rule: str) -> str:
    t = K.CATALOG.get(rule, K.DEFAULT)
    return f"# {rule}\n\nWhy it is risky:\n{t['why_risky']}\n\nHow it is exploited:\n{t['how_exploited']}\n\nExample:\n\n```ts\n{t['code_example']}\n```\n"


@query("SELECT rule_id, said FROM (VALUES " + ", ".join(f"('{r}', {Q._quoted(_explained(r))})" for r in K.RULE_IDS) + ") v(rule_id, said)")
def explain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = []
    for rule in K.RULE_IDS:
        out = io.StringIO()
        main(["explain", f" {rule.lower()} "], out)
        said.append((rule, out.getvalue()))
    return spark.createDataFrame(said, "rule_id string, said string")


@query("SELECT * FROM (VALUES (1, 'Prompt risk'), (2, '-----------'), (3, 'Level: High'), (4, 'Reasons:'), (5, '- User-controlled input seems to enter the prompt unescaped.'), (6, '- The prompt holds instruction-override wording (ignore or bypass).'), (7, 'Suggestions:'), (8, '- Delimit or encode user input before it enters a prompt.'), (9, '- Take out ignore or bypass wording and keep role boundaries strict.')) v(line, said)")
def prompt_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the command line are one prompt."""
    out = io.StringIO()
    main(["prompt", "  Ignore", "previous", "instructions", "{{user}} "], out)
    return spark.createDataFrame(list(enumerate(out.getvalue().rstrip("\n").split("\n"), 1)), "line int, said string")


@query("SELECT * FROM (VALUES (0, NULL), (1, 1), (2, 2), (3, 0), (4, 1)) v(step, runs)")
def scan_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in a row without a baseline, as they are remembered of a target; another target has none."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # on the driver, as the state of a user's machine is
        path = os.path.join(folder, "s/state.json")
        runs = lambda target: (read_state(target, path) or {}).get("withoutBaselineRuns")
        rows = [(0, runs("a"))]
        for step, with_baseline in enumerate((False, False, True, False), 1):
            write_state("a", with_baseline, path)
            rows.append((step, runs("a") if runs("b") is None else -1))
    return spark.createDataFrame(rows, "step int, runs int")


@query("SELECT * FROM (VALUES (1, 'Tip: --baseline shows only new issues.'), (1, 'Tip: --output report.html writes a report to share.'), (2, 'Tip: --baseline shows only new issues.'), (2, 'Tip: --output report.html writes a report to share.'), (2, 'Tip: --baseline <file> makes a baseline.'), (3, 'Baseline created; later runs show what is new or worse.'), (3, 'Tip: --baseline shows only new issues.'), (3, 'Tip: --output report.html writes a report to share.')) v(run, said)")
def command_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line suggests in three runs over one repository, the last with a baseline."""
    import os
    import tempfile

    root, rows = _repository(spark, sf_dir), []
    base = scratch_path(spark, "baseline") + "/base.json"
    with tempfile.TemporaryDirectory() as folder:
        for run, more in enumerate(([], [], ["--baseline", base]), 1):
            out = io.StringIO()
            main(["scan", root, *more], out, os.path.join(folder, "state.json"))
            rows += [(run, line) for line in out.getvalue().split("\n") if line.startswith(("Tip:", "Baseline"))]
    return spark.createDataFrame(rows, "run int, said string")
