"""Registered queries: each operator over whole driver tables, read as findings, calls, prompts or files, and its SQL.

The driver tables hold no source code, so events are read as findings or calls, and small sources are written around
the names in nation. Both sides derive these relations by the same plain arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import callees as C
from ..functions import prompt_risk as P
from ..functions import scoring as S
from ..functions.catalog import RULE_IDS, RULE_ORDER
from ..operators import dependencies as D
from ..operators import directives as I
from ..operators import findings as A
from ..operators import rules as R
from ..operators import snippets as N
from ..sources import extract as X
from ..sources import manifests as M
from ..sources.repository import source_lines
from .scan import scan_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Events as findings, in SQL that both engines read alike.
FINDINGS = """
    SELECT 'r' AS repo, CASE event_type WHEN 'view' THEN 'AI001' WHEN 'signup' THEN 'AI002' WHEN 'purchase' THEN 'AI003' WHEN 'error' THEN 'AI004' ELSE 'LLM_ANTHROPIC_MESSAGES' END AS rule_id,
           concat('title of ', event_type) AS title, CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
           concat('src/Dir', CAST(user_id % 20 AS VARCHAR(20)), CASE event_id % 3 WHEN 0 THEN '/a.ts' WHEN 1 THEN '/A.TSX' ELSE '/a.py' END) AS file, CAST(event_id % 97 + 1 AS INT) AS line,
           concat('s', CAST(event_id % 2 AS VARCHAR(20))) AS summary, CASE WHEN event_id % 2 = 0 THEN '' ELSE concat('d', CAST(event_id % 3 AS VARCHAR(20))) END AS description, concat('fix ', CAST(event_id % 3 AS VARCHAR(20))) AS recommendation,
           CAST(event_id % 10 AS DOUBLE) / 10 AS confidence, 0 AS rule_ord, CAST(event_id % 11 AS INT) AS fn_pos, event_id AS call_pos, 0 AS node_ord, event_id AS ord
    FROM events"""

CALLS = """
    SELECT event_id AS call_pos, user_id AS fn_pos, CASE event_type WHEN 'view' THEN 'OpenAI.chat.completions.create' WHEN 'signup' THEN 'this.verifyAuth' WHEN 'purchase' THEN 'client.messages.create' WHEN 'error' THEN 'console.error' ELSE 'gemini.models.generateContent' END AS callee_text,
           CASE event_id % 5 WHEN 0 THEN 'user.email' WHEN 1 THEN '{ requestId }' WHEN 2 THEN 'JSON.stringify(x)' WHEN 3 THEN 'apiKey' ELSE 'session' END AS arg
    FROM events"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}").replace("VARCHAR(20)", "STRING"), events=_table(spark, sf_dir, "events"))


def findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, FINDINGS)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_F = f"WITH f AS ({FINDINGS}) "
_C = f"WITH c AS ({CALLS}) "
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_KEY = "regexp_replace(lower(replace(file, '\\', '/')), '\\.(ts|tsx|js|jsx)$', '')"

# --- prompt risk

_SLOT = "(user(input)?|input|message|prompt|query)"
_HITS = {
    "u": rf"\b(untrusted|raw)\s+user\s+input\b|\$\{{\s*{_SLOT}\s*\}}|\{{\{{\s*{_SLOT}\s*\}}\}}|\bappend user input\b",
    "o": r"\b(ignore|disregard) (any |all )?(above|previous|prior) instructions?\b|\bdeveloper mode\b|\bjailbreak\b|\bbypass (safety|guardrails?|restrictions?)\b",
    "d": r"\breveal (secrets?|keys?|passwords?)\b|\bexfiltrat(e|ion)\b|\bdisable (safety|policy|guardrails?)\b|\bno restrictions?\b|\bexecute (shell|command|script)\b",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _risk_sql(ids: str, text: str, table: str) -> str:
    q = lambda t, k: _quoted(t[k])
    R_, S_ = P.REASONS, P.SUGGESTIONS
    hits = ", ".join(f"regexp_matches(t, {_quoted(p)}, 'i') AS {k}" for k, p in _HITS.items())
    return f"""
        WITH a AS (SELECT {ids}, regexp_replace(coalesce({text}, ''), '^\\s+|\\s+$', '', 'g') AS t FROM {table}),
        b AS (SELECT *, {hits}, length(t) > {P.LONG} AS l, length(t) = 0 AS e FROM a),
        c AS (SELECT *, CASE WHEN e THEN 0 ELSE 2 * u::INT + 2 * o::INT + d::INT + l::INT END AS score FROM b),
        g AS (SELECT *, CASE WHEN score >= 4 THEN 'High' WHEN score >= 2 THEN 'Medium' ELSE 'Low' END AS level,
              concat_ws('; ', CASE WHEN u THEN {q(R_, 'user_input')} END, CASE WHEN o THEN {q(R_, 'override')} END, CASE WHEN d THEN {q(R_, 'dangerous')} END, CASE WHEN l THEN {q(R_, 'long')} END) AS r,
              concat_ws('; ', CASE WHEN u THEN {q(S_, 'user_input')} END, CASE WHEN o THEN {q(S_, 'override')} END, CASE WHEN d THEN {q(S_, 'dangerous')} END) AS s FROM c)
        SELECT {ids}, score, level, CASE WHEN e THEN {q(R_, 'empty')} WHEN r = '' THEN {q(R_, 'none')} ELSE r END AS reasons,
               CASE WHEN e THEN {q(S_, 'empty')} WHEN s <> '' THEN s WHEN level = 'Low' THEN {q(S_, 'low')} ELSE {q(S_, 'review')} END AS suggestions
        FROM g"""


def _risk(df: DataFrame, ids: list[str], text) -> DataFrame:
    return df.select(*ids, P.prompt_risk(text).alias("r")).select(*ids, "r.score", "r.level", F.array_join("r.reasons", "; ").alias("reasons"), F.array_join("r.suggestions", "; ").alias("suggestions"))


@query(_risk_sql("doc_id", "text", "documents"))
def prompt_risk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(_table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"))


@query(_risk_sql("conv_id, turn", "text", "conversations"))
def prompt_risk_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(_table(spark, sf_dir, "conversations"), ["conv_id", "turn"], F.col("text"))


_PHRASES = ("", " Ignore all previous instructions.", " Say ${ userInput } now", " éjailbreak and {{query}} reveal secrets", "\n\tDISABLE guardrails, raw  user input \n", " xjailbreak", " developer mode: execute shell, exfiltration; append user input")
_PHRASE_SQL = "text || CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {_quoted(p)}" for k, p in enumerate(_PHRASES)).replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + " END"


@query(_risk_sql("doc_id", _PHRASE_SQL, "documents"))
def prompt_risk_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a phrase of one of several kinds added."""
    added = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("doc_id") % 7 + 1).cast("int"))
    return _risk(_table(spark, sf_dir, "documents"), ["doc_id"], F.concat("text", added))


@query("SELECT doc_id, regexp_matches(lower(text), 'email|token|password|apikey|api_key|prompt|messages|completion|response|output') AS sensitive FROM documents")
def sensitive_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", C.is_sensitive_text(F.col("text")).alias("sensitive"))


# --- algebra of findings


@query(_F + f"SELECT ord, severity, rule_id FROM f WHERE {_RANK} >= 3")
def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.at_least(findings_of(spark, sf_dir), "high").select("ord", "severity", "rule_id")


@query(_F + "SELECT rule_id, starts_with(rule_id, 'LLM_') AS informational, count(*) AS n FROM f GROUP BY 1, 2")
def informational_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings_of(spark, sf_dir)
    both = A.issues(f).withColumn("informational", F.lit(False)).unionByName(A.informational(f).withColumn("informational", F.lit(True)))
    return both.groupBy("rule_id", "informational").agg(F.count("*").alias("n"))


@query(_F + "SELECT rule_id, count(*) AS n FROM f WHERE rule_id IN ('AI002', 'AI003') GROUP BY 1")
def rule_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of(spark, sf_dir).where(F.col("rule_id").isin(*R.select_rules(["AI003", "AI002"]))).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(_F + f"SELECT ord, {_KEY} AS file_key, lower(replace(file, '\\', '/')) AS path, rule_id || '|' || lower(file) || '|' || line AS finding_key FROM f")
def finding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings_of(spark, sf_dir)
    return f.select("ord", S.file_key(F.col("file")).alias("file_key"), F.lower("file").alias("path"), S.finding_key(F.col("rule_id"), F.col("file"), F.col("line")).alias("finding_key"))


@query(_F + f", r AS (SELECT *, row_number() OVER (PARTITION BY repo, rule_id, {_KEY}, line, summary ORDER BY rule_ord, file, fn_pos, call_pos, node_ord) AS k FROM f) SELECT rule_id, file, line, summary, confidence, call_pos FROM r WHERE k = 1")
def dedupe_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct_findings(findings_of(spark, sf_dir)).select("rule_id", "file", "line", "summary", "confidence", "call_pos")


_GROUPS = """, g AS (SELECT rule_id, min(confidence) AS confidence_min, max(confidence) AS confidence_max, arg_min(title, ord) AS title, arg_min(severity, ord) AS severity,
    arg_min(CASE WHEN description <> '' THEN description ELSE summary END, ord) AS reason, arg_min(recommendation, ord) AS recommendation, count(*) AS n_occurrences, min(ord) AS first_place FROM f GROUP BY 1)"""


@query(_F + _GROUPS + ", o AS (SELECT rule_id, md5(string_agg(file || ':' || line, ',' ORDER BY ord)) AS occurrences_md5 FROM f GROUP BY 1) SELECT g.* EXCLUDE (first_place), occurrences_md5, CASE WHEN confidence_min = confidence_max THEN printf('%.2f', confidence_min) ELSE printf('%.2f-%.2f', confidence_min, confidence_max) END AS confidence_range FROM g JOIN o USING (rule_id)")
def group_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.group_by_rule(findings_of(spark, sf_dir))
    told = F.md5(F.array_join(F.transform("occurrences", lambda o: F.concat(o["file"], F.lit(":"), o["line"].cast("string"))), ",").cast("binary"))
    return g.select("rule_id", "title", "severity", "confidence_min", "confidence_max", "reason", "recommendation", "n_occurrences", told.alias("occurrences_md5"), A.range_text(g).alias("confidence_range"))


@query(_F + "SELECT rule_id, string_agg(file || ':' || line, ',' ORDER BY ord) AS shown, max(n) - count(*) AS remaining FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ord) AS k, count(*) OVER (PARTITION BY rule_id) AS n FROM f) WHERE k <= 5 GROUP BY 1")
def occurrence_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.group_by_rule(findings_of(spark, sf_dir), preview=5)
    return g.select("rule_id", A.preview_of(F.col("occurrences"), F.col("n_occurrences"), 5).alias("p")).select("rule_id", F.array_join("p.shown", ",").alias("shown"), "p.remaining")


_COUNTS = "count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low"
_ISSUES = "FROM f WHERE NOT starts_with(rule_id, 'LLM_')"


@query(_F + f"SELECT file, {_COUNTS} {_ISSUES} GROUP BY 1")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.severity_summary(A.issues(findings_of(spark, sf_dir)), ("file",))


@query(_F + f", s AS (SELECT file, line, {_COUNTS} {_ISSUES} GROUP BY 1, 2) SELECT file, line, CASE WHEN critical + high > 0 THEN 'High' WHEN medium > 0 THEN 'Medium' ELSE 'Low' END AS posture, CASE WHEN critical + high > 0 THEN 'Block Release' WHEN medium > 0 THEN 'Proceed with Caution' ELSE 'Ready for Release' END AS decision, critical + high AS must_fix FROM s")
def posture_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_decision(A.severity_summary(A.issues(findings_of(spark, sf_dir)), ("file", "line"))).select("file", "line", "posture", "decision", "must_fix")


@query(_F + _GROUPS + f" SELECT rule_id, severity, confidence_max FROM g WHERE NOT starts_with(rule_id, 'LLM_') ORDER BY {_RANK} DESC, confidence_max DESC, first_place LIMIT 3")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_groups(A.group_by_rule(A.issues(findings_of(spark, sf_dir)), preview=0)).select("rule_id", "severity", "confidence_max")


@query(_F + _GROUPS + f", k AS (SELECT *, CASE WHEN rule_id = 'AI003' THEN 'Authentication & Access Control' WHEN rule_id IN ('AI002', 'AI004') THEN 'Data Handling & Privacy' WHEN rule_id = 'AI001' THEN 'Prompt & LLM Usage Risks' ELSE 'Other Security Risks' END AS category FROM g) SELECT category, string_agg(rule_id, ',' ORDER BY {_RANK} DESC, confidence_max DESC, first_place) AS rules, CASE category WHEN 'Authentication & Access Control' THEN 1 WHEN 'Data Handling & Privacy' THEN 2 WHEN 'Prompt & LLM Usage Risks' THEN 3 ELSE 4 END::BIGINT AS category_order FROM k GROUP BY category")
def risk_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.by_category(A.group_by_rule(findings_of(spark, sf_dir), preview=0))
    return c.select("category", F.array_join(F.transform("groups", lambda g: g["rule_id"]), ",").alias("rules"), "category_order")


@query(_F + f", s AS (SELECT {_COUNTS} {_ISSUES}), u AS (SELECT total, unnest([0, 1, 2, 3]) AS place, unnest(['critical', 'high', 'medium', 'low']) AS severity, unnest([critical, high, medium, low]) AS n FROM s), w AS (SELECT *, n * 100.0 / total AS share, sum(n * 100.0 / total) OVER (ORDER BY place) AS upto FROM u) SELECT place, severity, n, floor(n * (100.0 / total) + 0.5)::BIGINT AS percent, round(upto - share, 2)::DOUBLE AS from_percent, round(upto, 2)::DOUBLE AS to_percent FROM w")
def risk_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.risk_mix(A.severity_summary(A.issues(findings_of(spark, sf_dir))))


_BASE = """, k AS (SELECT rule_id || '|' || lower(file) || '|' || line AS key, *, ord % 2 = 0 AS old FROM f),
    b AS (SELECT key, arg_max(severity, ord) AS s0, arg_max(confidence, ord) AS c0 FROM k WHERE old GROUP BY 1), n AS (SELECT * FROM k WHERE NOT old)"""
_WORSE = f"(b.key IS NULL OR {_RANK} > {_RANK.replace('severity', 's0')} OR confidence > c0 + 1e-6)"


def _split_baseline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = findings_of(spark, sf_dir).withColumn("line", (F.col("line") - F.col("line") % 2).cast("int"))
    return f.where("ord % 2 = 1"), f.where("ord % 2 = 0")


_F2 = _F.replace("event_id % 97 + 1 AS INT", "event_id % 97 + 1 - (event_id % 97 + 1) % 2 AS INT")


@query(_F2 + _BASE + f" SELECT n.ord, rule_id, file, line, severity, confidence FROM n LEFT JOIN b USING (key) WHERE {_WORSE}".replace("b.key IS NULL", "c0 IS NULL"))
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events are the baseline, odd ones the current findings."""
    return A.baseline_diff(*_split_baseline(spark, sf_dir)).select("ord", "rule_id", "file", "line", "severity", "confidence")


@query(_F2 + _BASE + f", w AS (SELECT count(*) AS n FROM n LEFT JOIN b USING (key) WHERE {_WORSE}), c AS (SELECT count(*) FILTER (old) AS o, count(*) FILTER (NOT old) AS c FROM k) SELECT o AS baseline_count, c AS current_count, n AS new_or_regressed_count, greatest(0, c - n) AS unchanged_count FROM w, c".replace("b.key IS NULL", "c0 IS NULL"))
def baseline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.baseline_counts(*_split_baseline(spark, sf_dir))


_FIFO = f"""
    WITH d AS (SELECT {_KEY.replace('file', "concat('src/Dir', CAST(user_id % 20 AS VARCHAR), '/a.ts')")} AS file_key, event_type AS rule_id, (event_id % 997 + 1)::INT AS line, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS is_directive, event_id AS ord FROM events),
    e AS (SELECT *, row_number() OVER w AS k, sum(is_directive * 2 - 1) OVER w AS s, sum(1 - is_directive) OVER w AS nf, sum(is_directive) OVER w AS nd FROM d WINDOW w AS (PARTITION BY file_key, rule_id ORDER BY line, is_directive, ord)),
    m AS (SELECT *, least(0, min(s) OVER (PARTITION BY file_key, rule_id ORDER BY k)) AS m FROM e),
    g AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY file_key, rule_id ORDER BY k), 0) AS m0 FROM m)
    SELECT a.ord, a.line, t.line AS directive_line FROM g a LEFT JOIN g t ON t.is_directive = 1 AND t.file_key = a.file_key AND t.rule_id = a.rule_id AND a.m = a.m0 AND t.nd = a.nf + a.m WHERE a.is_directive = 0"""


@query(_FIFO)
def ignore_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events are directives, the others findings."""
    e = _table(spark, sf_dir, "events")
    file = S.file_key(F.concat(F.lit("src/Dir"), (F.col("user_id") % 20).cast("string"), F.lit("/a.ts")))
    told = e.select(file.alias("file_key"), F.col("event_type").alias("rule_id"), (F.col("event_id") % 997 + 1).cast("int").alias("line"), (F.col("event_id") % 3 == 0).alias("d"), F.col("event_id").alias("ord"))
    return I.match_first_in_first_out(told.where(~F.col("d")), told.where("d"), ["file_key", "rule_id"]).select("ord", "line", "directive_line")


# --- rules on calls

_LLM = "regexp_matches(lower(callee_text), 'anthropic|gemini|genai|google|openai')"


@query(_C + f", t AS (SELECT *, {_LLM} AS is_llm, contains(lower(callee_text), 'auth') AS is_auth FROM c), w AS (SELECT *, coalesce(max(is_auth::INT) OVER (PARTITION BY fn_pos ORDER BY call_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM t) SELECT fn_pos, call_pos FROM w WHERE NOT is_auth AND is_llm AND seen = 0")
def llm_before_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a handler, its events the calls."""
    c = _view(spark, sf_dir, CALLS).select("fn_pos", "call_pos", C.is_llm_call(F.col("callee_text")).alias("is_llm"), C.is_auth_call(F.col("callee_text")).alias("is_auth"))
    return R.before_auth(c, ["fn_pos"], "call_pos").select("fn_pos", "call_pos")


@query(_C + ", p(rule_id, what) AS (VALUES ('LLM_OPENAI_CHAT_COMPLETIONS_CREATE', 'openai.chat.completions.create'), ('LLM_OPENAI_CHATCOMPLETION_CREATE', 'openai.chatcompletion.create'), ('LLM_ANTHROPIC_MESSAGES', '.messages.create'), ('LLM_GEMINI_GENERATECONTENT', 'generatecontent')) SELECT call_pos, rule_id, 0.2::DOUBLE AS confidence FROM c JOIN p ON contains(lower(callee_text), what)")
def usage_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _view(spark, sf_dir, CALLS).selectExpr("'r' AS repo", "'f' AS file", "call_pos", "1 AS start_line", "callee_text")
    return R.usage(c).select(F.col("call_pos").cast("long").alias("call_pos"), "rule_id", "confidence")


_ARGS = "array(struct(0 AS idx, 'other' AS kind, arg AS text, 1 AS line))"


@query(_C + "SELECT call_pos, 0.3::DOUBLE AS confidence FROM c WHERE regexp_matches(lower(callee_text), 'console\\.(log|info|warn|error)|logger\\.(log|info|warn|error|debug)') AND regexp_matches(lower(arg), 'email|token|password|apikey|api_key|prompt|messages|completion|response|output')")
def sensitive_logging(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _view(spark, sf_dir, CALLS).select(F.lit("r").alias("repo"), F.lit("f").alias("file"), "call_pos", F.lit(1).alias("start_line"), "callee_text", F.expr(_ARGS).alias("args"))
    return R.sensitive_logging(c).select(F.col("call_pos").cast("long").alias("call_pos"), "confidence")


@query(_C + f", n AS (SELECT *, list_has_any(regexp_extract_all(lower(arg), '[a-z]+'), ['user', 'profile', 'metadata', 'session', 'request', 'payload']) AS named, contains(arg, 'JSON.stringify') AS js FROM c WHERE {_LLM}) SELECT call_pos, CASE WHEN named THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM n WHERE named OR js")
def sensitive_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _view(spark, sf_dir, CALLS).select(F.lit("r").alias("repo"), F.lit("f").alias("file"), "call_pos", F.lit("AI004").alias("detector"), F.lit(0).alias("node_ord"), F.lit(1).alias("node_line"), "callee_text", F.regexp_extract_all("arg", F.lit("[A-Za-z]+"), 0).alias("identifiers"), F.col("arg").contains("JSON.stringify").alias("has_json_stringify"))
    return R.sensitive_data(c).select(F.col("call_pos").cast("long").alias("call_pos"), "confidence")


@query("SELECT event_id, least(1.0, round(((event_id % 2) * 3 + (event_id // 2 % 2) * 3 + (event_id // 4 % 2) * 2 + (event_id // 8 % 2) * 2) / 10.0, 2))::DOUBLE AS confidence, CASE WHEN confidence >= 0.75 THEN 'High' WHEN confidence >= 0.5 THEN 'Medium' ELSE 'Low' END AS label FROM events")
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda n: F.expr(f"event_id div {n} % 2 = 1")
    return _table(spark, sf_dir, "events").select("event_id", S.confidence(bit(1), bit(2), bit(4), bit(8)).alias("confidence")).withColumn("label", S.confidence_label(F.col("confidence")))


# --- files, manifests, snippets

_WORDS = "lower(split_part(p_name, ' ', 1))"
_NAMES = "CASE p_partkey % 6 WHEN 0 THEN 'opena1' WHEN 1 THEN 'requets' WHEN 2 THEN 'Numpy' WHEN 3 THEN 'torchh' WHEN 4 THEN 'bad name' ELSE concat('pkg-', CAST(p_partkey AS VARCHAR(20))) END"


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT 'r' AS repo, 'npm' AS ecosystem, {_NAMES.replace('VARCHAR(20)', 'STRING')} AS name, 'package.json' AS file, 1 AS line, CAST(p_partkey AS INT) AS ord FROM {{part}}", part=_table(spark, sf_dir, "part"))


_TRUSTED = ", ".join(f"('{t}', {k})" for k, t in enumerate(D.TRUSTED))


@query(f"WITH c AS (SELECT p_partkey::INT AS ord, {_NAMES} AS name FROM part), t(trusted, k) AS (VALUES {_TRUSTED}) SELECT ord, name, arg_min(trusted, k) AS resembles FROM c JOIN t ON levenshtein(lower(name), trusted) = 1 WHERE lower(name) NOT IN (SELECT trusted FROM t) GROUP BY 1, 2")
def typosquat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packages(spark, sf_dir).withColumn("resembles", D.look_alike(F.col("name"))).where("resembles IS NOT NULL").select("ord", "name", "resembles")


@query(f"WITH c AS (SELECT p_partkey::INT AS ord, {_NAMES} AS name FROM part), r AS (SELECT DISTINCT name FROM c WHERE ord % 5 <> 0) SELECT ord, name FROM c WHERE NOT regexp_full_match(name, '(@[A-Za-z0-9_.-]+/)?[A-Za-z0-9_.@-]{{1,214}}') OR name NOT IN (SELECT name FROM r)")
def missing_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _packages(spark, sf_dir)
    return D.missing_packages(c, c.where("ord % 5 <> 0").select("ecosystem", "name")).select("ord", "name")


@query("WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS l, unnest(range(len(string_split_regex(text, '\\r?\\n')))) + 1 AS line FROM documents), t AS (SELECT doc_id, line, trim(l, ' ' || chr(9) || chr(13)) AS t FROM l) SELECT doc_id, line::INT AS line, regexp_extract(t, '^[A-Za-z0-9_.-]+') AS name FROM t WHERE t <> '' AND NOT starts_with(t, '#') AND NOT starts_with(t, '-') AND NOT contains(t, '://') AND regexp_matches(t, '^[A-Za-z0-9_.-]+')")
def requirements_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read as a requirements.txt."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\r?\n", -1)).alias("n", "l"))
    return lines.select("doc_id", (F.col("n") + 1).alias("line"), M.requirement_name(F.col("l")).alias("name")).where("name IS NOT NULL")


@query("SELECT 'nation-' || n_nationkey AS repo, 'npm' AS ecosystem, name, 'package.json' AS file, line FROM nation, (VALUES ('a-', 3), ('b-', 4), ('dev-', 7)) v(stem, l), LATERAL (SELECT stem || lower(replace(n_name, ' ', '')) AS name, l::INT AS line)")
def npm_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("")))
    text = F.format_string('{\n "dependencies": {\n  "a-%1$s": "1",\n  "b-%1$s": "^2" },\n "peerDependencies": null,\n "devDependencies": {\n  "dev-%1$s": "*", "A-%1$s": "2" } }', key)
    files = _table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("repo"), F.lit("package.json").alias("file"), text.alias("text"))
    return M.package_candidates(files).select("repo", "ecosystem", "name", "file", "line")


@query("SELECT doc_id, unnest(range(len(string_split_regex(text, '\\r?\\n')))) + 1 AS line, md5(unnest(string_split_regex(text, '\\r?\\n'))) AS text_md5 FROM documents")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "documents").select(F.lit("r").alias("repo"), F.col("doc_id").alias("file"), "text")
    return source_lines(files).select(F.col("file").alias("doc_id"), F.col("line").cast("long").alias("line"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("WITH l AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls, (doc_id % 6 + 1)::INT AS line FROM documents), x AS (SELECT *, greatest(1, line - 2) AS a, least(len(ls), line + 2) AS b FROM l WHERE line <= len(ls)) SELECT doc_id, line, md5('```ts' || chr(10) || list_aggregate(list_transform(range(a, b + 1), lambda i: CASE WHEN i = line THEN '>>' ELSE '  ' END || ' ' || lpad(i::VARCHAR, 4, ' ') || ' | ' || ls[i]), 'string_agg', chr(10)) || chr(10) || '```') AS snippet_md5 FROM x")
def snippet_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snippet of every document around one of its lines."""
    d = _table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 6 + 1).cast("int").alias("line"), F.split("text", r"\r?\n", -1).alias("ls"))
    s = d.select("doc_id", "line", N.snippet_of(F.col("ls"), F.col("line")).alias("s")).where("s IS NOT NULL")
    return s.select("doc_id", "line", F.md5(N.markdown_snippet(F.col("s")).cast("binary")).alias("snippet_md5"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(S.html_escape(F.col("html")).cast("binary")).alias("escaped_md5"))


# --- sources, end to end

_SOURCE = """import { client } from "./client";
// sparkward-ignore AI004: reviewed for %1$s
export async function %1$s(req, res) {
  const body = req.body;
  const copy = body;
  console.log("%1$s", { prompt: copy });
  const answer = await openai.chat.completions.create({ prompt: `Hello ${copy}` + "!" });
  await requireAuth(req);
  return anthropic.messages.create({ messages: [{ content: JSON.stringify(user), role: "user" }] });
}
"""


def _nation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.regexp_replace("n_name", "[^A-Za-z0-9]", ""))
    return _table(spark, sf_dir, "nation").select(F.lit("r").alias("repo"), F.concat(F.lit("src/"), name, F.lit(".ts")).alias("file"), F.format_string(_SOURCE, name).alias("text"))


_EXPECTED = "(VALUES ('AI001', 7, 0.7, 'high'), ('AI002', 6, 0.3, 'high'), ('AI003', 7, 0.4, 'critical'), ('LLM_ANTHROPIC_MESSAGES', 9, 0.2, 'low'), ('LLM_OPENAI_CHAT_COMPLETIONS_CREATE', 7, 0.2, 'low'))"
_NATION_FILE = "'src/' || lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) || '.ts'"


@query(f"SELECT {_NATION_FILE} AS file, rule_id, line::INT AS line, c::DOUBLE AS confidence, severity FROM nation, {_EXPECTED} v(rule_id, line, c, severity)")
def scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per nation through extraction, all rules, distinct and directives."""
    return scan_files(_nation_files(spark, sf_dir)).findings.select("file", "rule_id", "line", F.col("confidence").cast("double").alias("confidence"), "severity")


@query(f"SELECT {_NATION_FILE} AS file, 'AI004' AS rule_id, 9 AS line, 2 AS annotation_line, 'reviewed for ' || lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS reason FROM nation")
def scan_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_files(_nation_files(spark, sf_dir)).ignored.select("finding.file", "finding.rule_id", "finding.line", "annotation_line", "reason")


@query(f"SELECT {_NATION_FILE} AS file, name, param, request FROM nation, (VALUES ('req', true, false), ('res', true, false), ('body', false, true), ('copy', false, true)) v(name, param, request)")
def taint_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = X.extract(_nation_files(spark, sf_dir))
    return R.tainted(X.functions(facts), X.decls(facts)).select("file", F.inline("names"))


@query("SELECT id, place FROM (VALUES " + ", ".join(f"('{r}', {RULE_ORDER[r]})" for r in RULE_IDS) + ") v(id, place)")
def rule_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(r, RULE_ORDER[r]) for r in RULE_IDS], "id string, place int")
