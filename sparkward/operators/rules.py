"""Detection rules. Each takes facts and gives findings: repo, file, rule_id, line, confidence and their place in order.

Containment of calls and declarations in functions is an equi-join: each has the list of the functions around it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import callees as C
from ..functions.catalog import RULE_IDS, RULE_ORDER
from ..functions.scoring import confidence
from ..sources import extract as X

#: summary, description, recommendation of each rule's findings.
TEXTS = {
    "AI001": ("A prompt is put together with what users send.", "Text from outside becomes part of the prompt without being set apart.", "Keep roles apart and encode what users send."),
    "AI002": ("Prompt or response data is logged.", "Prompt content or model answers are logged, perhaps with sensitive fields.", "Don't log prompts or answers, or mask fields such as email, token or password."),
    "AI003": ("LLM call occurs before auth checks.", "A request handler calls an LLM before authentication checks.", "Run authentication and authorization before any LLM call of a handler."),
    "AI004": ("Large user context sent directly to LLM.", "User, profile or session data goes to an LLM without being cut down.", "Send only the attributes that are needed; mask or drop sensitive ones."),
    "AI100": ("LLM SDK usage detected.", "LLM SDK usage detected.", "Check that prompts, inputs and outputs of this call are handled securely."),
}
PLACE = ["rule_ord", "file", "fn_pos", "call_pos", "node_ord"]
COLUMNS = ["repo", "rule_id", "title", "severity", "file", "line", "summary", "description", "recommendation", "confidence", "rule_ord", "fn_pos", "call_pos", "node_ord"]


def _findings(rows: DataFrame, rule: str, title: str | Column, severity: str, line: str, score: Column, rule_id: Column | None = None, fn_pos: Column | None = None, node_ord: Column | None = None) -> DataFrame:
    summary, description, recommendation = map(F.lit, TEXTS[rule])
    return rows.select(
        "repo", (rule_id if rule_id is not None else F.lit(rule)).alias("rule_id"), (F.lit(title) if isinstance(title, str) else title).alias("title"), F.lit(severity).alias("severity"),
        "file", F.col(line).cast("int").alias("line"), summary.alias("summary"), description.alias("description"), recommendation.alias("recommendation"), score.alias("confidence"),
        F.lit(RULE_ORDER[rule]).alias("rule_ord"), (fn_pos if fn_pos is not None else F.lit(0)).cast("int").alias("fn_pos"), F.col("call_pos").cast("int").alias("call_pos"), (node_ord if node_ord is not None else F.lit(0)).cast("int").alias("node_ord"),
    )


def tainted(functions: DataFrame, decls: DataFrame) -> DataFrame:
    """repo, file, fn_pos, names (array of struct(name, param, request)): what user input reaches by name in a function.

    One ordered pass over the declarations inside, a fold: parameters are tainted; a declaration whose value is a tainted
    name takes over its marks; one whose value is a property of the request is marked as such. Nothing is ever cleared.
    """
    mark = lambda name, param, request: F.struct(name.alias("name"), param.alias("param"), request.alias("request"))
    inside = decls.where("init_kind IS NOT NULL").select("repo", "file", F.explode("fn_path").alias("fn_pos"), F.struct("decl_pos", "name_text", "init_kind", "init_text", "init_is_req_access").alias("d"))
    listed = inside.groupBy("repo", "file", "fn_pos").agg(F.array_sort(F.collect_list("d")).alias("ds"))  # of one function
    start = F.transform(F.filter("params", lambda p: p["is_identifier"]), lambda p: mark(p["text"], F.lit(True), F.lit(False)))

    def step(names: Column, d: Column) -> Column:
        found = F.filter(names, lambda x: x["name"] == d["init_text"])
        copied = mark(d["name_text"], F.exists(found, lambda x: x["param"]), F.exists(found, lambda x: x["request"]))
        asked = mark(d["name_text"], F.lit(False), F.lit(True))
        return F.when((d["init_kind"] == "identifier") & (F.size(found) > 0), F.array_append(names, copied)).when(d["init_is_req_access"], F.array_append(names, asked)).otherwise(names)

    empty = F.array().cast("array<struct<decl_pos:int,name_text:string,init_kind:string,init_text:string,init_is_req_access:boolean>>")
    joined = functions.join(listed, ["repo", "file", "fn_pos"], "left")
    return joined.select("repo", "file", "fn_pos", F.aggregate(F.coalesce("ds", empty), start, step).alias("names")).where(F.size("names") > 0)


def prompt_injection(functions: DataFrame, decls: DataFrame, nodes: DataFrame) -> DataFrame:
    """AI001: a prompt built by + or a template names something that user input reaches."""
    built = nodes.where("detector = 'AI001' AND node_kind IN ('concat', 'template')").where(C.is_llm_call(F.col("callee_text")))
    inside = built.withColumn("fn_pos", F.explode("fn_path")).join(tainted(functions, decls), ["repo", "file", "fn_pos"])
    hit = F.filter("names", lambda x: F.array_contains("identifiers", x["name"]))
    rows = inside.withColumn("hit", hit).where(F.size("hit") > 0)
    score = confidence(F.exists("hit", lambda x: x["param"]), F.lit(True), F.exists("hit", lambda x: x["request"]), F.lit(True))
    return _findings(rows, "AI001", "Prompt injection via user input", "high", "node_line", score, fn_pos=F.col("fn_pos"), node_ord=F.col("node_ord"))


def sensitive_logging(calls: DataFrame) -> DataFrame:
    """AI002: an argument of a logging call mentions something sensitive."""
    rows = calls.where(C.is_logger_call(F.col("callee_text")) & F.exists("args", lambda a: C.is_sensitive_text(a["text"])))
    return _findings(rows, "AI002", "Sensitive prompt logging", "high", "start_line", confidence(F.lit(True), F.lit(False), F.lit(False), F.lit(False)))


def before_auth(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of rows with is_auth and is_llm: the LLM calls (which aren't auth calls) without an auth call before them."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("is_auth")).over(before), F.lit(False))
    return rows.withColumn("auth_seen", seen).where(~F.col("is_auth") & F.col("is_llm") & ~F.col("auth_seen"))


def llm_before_auth(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """AI003: in a request handler, in order of calls, a model is called before anything that looks like an auth check."""
    handlers = functions.where(C.is_request_handler(F.col("params"))).select("repo", "file", "fn_pos")
    told = calls.select("repo", "file", F.explode("fn_path").alias("fn_pos"), "call_pos", "start_line", C.is_auth_call(F.col("callee_text")).alias("is_auth"), C.is_llm_call(F.col("callee_text")).alias("is_llm"))
    rows = before_auth(told.where("is_auth OR is_llm").join(handlers, ["repo", "file", "fn_pos"]), ["repo", "file", "fn_pos"], "call_pos")
    return _findings(rows, "AI003", "LLM call before authentication", "critical", "start_line", confidence(F.lit(False), F.lit(False), F.lit(True), F.lit(True)), fn_pos=F.col("fn_pos"))


def sensitive_data(nodes: DataFrame) -> DataFrame:
    """AI004: a part of a prompt names a user object or is made by JSON.stringify."""
    rows = nodes.where("detector = 'AI004'").where(C.is_llm_call(F.col("callee_text"))).withColumn("named", C.names_sensitive_object(F.col("identifiers"))).where(F.col("named") | F.col("has_json_stringify"))
    return _findings(rows, "AI004", "Sensitive data sent to LLM", "high", "node_line", confidence(F.lit(True), F.lit(False), F.col("named"), F.lit(True)), node_ord=F.col("node_ord"))


def usage(calls: DataFrame) -> DataFrame:
    """AI100: one finding for each SDK pattern that a callee has."""
    low = F.lower("callee_text")
    hits = F.array_compact(F.array(*[F.when(low.contains(what), F.struct(F.lit(rule).alias("id"), F.lit(title).alias("title"), F.lit(k).alias("k"))) for k, (rule, title, what) in enumerate(C.USAGE_PATTERNS)]))
    rows = calls.select("repo", "file", "start_line", "call_pos", F.explode(hits).alias("p"))
    return _findings(rows, "AI100", F.col("p.title"), "low", "start_line", confidence(F.lit(False), F.lit(False), F.lit(False), F.lit(True)), rule_id=F.col("p.id"), node_ord=F.col("p.k"))


def select_rules(selected: list[str] | None = None, only_ai: bool = False) -> list[str]:
    """Registry order; none selected means all. only_ai can't go with a rule that isn't one of AI's."""
    if only_ai:
        other = [r for r in selected or [] if not r.startswith("AI")]
        if other:
            raise ValueError(f"--only-ai can't go with {', '.join(other)}")
        selected = selected or [r for r in RULE_IDS if r.startswith("AI")]
    return [r for r in RULE_IDS if not selected or r in selected]


def run_rules(facts: DataFrame, selected: list[str] | None = None, extra: dict | None = None) -> DataFrame:
    """Union of the findings of the selected rules; extra: further rules by id, facts -> findings with COLUMNS."""
    calls, functions, decls, nodes = X.calls(facts), X.functions(facts), X.decls(facts), X.call_prompt_nodes(facts)
    rules = {
        "AI001": lambda: prompt_injection(functions, decls, nodes), "AI100": lambda: usage(calls), "AI002": lambda: sensitive_logging(calls),
        "AI003": lambda: llm_before_auth(functions, calls), "AI004": lambda: sensitive_data(nodes),
    }
    parts = [rules[r]() for r in select_rules(selected)] + [f(facts).select(*COLUMNS) for f in (extra or {}).values()]
    return reduce(DataFrame.unionByName, parts)
