"""What is told of each rule: one small dimension table, with defaults for rules that it doesn't have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Registry order decides ties.
RULES = (
    ("AI001", "Prompt injection via user input", "high"),
    ("AI100", "LLM SDK usage detection", "low"),
    ("AI002", "Sensitive prompt logging", "high"),
    ("AI003", "LLM call before authentication", "critical"),
    ("AI004", "Sensitive data sent to LLM", "high"),
)
RULE_IDS = tuple(r for r, _, _ in RULES)
RULE_ORDER = {r: k for k, r in enumerate(RULE_IDS)}

AUTH, DATA = "Authentication & Access Control", "Data Handling & Privacy"
PROMPT, OTHER = "Prompt & LLM Usage Risks", "Other Security Risks"
CATEGORIES = (AUTH, DATA, PROMPT, OTHER)  # the order of reports

FIELDS = ("summary", "why_risky", "how_exploited", "how_to_fix", "code_example", "category", "impact", "short_fix", "trigger", "exposure", "effect", "mitigation", "flagged")

CATALOG: dict[str, dict] = {
    "AI001": {
        "summary": "What a user types becomes part of the prompt.",
        "why_risky": "Text from outside can change instructions or carry hostile content into the prompt.",
        "how_exploited": "Crafted input makes the model drop its constraints or give data away.",
        "how_to_fix": "Keep roles apart, encode what users send, and validate it against an allowlist.",
        "code_example": "// risky\nconst text = `Translate: ${req.body.text}`;\n// safer: the input is data in a message of its own\nconst messages = [system('Translate what the user sends.'), user(String(req.body.text))];",
        "category": CATEGORIES[2],
        "impact": "Outside input can override system instructions.",
        "short_fix": "Keep untrusted input apart from instructions.",
        "trigger": "Untrusted text is joined into a prompt.",
        "exposure": "The limits of the system instruction can be crossed.",
        "effect": "The model can be steered outside of policy.",
        "mitigation": "Hold user input in data fields and clean it first.",
        "flagged": ["Prompt and user input are mixed.", "The prompt is put together at run time.", "No control on the input is visible here."],
    },
    "AI002": {
        "summary": "Prompts or answers are written to logs.",
        "why_risky": "Logs are shared widely, and with them credentials or user data.",
        "how_exploited": "Whoever can read logs finds tokens, passwords or private data there.",
        "how_to_fix": "Keep prompts and answers out of logs, or mask sensitive fields first.",
        "code_example": "// risky\nlogger.info({ prompt, email });\n// safer\nlogger.info({ requestId });",
        "category": CATEGORIES[1],
        "impact": "Prompt or answer data can leak through logs.",
        "short_fix": "Stop logging prompts and answers; mask fields.",
        "trigger": "A prompt or an answer is logged.",
        "exposure": "Secrets and personal data end up in log stores.",
        "effect": "The wrong roles can keep or read sensitive data.",
        "mitigation": "Remove such logging or filter strictly.",
        "flagged": ["A logging call gets prompt or model output.", "What is logged can hold sensitive content.", "No masking shows near the call."],
    },
    "AI003": {
        "summary": "A model is called before the caller is known.",
        "why_risky": "Anyone can then cause model calls, which exposes data and invites abuse.",
        "how_exploited": "A request without credentials reaches the endpoint and starts model work.",
        "how_to_fix": "Authenticate and authorize first, call the model afterwards.",
        "code_example": "// risky\napp.post('/ask', async (request) => { await openai.chat.completions.create(body); });\n// safer\napp.post('/ask', async (request) => { await requireAuth(request); await openai.chat.completions.create(body); });",
        "category": CATEGORIES[0],
        "impact": "Callers without a login can cause model actions.",
        "short_fix": "Authenticate and authorize before any model call.",
        "trigger": "A model call runs before authentication is done.",
        "exposure": "Unauthorized callers reach model behaviour.",
        "effect": "Protected work can start without a valid identity.",
        "mitigation": "Put an auth check at the start of the handler.",
        "flagged": ["A request handler calls a model.", "No auth check comes before the call.", "The call could run for unknown callers."],
    },
    "AI004": {
        "summary": "Whole user objects are sent to a model.",
        "why_risky": "User, session or profile objects can hold personal data that should stay inside.",
        "how_exploited": "The model is asked to bring up sensitive fields that came with the context.",
        "how_to_fix": "Send only the fields that are needed; mask the rest.",
        "code_example": "// risky\nawait openai.chat.completions.create({ prompt: JSON.stringify(user) });\n// safer\nawait openai.chat.completions.create({ prompt: JSON.stringify({ plan: user.plan }) });",
        "category": CATEGORIES[1],
        "impact": "User or session data can reach third-party models.",
        "short_fix": "Cut down and mask user fields before model calls.",
        "trigger": "Objects with much context go straight to a model.",
        "exposure": "User or session attributes leave the system.",
        "effect": "Sensitive fields may breach privacy rules.",
        "mitigation": "Send an explicit list of allowed fields.",
        "flagged": ["An object with much context goes to the model.", "It probably holds user or session attributes.", "No cutting down shows at the call."],
    },
}
DEFAULT: dict = {
    "summary": None,
    "why_risky": "Untrusted data can make this pattern a security risk.",
    "how_exploited": "Inputs or control flow can be manipulated to gain access.",
    "how_to_fix": "Review the data flow, validate inputs and grant least privilege.",
    "code_example": "// authenticate, validate, and send less data",
    "category": CATEGORIES[3],
    "impact": "A security risk may show in production.",
    "short_fix": None,
    "trigger": "A rule's pattern matched this code.",
    "exposure": "A security boundary could be passed at run time.",
    "effect": "The model or its data may be misused.",
    "mitigation": "Grant least privilege, validate and send less.",
    "flagged": ["A static pattern matched here.", "No validation or containment was seen."],
}

_SCHEMA = "rule_id string, " + ", ".join(f"{f} {'array<string>' if f == 'flagged' else 'string'}" for f in FIELDS)


def rule_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(rule, *(told[f] for f in FIELDS)) for rule, told in CATALOG.items()], _SCHEMA)


def with_catalog(df: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """df (with rule_id) and what is told of its rules, under told_*; overrides replaces the catalog (same schema)."""
    told = (overrides if overrides is not None else rule_catalog(df.sparkSession)).withColumnsRenamed({f: f"told_{f}" for f in FIELDS})
    joined = df.join(F.broadcast(told) if overrides is None else told, "rule_id", "left")
    default = lambda f: F.array(*map(F.lit, DEFAULT[f])) if f == "flagged" else F.lit(DEFAULT[f])
    return joined.withColumns({f"told_{f}": F.coalesce(f"told_{f}", default(f)) for f in FIELDS})


def explain(rule_id: str, provider=None) -> dict:
    """What is told of one rule; provider (rule_id -> dict) takes the catalog's place."""
    rule_id = rule_id.strip().upper()
    if rule_id not in RULE_IDS:
        raise ValueError(f"unknown rule {rule_id!r}; there are {', '.join(RULE_IDS)}")
    if provider is not None:
        return provider(rule_id)
    told = dict(CATALOG.get(rule_id, DEFAULT))
    told["summary"] = told["summary"] or rule_id
    return told
