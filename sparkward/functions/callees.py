"""Predicates on callee texts and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LLM_WORDS = ("anthropic", "gemini", "genai", "google", "openai")
LOGGERS = r"console\.(log|info|warn|error)|logger\.(log|info|warn|error|debug)"
SENSITIVE_NAMES = "email|token|password|apikey|api_key|prompt|messages|completion|response|output"
SENSITIVE_OBJECTS = ("metadata", "payload", "profile", "request", "session", "user")
REQUEST_PARAMS = ("req", "request", "ctx")
#: rule id, title, what the lower-cased callee contains.
USAGE_PATTERNS = (
    ("LLM_OPENAI_CHAT_COMPLETIONS_CREATE", "OpenAI chat.completions.create usage", "openai.chat.completions.create"),
    ("LLM_OPENAI_CHATCOMPLETION_CREATE", "OpenAI ChatCompletion.create usage", "openai.chatcompletion.create"),
    ("LLM_ANTHROPIC_MESSAGES", "Anthropic messages client usage", ".messages.create"),
    ("LLM_GEMINI_GENERATECONTENT", "Gemini generateContent usage", "generatecontent"),
)


def is_llm_call(callee: Column) -> Column:
    return F.lower(callee).rlike("|".join(LLM_WORDS))


def is_auth_call(callee: Column) -> Column:
    return F.lower(callee).contains("auth")


def is_logger_call(callee: Column) -> Column:
    return F.lower(callee).rlike(LOGGERS)


def is_sensitive_text(text: Column) -> Column:
    return F.lower(text).rlike(SENSITIVE_NAMES)


def names_sensitive_object(identifiers: Column) -> Column:
    return F.arrays_overlap(F.transform(identifiers, F.lower), F.array(*[F.lit(x) for x in SENSITIVE_OBJECTS]))


def is_request_handler(params: Column) -> Column:
    return F.exists(params, lambda p: F.lower(p["text"]).isin(*REQUEST_PARAMS))
