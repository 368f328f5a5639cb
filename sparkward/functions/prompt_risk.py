"""Prompt risk: what a prompt's text gives away, as score, level, reasons and suggestions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLOT = "(user(input)?|input|message|prompt|query)"
#: Patterns of each class; ~ stands for a word boundary as ASCII has it.
USER_INPUT = (rf"\$\{{\s*{_SLOT}\s*\}}", rf"\{{\{{\s*{_SLOT}\s*\}}\}}", r"~(raw|untrusted)\s+user\s+input~", "~append user input~")
OVERRIDE = ("~(ignore|disregard) (any |all )?(above|previous|prior) instructions?~", "~developer mode~", "~jailbreak~", "~bypass (safety|guardrails?|restrictions?)~")
DANGEROUS = ("~reveal (secrets?|keys?|passwords?)~", "~exfiltrat(e|ion)~", "~disable (safety|policy|guardrails?)~", "~no restrictions?~", "~execute (shell|command|script)~")
#: In lower case, each match of a class holds one of these: what has none of them needs no pattern.
GATES = {USER_INPUT: ("{", "user"), OVERRIDE: ("instruction", "developer mode", "jailbreak", "bypass "), DANGEROUS: ("reveal ", "exfiltrat", "disable ", "no restriction", "execute ")}
LONG = 600

REASONS = {
    "user_input": "User-controlled input seems to enter the prompt unescaped.",
    "override": "The prompt holds instruction-override wording (ignore or bypass).",
    "dangerous": "The prompt holds system-level keywords that may be dangerous.",
    "long": "A very long prompt is harder to review and can hide risk.",
    "empty": "Prompt text is empty.",
    "none": "No high-risk pattern was found.",
}
SUGGESTIONS = {
    "user_input": "Delimit or encode user input before it enters a prompt.",
    "override": "Take out ignore or bypass wording and keep role boundaries strict.",
    "dangerous": "Don't ask for secrets, policy bypass or shell execution.",
    "low": "Keep prompts explicit and short, with roles apart.",
    "empty": "Give the exact prompt text to evaluate.",
    "review": "Have the prompt template reviewed for security.",
}

_JS_SPACE = r"[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACES = " \t\n\x0b\f\r\u00a0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def trimmed(text: Column) -> Column:
    """Without white space at either end, in the wide sense."""
    return F.btrim(text, F.lit(_SPACES))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it: as a lambda's variable no projection copies it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Case-insensitive. Java's \\b takes accented letters for word characters, so the boundary is spelt out."""
    joined = "|".join(patterns)
    at_start = joined.replace("|~", "|(?<![A-Za-z0-9_])")
    if at_start.startswith("~"):
        at_start = "(?<![A-Za-z0-9_])" + at_start[1:]
    return text.rlike("(?i)" + at_start.replace("~", "(?![A-Za-z0-9_])").replace(r"\s", _JS_SPACE))


def _has(t: Column, low: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(or_, (low.contains(x) for x in GATES[patterns])) & _any(t, patterns)


def prompt_risk(text: Column) -> Column:
    """struct(score, level, reasons, suggestions). A null text counts as empty. The text is trimmed and searched once."""
    both = once(trimmed(F.coalesce(text, F.lit(""))), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low")))
    flags = once(both, lambda x: F.struct(*[_has(x["t"], x["low"], p).alias(name) for name, p in (("user", USER_INPUT), ("over", OVERRIDE), ("bad", DANGEROUS))], F.length(x["t"]).alias("n")))
    return once(flags, _told)


def _told(flags: Column) -> Column:
    user, over, bad, empty, long_ = flags["user"], flags["over"], flags["bad"], flags["n"] == 0, flags["n"] > LONG
    score = F.when(empty, 0).otherwise(user.cast("int") * 2 + over.cast("int") * 2 + bad.cast("int") + long_.cast("int"))
    level = F.when(score >= 4, "High").when(score >= 2, "Medium").otherwise("Low")
    told = lambda table, key, when: F.when(when, F.lit(table[key]))
    reasons = F.array_compact(F.array(told(REASONS, "user_input", user), told(REASONS, "override", over), told(REASONS, "dangerous", bad), told(REASONS, "long", long_)))
    given = F.array_compact(F.array(told(SUGGESTIONS, "user_input", user), told(SUGGESTIONS, "override", over), told(SUGGESTIONS, "dangerous", bad)))
    one = lambda x: F.array(F.lit(x))
    suggestions = F.when(F.size(given) > 0, given).when(level == "Low", one(SUGGESTIONS["low"])).otherwise(one(SUGGESTIONS["review"]))
    return F.struct(
        score.alias("score"), level.alias("level"),
        F.when(empty, one(REASONS["empty"])).when(F.size(reasons) == 0, one(REASONS["none"])).otherwise(reasons).alias("reasons"),
        F.when(empty, one(SUGGESTIONS["empty"])).otherwise(suggestions).alias("suggestions"),
    )
