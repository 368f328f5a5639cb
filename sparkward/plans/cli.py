"""python -m sparkward scan|explain|prompt"""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import RULE_IDS, explain
from ..functions.prompt_risk import prompt_risk
from ..functions.scoring import SEVERITIES
from ..sources.state import DEFAULT_PATH, read_state, write_state
from .render import to_terminal, write_report
from .scan import build_report, scan


def parse_severity(text: str) -> str:
    low = text.strip().lower()
    if low not in SEVERITIES:
        raise argparse.ArgumentTypeError(f"severity is one of {', '.join(SEVERITIES)}")
    return low


def parse_rules(text: str) -> list[str]:
    rules = [r.strip().upper() for r in text.split(",") if r.strip()]
    if not rules or set(rules) - set(RULE_IDS):
        raise argparse.ArgumentTypeError(f"rules are of {', '.join(RULE_IDS)}")
    return rules


def parse_limit(text: str) -> int:
    m = re.match(r"\s*\+?(\d+)", text)
    if m is None:
        raise argparse.ArgumentTypeError("a limit is a number, 0 or more")
    return int(m.group(1))


def session() -> SparkSession:
    return SparkSession.builder.appName("sparkward").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None, out=None, state: str = DEFAULT_PATH) -> int:
    out = out or sys.stdout
    parser = argparse.ArgumentParser("sparkward", description="Scans source repositories for risks of language model use.")
    commands = parser.add_subparsers(dest="command", required=True)
    s = commands.add_parser("scan")
    s.add_argument("path", nargs="+")
    s.add_argument("-s", "--severity", type=parse_severity)
    s.add_argument("-r", "--rules", type=parse_rules)
    s.add_argument("--only-ai", action="store_true")
    s.add_argument("--limit", type=parse_limit, default=3)
    s.add_argument("--output")
    s.add_argument("--baseline")
    s.add_argument("--check-dependencies", action="store_true")
    s.add_argument("--registry", help="Parquet table of known packages: ecosystem, name")
    s.add_argument("--debug", action="store_true")
    commands.add_parser("explain").add_argument("rule")
    commands.add_parser("prompt").add_argument("text", nargs="+")
    a = parser.parse_args(argv)
    say = lambda *x: print(*x, file=out)
    if a.command == "explain":
        told = explain(a.rule)
        say(f"# {a.rule.strip().upper()}\n\nWhy it is risky:\n{told['why_risky']}\n\nHow it is exploited:\n{told['how_exploited']}\n\nExample:\n\n```ts\n{told['code_example']}\n```")
        return 0
    spark = session()
    if a.command == "prompt":
        r = spark.createDataFrame([(" ".join(a.text).strip(),)], "text string").select(prompt_risk(F.col("text")).alias("r")).first()["r"]
        say("\n".join(["Prompt risk", "-----------", f"Level: {r['level']}", "Reasons:", *(f"- {x}" for x in r["reasons"]), "Suggestions:", *(f"- {x}" for x in r["suggestions"])]))
        return 0
    before = read_state(a.path[0], state)
    registry = spark.read.parquet(a.registry) if a.registry else None
    result = scan(spark, *a.path, selected=a.rules, only_ai=a.only_ai, severity=a.severity, baseline=a.baseline, check_dependencies=a.check_dependencies, registry=registry)
    report = build_report(result)
    if b := result.baseline:
        say("Baseline created; later runs show what is new or worse.\n" if b["created"] else f"New since the baseline: {b['new_or_regressed_count']} (baseline {b['baseline_count']}, now {b['current_count']})\n")
    if a.output:
        write_report(report, a.output, spark)
        say(f"Report written to {a.output}\n")
    say(to_terminal(report, a.limit))
    if report.summary["total"] > 10:
        say("\nTip: --baseline shows only new issues.")
    if not a.output:
        say("Tip: --output report.html writes a report to share.")
    if not a.baseline and before and before["withoutBaselineRuns"] == 1:
        say("Tip: --baseline <file> makes a baseline.")
    write_state(a.path[0], bool(a.baseline), state)
    if a.debug:
        files = result.files.select("file")
        shown = [r["file"] for r in files.limit(20).collect()]
        print(f"\n[debug] files: {files.count()}\n[debug] rules: {', '.join(a.rules or ['all'])}", *(f"- {x}" for x in shown), sep="\n", file=sys.stderr)
    return 0
