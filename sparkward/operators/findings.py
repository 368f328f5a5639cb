"""The algebra of findings: filter, distinct, baseline, groups, histograms, ranking. Findings are those of rules.COLUMNS.

Reports are per repository; `by` names the columns that tell reports apart (one repository: none needed).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import CATALOG, CATEGORIES
from ..functions.scoring import SEVERITIES, confidence_range, file_key, finding_key, is_informational, posture, release_decision, risk_percentage, severity_rank

EPSILON = 1e-6


def at_least(findings: DataFrame, severity: str | None, column: str = "severity") -> DataFrame:
    """Findings of a severity or above it; all without one. column may lie in a struct, as of ignored rows."""
    if severity is None:
        return findings
    return findings.where(severity_rank(F.col(column)) >= SEVERITIES.index(severity) + 1)


def issues(findings: DataFrame) -> DataFrame:
    return findings.where(~is_informational(F.col("rule_id")))


def informational(findings: DataFrame) -> DataFrame:
    return findings.where(is_informational(F.col("rule_id")))


def first_of(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key by order: one aggregation, partial on the map side, instead of a sort of each key's rows."""
    keyed = df.withColumns({f"__k{n}": k for n, k in enumerate(keys)})
    rows = keyed.groupBy(*[f"__k{n}" for n in range(len(keys))]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return rows.select("r.*")


def distinct_findings(findings: DataFrame, by: tuple[str, ...] = ("repo",), order: tuple[str, ...] = ("rule_ord", "file", "fn_pos", "call_pos", "node_ord")) -> DataFrame:
    """Of findings with one rule, file key, line and summary the first in rule and walking order."""
    keys = [*map(F.col, by), F.col("rule_id"), file_key(F.col("file")), F.col("line"), F.col("summary")]
    return first_of(findings, keys, list(order))


def baseline_diff(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that the baseline hasn't, or has with a lower severity or confidence. Its last entry of a key counts."""
    key = finding_key(F.col("rule_id"), F.col("file"), F.col("line"))
    known = baseline.groupBy(key.alias("__key")).agg(F.max_by(F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("confidence")), "ord").alias("__old"))
    joined = findings.withColumn("__key", key).join(known, "__key", "left")
    worse = F.col("__old").isNull() | (severity_rank(F.col("severity")) > F.col("__old.rank")) | (F.col("confidence") > F.col("__old.confidence") + EPSILON)
    return joined.where(worse).drop("__key", "__old")


def baseline_counts(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: baseline_count, current_count, new_or_regressed_count, unchanged_count."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    row = one(baseline, "baseline_count").crossJoin(one(findings, "current_count")).crossJoin(one(baseline_diff(findings, baseline), "new_or_regressed_count"))  # single rows
    return row.withColumn("unchanged_count", F.greatest(F.lit(0), F.col("current_count") - F.col("new_or_regressed_count")))


def group_by_rule(findings: DataFrame, by: tuple[str, ...] = (), order: tuple[str, ...] = ("ord",), snippet: bool = False, preview: int | None = None) -> DataFrame:
    """One row per rule: title, severity, reason and recommendation of its first finding, the range of confidence,
    occurrences in order. preview: only so many occurrences (their count stays), where a rule may have any number: tasks
    then send no more than that of a rule, and none gets all of them.
    """
    place, keys = F.struct(*order), [*by, "rule_id"]
    first = lambda c: F.min_by(c, place)
    reason = F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.col("description")).otherwise(F.col("summary"))
    one = F.struct(*[F.col(c).alias(f"__{c}") for c in order], "file", "line", *(["snippet"] if snippet else []))
    fields = ["file", "line"] + (["snippet"] if snippet else [])
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("occurrences")
    told = [
        first(F.col("title")).alias("title"), first(F.col("severity")).alias("severity"), F.min("confidence").alias("confidence_min"), F.max("confidence").alias("confidence_max"),
        first(reason).alias("reason"), first(F.col("recommendation")).alias("recommendation"), F.count("*").alias("n_occurrences"), F.min(place).alias("first_place"),
    ]
    if preview is None:
        return findings.groupBy(*keys).agg(*told, listed)
    heads = findings.groupBy(*keys).agg(*told)
    least = findings.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= preview)  # limited in each task before the shuffle
    shown = least.groupBy(*[F.col(k).alias(f"__of_{k}") for k in keys]).agg(listed)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys))
    none = F.array().cast(shown.schema["occurrences"].dataType)
    return heads.join(shown, same, "left").withColumn("occurrences", F.coalesce("occurrences", none)).drop(*[f"__of_{k}" for k in keys])


def severity_summary(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """total, and a count for each severity; a repository without findings has no row, one report without `by` always has."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in reversed(SEVERITIES)]
    return findings.groupBy(*by).agg(F.count("*").alias("total"), *counts) if by else findings.agg(F.count("*").alias("total"), *counts)


def with_decision(summary: DataFrame) -> DataFrame:
    c, h, m = F.col("critical"), F.col("high"), F.col("medium")
    return summary.withColumns({"posture": posture(c, h, m), "decision": release_decision(c, h, m), "must_fix": c + h})


def narrative(summary: DataFrame) -> Column:
    """A sentence for each posture; for rows of with_decision."""
    n = lambda text, *c: F.format_string(text, *map(F.col, c))
    return (
        F.when(F.col("total") == 0, "The scan found nothing. Risk posture: Low.")
        .when(F.col("posture") == "High", n("The scan found %d issue(s), %d critical and %d high. Risk posture: High; fix the priority risks before a release.", "total", "critical", "high"))
        .when(F.col("posture") == "Medium", n("The scan found %d issue(s), mostly medium. Risk posture: Medium; plan fixes ahead of releases.", "total"))
        .otherwise(n("The scan found %d low issue(s). Risk posture: Low; handle them in maintenance.", "total"))
    )


def risk_mix(summary: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each report and severity its count, rounded percentage, and the stretch it takes of a whole (to 2 places)."""
    share = lambda s: F.when(F.col("total") > 0, F.col(s) * 100.0 / F.col("total")).otherwise(0.0)
    rows, upto = [], F.lit(0.0)
    for place, s in enumerate(reversed(SEVERITIES)):
        start, upto = upto, upto + share(s)
        rows.append(F.struct(F.lit(place).alias("place"), F.lit(s).alias("severity"), F.col(s).alias("n"), risk_percentage(F.col(s), F.col("total")).alias("percent"), F.round(start, 2).alias("from_percent"), F.round(upto, 2).alias("to_percent")))
    return summary.select(*by, F.inline(F.array(*rows)))


def category(rule_id: Column) -> Column:
    out = F.lit(CATEGORIES[3])
    for rule, told in CATALOG.items():
        out = F.when(rule_id == rule, told["category"]).otherwise(out)
    return out


def _best_first() -> list[Column]:
    return [F.desc(severity_rank(F.col("severity"))), F.desc("confidence_max"), F.asc("first_place")]


def top_groups(groups: DataFrame, count: int = 3, limit: int | None = None) -> DataFrame:
    """The groups of highest severity, then confidence, then appearance. A limit can only lower the count."""
    return groups.orderBy(*_best_first()).limit(count if limit is None else min(count, max(0, limit)))


def by_category(groups: DataFrame) -> DataFrame:
    """One row per category, in the preferred order, with its groups, best first."""
    ranked = groups.withColumn("category", category(F.col("rule_id"))).withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(*_best_first())))
    at = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    listed = ranked.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("place", "rule_id", "severity", "confidence_max", "n_occurrences"))).alias("groups"))
    return listed.withColumn("category_order", at).orderBy(at, "category")


def top_actions(groups: DataFrame) -> Column:
    """A line for each group: severity, rule and short fix (of the catalog, joined before)."""
    return F.concat(F.upper("severity"), F.lit(" "), F.col("rule_id"), F.lit(": "), F.coalesce("told_short_fix", "recommendation"))


def place_in_file(order: str = "ord") -> Column:
    """The rank of a finding in the order of reports: files by their path with forward slashes, then lines, ties as they came."""
    return F.row_number().over(Window.partitionBy(F.replace(F.col("file"), F.lit("\\"), F.lit("/"))).orderBy("line", order))


def preview_of(occurrences: Column, n_occurrences: Column, shown: int) -> Column:
    """struct(shown: the first as file:line, remaining)."""
    listed = F.transform(F.slice(occurrences, 1, shown), lambda o: F.concat(o["file"], F.lit(":"), o["line"].cast("string")))
    return F.struct(listed.alias("shown"), F.greatest(F.lit(0), n_occurrences - F.size(listed)).alias("remaining"))


def split_evidence(occurrences: Column, first: int = 2) -> Column:
    return F.struct(F.slice(occurrences, 1, first).alias("primary"), F.slice(occurrences, first + 1, 1_000_000_000).alias("overflow"))


def range_text(groups: DataFrame) -> Column:
    return confidence_range(F.col("confidence_min"), F.col("confidence_max"))
