"""Dependency names: packages that a registry doesn't have, and names one edit away from a well-known package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import valid_package_name

TRUSTED = ("openai", "anthropic", "langchain", "langsmith", "transformers", "torch", "tensorflow", "fastapi", "flask", "django", "requests", "numpy")


def look_alike(name: Column, trusted: tuple[str, ...] = TRUSTED) -> Column:
    """The first trusted name at edit distance 1, or null; a trusted name is no look-alike."""
    low = F.lower(name)
    near = [F.when((F.abs(F.length(low) - len(t)) <= 1) & (F.levenshtein(low, F.lit(t)) == 1), F.lit(t)) for t in trusted]
    return F.when(~low.isin(*trusted), F.coalesce(*near))


def _known(registry: DataFrame) -> DataFrame:
    """ecosystem, name of what counts as existing. A column `found`, where there is one, tells of each lookup: true, false, or
    null if it failed, which counts as found."""
    rows = registry.where("coalesce(found, true)") if "found" in registry.columns else registry
    return rows.select("ecosystem", "name").distinct()


def missing_packages(candidates: DataFrame, registry: DataFrame, scoped: bool = True) -> DataFrame:
    """Candidates that the registry (ecosystem, name, perhaps found) hasn't, or whose name can't be one."""
    valid = valid_package_name(F.col("name"), scoped)
    gone = candidates.where(valid).join(_known(registry), ["ecosystem", "name"], "left_anti").select(*candidates.columns)
    return candidates.where(~valid).unionByName(gone)


def known_packages(candidates: DataFrame, registry: DataFrame, scoped: bool = True) -> DataFrame:
    return candidates.where(valid_package_name(F.col("name"), scoped)).join(_known(registry), ["ecosystem", "name"], "left_semi").select(*candidates.columns)


def _told(rows: DataFrame, rule_id: str, title: str, summary: Column, description: str, recommendation: str, score: float, node_ord: int) -> DataFrame:
    lit = F.lit
    return rows.select(
        "repo", lit(rule_id).alias("rule_id"), lit(title).alias("title"), lit("low").alias("severity"), "file", "line", summary.alias("summary"), lit(description).alias("description"), lit(recommendation).alias("recommendation"),
        lit(score).alias("confidence"), lit(100).alias("rule_ord"), lit(0).alias("fn_pos"), F.col("ord").cast("int").alias("call_pos"), lit(node_ord).alias("node_ord"),
    )


def dependency_findings(candidates: DataFrame, registry: DataFrame | None = None, scoped: bool = True) -> DataFrame:
    """LLM_DEP001 for missing packages, else LLM_DEP002 for look-alikes. Without a registry every name counts as known."""
    known = candidates if registry is None else known_packages(candidates, registry, scoped)
    like = known.withColumn("like", look_alike(F.col("name"))).where("like IS NOT NULL")
    out = _told(like, "LLM_DEP002", "Dependency name looks similar to a popular package", F.format_string("%s may be confused with %s.", "name", "like"), "A name so close to a popular one can be typosquatting or a slip.", "Confirm who owns the package before it is installed.", 0.6, 1)
    if registry is None:
        return out
    gone = missing_packages(candidates, registry, scoped)
    return _told(gone, "LLM_DEP001", "Dependency package not found in registry", F.format_string("%s was not found in %s.", "name", "ecosystem"), "The name may be a typo, made up, or out of date.", "Check the spelling and use a package that is known and maintained.", 0.9, 0).unionByName(out)
