"""Ignore directives: // sparkward-ignore RULE: reason, on a line of its own.

Each finding, in order of lines, takes the earliest directive of its rule above it in its file that no finding before
it took, however far above. As a window: among a rule's directives (+1) and findings (-1) of a file in order of lines, a
finding before a directive of its own line, the least running balance so far falls exactly where a finding goes without;
any other takes the directive whose number is that of the findings so far, less those that went without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import file_key

KEYWORD = "sparkward-ignore"


def parse_directives(files: DataFrame, keyword: str = KEYWORD) -> DataFrame:
    """repo, file, file_key, rule_id (upper case), reason (not empty), line. Of files with one key the last counts."""
    pattern = rf"^\s*//\s*{keyword}\s+(\w+)\s*:\s*(.+?)\s*$"
    numbered = F.transform(F.split("text", r"\r?\n", -1), lambda t, n: F.struct(n.alias("n"), t.alias("t")))
    of_file = F.filter(numbered, lambda x: x["t"].contains(keyword)).alias("lines")  # found before files are compared, so no text moves
    last = files.select("repo", file_key(F.col("file")).alias("file_key"), F.struct("file", of_file).alias("f")).groupBy("repo", "file_key").agg(F.max_by("f", "f.file").alias("f"))
    lines = last.select("repo", "file_key", "f.file", F.inline("f.lines"))
    told = lines.select("repo", "file", "file_key", F.upper(F.regexp_extract("t", pattern, 1)).alias("rule_id"), F.trim(F.regexp_replace(F.regexp_extract("t", pattern, 2), r"\s+$", "")).alias("reason"), (F.col("n") + 1).cast("int").alias("line"))
    return told.where("rule_id != '' AND reason != ''")


def match_first_in_first_out(findings: DataFrame, directives: DataFrame, keys: list[str], kept: tuple[str, ...] = (), told: tuple[str, ...] = ()) -> DataFrame:
    """findings (keys, line, ord, and what is kept of them) with directive_line and what is told of it, null where none is
    left. directives: keys, line, and what is told."""
    none = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    asking = findings.select(*keys, "line", F.lit(0).alias("is_directive"), "ord", *kept, *none(directives, told))
    events = asking.unionByName(directives.select(*keys, "line", F.lit(1).alias("is_directive"), *none(findings, ("ord", *kept)), *told))
    order = Window.partitionBy(*keys).orderBy("line", "is_directive", "ord")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    run = events.withColumn("s", F.sum(F.col("is_directive") * 2 - 1).over(upto)).withColumn("m", F.least(F.lit(0), F.min("s").over(upto)))
    run = run.withColumn("before", F.coalesce(F.lag("m").over(order), F.lit(0))).withColumn("findings_so_far", F.sum(1 - F.col("is_directive")).over(upto))
    # of directives alone: numbered in the window above, they would take all that leads to the findings a second time
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("line"))
    taken = directives.select(*keys, number.cast("long").alias("k"), F.col("line").alias("directive_line"), *told)
    asked = run.where("is_directive = 0").select(*keys, "line", "ord", *kept, F.when(F.col("m") == F.col("before"), F.col("findings_so_far") + F.col("m")).alias("k"))
    return asked.join(taken, [*keys, "k"], "left").drop("k")


def apply_directives(findings: DataFrame, directives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, ignored): ignored has finding (a struct), reason, annotation_line. The findings travel along, so one join does."""
    place = F.struct("rule_ord", "file", "fn_pos", "call_pos", "node_ord")
    keyed = findings.select("repo", file_key(F.col("file")).alias("file_key"), "rule_id", "line", place.alias("ord"), F.struct(*findings.columns).alias("finding"))
    told = match_first_in_first_out(keyed, directives, ["repo", "file_key", "rule_id"], ("finding",), ("reason",))
    active = told.where("directive_line IS NULL").select("finding.*")
    ignored = told.where("directive_line IS NOT NULL").select("finding", "reason", F.col("directive_line").alias("annotation_line"))
    return active, ignored
