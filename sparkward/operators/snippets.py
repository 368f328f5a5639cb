"""Source lines around findings: an equi-join by file and a slice, no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import html_escape

AROUND = 2


def snippet_of(lines: Column, line: Column, around: int = AROUND) -> Column:
    """array<struct<line_number, text, highlight>> of line and its neighbours; null if there is no such line."""
    first = F.greatest(F.lit(1), line - around)
    last = F.least(F.size(lines), line + around)
    part = F.slice(lines, first, last - first + 1)
    told = F.transform(part, lambda t, i: F.struct((first + i).cast("int").alias("line_number"), t.alias("text"), ((first + i) == line).alias("highlight")))
    return F.when((line >= 1) & (line <= F.size(lines)), told)


def with_snippets(findings: DataFrame, files: DataFrame, around: int = AROUND) -> DataFrame:
    """Only the findings' files are split; a file that isn't there gives null."""
    wanted = findings.groupBy("repo", "file").agg(F.collect_set("line").alias("ls"))
    lines = F.split("text", r"\r?\n", -1)
    cut = files.join(wanted, ["repo", "file"]).select("repo", "file", lines.alias("lines"), F.explode("ls").alias("line"))
    return findings.join(cut.select("repo", "file", "line", snippet_of(F.col("lines"), F.col("line"), around).alias("snippet")), ["repo", "file", "line"], "left")


def markdown_snippet(snippet: Column) -> Column:
    """A fenced block; >> marks the line itself."""
    row = lambda s: F.concat(F.when(s["highlight"], ">>").otherwise("  "), F.lit(" "), F.lpad(s["line_number"].cast("string"), 4, " "), F.lit(" | "), s["text"])
    return F.when(F.size(snippet) > 0, F.concat(F.lit("```ts\n"), F.array_join(F.transform(snippet, row), "\n"), F.lit("\n```"))).otherwise("")


def html_snippet(snippet: Column) -> Column:
    """One div per line, escaped; empty without lines."""
    row = lambda s: F.concat(F.lit('<div class="row'), F.when(s["highlight"], " hit").otherwise(""), F.lit('"><b>'), s["line_number"].cast("string"), F.lit("</b> "), html_escape(s["text"]), F.lit("</div>"))
    return F.when(F.size(snippet) > 0, F.concat(F.lit('<pre class="code">'), F.array_join(F.transform(snippet, row), ""), F.lit("</pre>"))).otherwise("")
