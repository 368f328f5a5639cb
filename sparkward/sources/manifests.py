"""Package candidates from package.json and requirements.txt at the root of a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def first_line_with(text: Column, needle: Column) -> Column:
    """The first line, from 1, that holds needle; 1 if none does."""
    hits = F.transform(F.split(text, r"\r?\n", -1), lambda line: F.contains(line, needle))
    at = F.array_position(hits, F.lit(True))
    return F.when(at == 0, 1).otherwise(at).cast("int")


def npm_candidates(files: DataFrame) -> DataFrame:
    """Names of all four dependency sections, in that order. Malformed JSON gives none."""
    own = files.where("file = 'package.json'")
    parsed = F.from_json("text", "struct<" + ",".join(f"{s}: map<string,string>" for s in _SECTIONS) + ">")
    names = F.flatten(F.array(*[F.coalesce(F.map_keys(F.col("p")[s]), F.array().cast("array<string>")) for s in _SECTIONS]))
    rows = own.withColumn("p", parsed).select("repo", "file", "text", F.posexplode(names).alias("ord", "name"))
    return rows.select("repo", F.lit("npm").alias("ecosystem"), "name", "file", first_line_with(F.col("text"), F.concat(F.lit('"'), F.col("name"), F.lit('"'))).alias("line"), "ord")


def requirement_name(line: Column) -> Column:
    """The package that a line of requirements.txt names, or null: blank, comment, option and URL lines have none."""
    t = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    skip = (t == "") | t.startswith("#") | t.startswith("-") | t.contains("://")
    name = F.regexp_extract(t, r"^[A-Za-z0-9_.-]+", 0)
    return F.when(~skip & (name != ""), name)


def pypi_candidates(files: DataFrame) -> DataFrame:
    lines = files.where("file = 'requirements.txt'").select("repo", "file", F.posexplode(F.split("text", r"\r?\n", -1)).alias("ord", "l"))
    return lines.select("repo", F.lit("pypi").alias("ecosystem"), requirement_name(F.col("l")).alias("name"), "file", (F.col("ord") + 1).cast("int").alias("line"), "ord").where("name IS NOT NULL")


def package_candidates(files: DataFrame) -> DataFrame:
    """repo, ecosystem, name, file, line, ord; of one name in one file the first stays."""
    both = npm_candidates(files).unionByName(pypi_candidates(files))
    return dedupe_candidates(both)


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    rest = [c for c in candidates.columns if c not in ("repo", "ecosystem", "file")]
    first = candidates.groupBy("repo", "ecosystem", F.lower("name").alias("__k"), "file").agg(F.min_by(F.struct(*rest), "ord").alias("r"))
    return first.select("repo", "ecosystem", "file", "r.*").select(*candidates.columns)
