"""The baseline file: a JSON object with a schema tag, when it was made, and the findings known then."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import finding_key, severity_rank
from .storage import local_uri, write_text

SCHEMA = "sparkward-baseline-v1"
PLACE = ("ord", "rule_ord", "file", "fn_pos", "call_pos", "node_ord")
ENTRY = "rule_id string, file string, line int, severity string, confidence double"


def read_baseline(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Its entries with ord, their place in the file. Another tag, or findings that are no list, is an error."""
    whole = spark.read.schema(f"schema string, createdAt string, findings array<struct<{ENTRY.replace(' ', ': ').replace(',: ', ', ')}>>").json(local_uri(path), multiLine=True)
    row = whole.select("schema", F.col("findings").isNull().alias("none")).first()
    if row is None or row["schema"] != schema or row["none"]:
        raise ValueError(f"{path} is no baseline of {schema}")
    return whole.select(F.posexplode("findings").alias("ord", "f")).select("ord", "f.*")


def baseline_rows(findings: DataFrame) -> DataFrame:
    """The five columns that a baseline keeps, in order of their key (line numbers as text), findings of one key in their own
    order (ord, else the place that rules give), since the last of a key counts."""
    key = finding_key(F.col("rule_id"), F.col("file"), F.col("line"))
    own = [c for c in PLACE if c in findings.columns]
    return findings.orderBy(key, *own, "file", severity_rank(F.col("severity")), "confidence").select("rule_id", "file", "line", "severity", "confidence")


def write_baseline(findings: DataFrame, path: str, schema: str = SCHEMA) -> None:
    """One report-sized JSON file in any storage, written by the driver row by row."""
    made = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")

    def parts() -> Iterator[str]:
        yield f'{{\n  "schema": {json.dumps(schema)},\n  "createdAt": {json.dumps(made)},\n  "findings": ['
        for n, row in enumerate(baseline_rows(findings).toLocalIterator()):
            yield ("," if n else "") + "\n    " + json.dumps(row.asDict())
        yield "\n  ]\n}\n"

    write_text(findings.sparkSession, local_uri(path), parts())
