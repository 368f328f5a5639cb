"""Helpers shared by the text operators: reading tables, shared storage, sizing partitions."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else (tests on a local master only) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"sparkward-{uuid.uuid4().hex}")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


_open: list[list[str]] = []


def new_table_path(spark: SparkSession, stem: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


@contextlib.contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths of all tables that are made inside."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open[:] = [x for x in _open if x is not made]


def written(df: DataFrame, stem: str) -> DataFrame:
    """Cut the lineage with a Parquet table in shared storage (smaller than a checkpoint, and column-pruned when read)."""
    path = new_table_path(df.sparkSession, stem)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing will read again: what was made of them is itself written."""
    for t in tables:
        if t is not None:
            drop_paths(t.sparkSession, [t._written_at])


def drop_paths(spark: SparkSession, paths: Iterable[str], *kept: DataFrame) -> None:
    """Delete tables by path, but for those that are kept."""
    for p in set(paths) - {t._written_at for t in kept}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more rows than HOT_ROWS, and than one in HOT_SHARE of all, is hot: so there are at most HOT_SHARE of them.
HOT_ROWS = 100_000
HOT_SHARE = 1000


def hot_keys(rows: DataFrame, column: str) -> DataFrame | None:
    """(__hot, __salts) of the hot keys of a narrow table, counted with partial sums: a small local table, or None."""
    least = max(HOT_ROWS, rows.count() // HOT_SHARE)
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__hot")).agg(F.count("*").alias("n")).where(F.col("n") > least)
    found = counts.select("__hot", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("__salts")).collect()
    return rows.sparkSession.createDataFrame(found, counts.select("__hot", F.lit(1).alias("__salts")).schema) if found else None


def join_spread(left: DataFrame, right: DataFrame, column: str, hot: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, column, how) with the rows of left that have a hot key spread over salts, by a hash of the columns
    `by` and the task they come from; right's rows of hot keys are repeated, a row for each HOT_ROWS of left."""
    if hot is None:
        return left.join(right, column, how)
    hot = F.broadcast(hot)  # at most HOT_SHARE rows
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    place = F.xxhash64(*by, F.spark_partition_id())
    spread = left.withColumn("__place", place).join(hot, F.col(column) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.col("__place"), salts).cast("int")).drop("__hot", "__salts", "__place")
    repeated = right.join(hot, F.col(column) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__hot", "__salts")
    return spread.join(repeated, [column, "__salt"], how).drop("__salt")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def ids_and_text(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, stay out of the plan. A null text counts as empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))


def partitions_for(total_bytes: int, per_partition: int, least: int = 12) -> int:
    """As many partitions as keep each near per_partition bytes; grows with the data."""
    return max(least, -(-int(total_bytes) // per_partition))


def total_text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


_READ = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(stage):
    """A stage that returns rows of docs with all their columns: columns that it doesn't read go by other names inside."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        columns = [F.col("`" + c.replace("`", "``") + "`").alias(c if c in _READ else f"x{k}") for k, c in enumerate(docs.columns)]
        return stage(docs.select(*columns), *args, **kwargs).toDF(*docs.columns)

    return run


def keep_rows(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id and text are in stay (doc_id, raw_hash: xxhash64 of the
    text). Of rows that share both, one stays."""
    first = F.lit(-(1 << 63))
    key = lambda doc_id, text_hash: {"__d": F.coalesce(doc_id.cast("long"), first), "__n": doc_id.isNull(), "__hash": text_hash}
    named = stay.select(*[c.alias(n) for n, c in key(stay["doc_id"], stay["raw_hash"]).items()]).distinct()
    keyed = docs.withColumns(key(docs["doc_id"], F.xxhash64(text_of(docs))))
    # the texts are shuffled once: rows that share the key are in one partition after the join
    return keyed.join(named, ["__d", "__n", "__hash"], "left_semi").dropDuplicates(["__d", "__n", "__hash"]).select(*docs.columns)
