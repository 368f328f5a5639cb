"""Files in any storage that Spark reaches: written by the driver, of report size; and a folder for what queries write."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def local_uri(path: str) -> str:
    """A plain path names a file of this machine; what has a scheme stays."""
    return path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, parts: Iterable[str], at_once: int = 1 << 20) -> None:
    """Folders above the file are made, a file that is there is replaced; parts are written as they come."""
    if path.startswith("file:"):
        name = "/" + path[5:].lstrip("/")
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(name, "w", encoding="utf-8", errors="replace") as f:
            f.writelines(parts)
        return
    p, fs = _path(spark, path)
    out, held, size = fs.create(p, True), [], 0
    try:
        for part in parts:
            held.append(part)
            size += len(part)
            if size >= at_once:
                out.write("".join(held).encode("utf-8", "replace"))
                held, size = [], 0
        out.write("".join(held).encode("utf-8", "replace"))
    finally:
        out.close()


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir, else (on a local master only) in a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        found = "file://" + tempfile.gettempdir()
    return f"{found.rstrip('/')}/sparkward-{stem}-{uuid.uuid4().hex}"
