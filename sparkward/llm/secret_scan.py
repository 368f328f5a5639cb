"""Secret scans through an incremental blob ledger.

Every text is a blob, addressed by the SHA-256 of its content, however many paths (documents, or versions of them)
hold it. The ledger is a Parquet table in shared storage, partitioned by rule version and run, of the blobs scanned so
far with their findings. A scan takes the distinct blobs, drops those the ledger already has under this rule version
(anti-join), scans the rest, adds them as a run of its own, and joins findings back to all paths. A run over versions
already seen scans nothing and moves no text; a new rule version scans everything once more beside the old findings.
A run counts once it is complete, and a blob that two runs scanned at the same time counts once, so runs may be
repeated or overlap. Copies are merged before the shuffle too, so a task sends a hot blob once; where findings are joined
back, hot blobs are spread over salts.

Defined results: a null text counts as the empty one, which has no findings. Null and repeated doc_ids are paths like
any other: one row for each row. An empty table gives an empty table. Columns other than doc_id and text aren't read
(redact() keeps them all). Spans are in code points, ends exclusive, over whole texts.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, hot_keys, ids_and_text, join_spread, new_table_path, shielded, text_of, written

RULE_VERSION = 1

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: The base kinds, then those added here: (kind, a literal that every match holds, pattern).
BASE_KINDS = ("assign", "access", "hex")
_ADDED = (
    ("pem", "-----BEGIN ", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")),
    ("jwt", "eyJ", None),  # find_jwts
    ("codehost", "gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat", "xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("cloudkey", "AIza", re.compile(r"AIza[A-Za-z0-9_-]{35}")),
    ("payment", "k_live_", re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}")),
)
KINDS = BASE_KINDS + tuple(kind for kind, _, _ in _ADDED)

_SCHEMA = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


_JWT_REST = re.compile(r"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_JWT_HEAD = re.compile(r"eyJ[A-Za-z0-9_-]{8,}$")
_JWT_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")


def find_jwts(text: str) -> list[tuple[int, int]]:
    """What eyJ[\\w-]{8,}\\.eyJ[\\w-]{8,}\\.[\\w-]{8,} finds, in linear time: from the dots, which part runs of its alphabet."""
    found, at, seek = [], 0, 0
    while m := _JWT_REST.search(text, seek):
        a = m.start()
        while a > at and text[a - 1] in _JWT_RUN:
            a -= 1
        if head := _JWT_HEAD.search(text[a : m.start()]):
            at = seek = m.end()
            found.append((a + head.start(), at))
        else:
            seek = m.start() + 1
    return found


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index in KINDS, end) of all matches, sorted; for each kind leftmost and without overlaps."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for k, (_, literal, pattern) in enumerate(_ADDED, len(BASE_KINDS)):
        if literal in text:
            found += [(a, k, b) for a, b in find_jwts(text)] if pattern is None else [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    found.sort()
    return found


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for blob, text in zip(batch.column("blob").to_pylist(), batch.column("text").to_pylist()):
            found = find_secrets(text)
            counts = [sum(k == base for _, k, _ in found) for base in range(3)]
            base = _joined([x for x in found if x[1] < 3])
            rows.append((blob, *counts, hashlib.sha256(base.encode()).hexdigest(), _joined(found)))
        columns = list(zip(*rows)) or [()] * 6
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _runs(spark, ledger: str, rule_version: int) -> list[str]:
    """The folders of complete runs."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(f"{ledger}/rule_version={rule_version}")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    runs = [x.getPath().toString() for x in fs.listStatus(root)]
    return sorted(r for r in runs if fs.exists(hadoop(r + "/_SUCCESS")))


def read_ledger(spark, ledger: str, rule_version: int) -> DataFrame:
    """Findings by blob under one rule version, each blob once; empty where there is no ledger yet."""
    runs = _runs(spark, ledger, rule_version)
    if not runs:
        return spark.createDataFrame([], _SCHEMA)
    known = spark.read.schema(_SCHEMA).parquet(*runs)
    return known.dropDuplicates(["blob"]) if len(runs) > 1 else known  # a run has each blob once


#: Unseen blobs are broadcast (64 bytes each) up to this many, so that only their texts move; beyond, all move, once.
FEW_BLOBS = 200_000


def update_ledger(docs: DataFrame, ledger: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """Scan the blobs of docs which the ledger hasn't, add them as a run, and return the ledger."""
    spark = docs.sparkSession
    texts = ids_and_text(docs).select(F.sha2("text", 256).alias("blob"), "text")
    unseen = None
    if _runs(spark, ledger, rule_version):
        unseen = written(texts.select("blob").distinct().join(read_ledger(spark, ledger, rule_version).select("blob"), "blob", "left_anti"), "unseen-blobs")
        n = unseen.count()
        if not n:
            dropped(unseen)
            return read_ledger(spark, ledger, rule_version)
        if n <= FEW_BLOBS:
            texts = texts.join(F.broadcast(unseen), "blob", "left_semi")
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))  # copies are merged before the shuffle too
    if unseen is not None and n > FEW_BLOBS:
        blobs = blobs.join(unseen, "blob", "left_semi")
    blobs.select("blob", "text").mapInArrow(_scan, _SCHEMA).write.parquet(f"{ledger}/rule_version={rule_version}/run={uuid.uuid4().hex}")
    dropped(unseen)
    return read_ledger(spark, ledger, rule_version)


def scan_secrets(docs: DataFrame, ledger: str | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """Per row of docs: doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans. ledger: a folder, by default a new one."""
    ledger = ledger or new_table_path(docs.sparkSession, "secret-ledger")
    findings = update_ledger(docs, ledger, rule_version)
    paths = written(ids_and_text(docs).select("doc_id", F.sha2("text", 256).alias("blob")), "paths")
    return join_spread(paths, findings, "blob", hot_keys(paths, "blob"), ["doc_id"]).select("doc_id", "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


MASK = "[SECRET]"


def _masked(text: str, spans: str) -> str:
    out, at = [], 0
    for part in spans.split(","):
        _, a, b = part.split(":")
        a, b = int(a), int(b)
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = b
    return "".join(out) + text[at:]


@shielded
def redact(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """docs with each secret replaced by MASK and n_chars, where there is one, set anew; all rows and columns stay."""
    ledger = ledger or new_table_path(docs.sparkSession, "secret-ledger")
    findings = update_ledger(docs, ledger).where("spans != ''").select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    keyed = docs.withColumn("__blob", F.sha2(text_of(docs), 256))
    paths = written(keyed.select("__blob"), "paths")
    joined = join_spread(keyed, findings, "__blob", hot_keys(paths, "__blob"), ["doc_id"], "left").drop("__blob")
    dropped(paths)
    where = joined.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).to_pylist()
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = [_masked(t, s) if s else t for t, s in zip(texts, spans)]
            columns = batch.columns
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = joined.mapInArrow(mask, joined.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
